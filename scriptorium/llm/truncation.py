"""Texts that were cut short, and how often each source cuts.

Method: self-join by prefix through sorting. The different texts, without what was put after a cut,
are sorted over the cluster; a text that is a strict prefix of another is a prefix of its successor.
Copies of cut texts are rare, so the same question is asked at the end of the text itself: prose
that stops without a closing sign, a closing line that is the beginning of a usual closing line, and
verse that stops within its line at a length where the texts of its source pile up (a field limit,
in characters or bytes, learned from all lengths of the source) or, at any length, inside a word:
the last word stands nowhere else, another word goes on from it, and words seldom end like it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_letter_table, strip_blanks
from ..session import map_batches, materialise

#: What is put after a cut: dots, with or without brackets, or the sign for broken bytes.
CUT_MARK = r"(?:[\s\p{Z}]*(?:[\[(][\s\p{Z}]*(?:…|\.\.\.+)[\s\p{Z}]*[\])]|…|\.\.\.+|�+))+[\s\p{Z}]*$"
#: Ornaments and note numbers after a whole text.
TAIL = r"(?:[\s\p{Z}\p{So}\p{Sk}\x{FE0F}]|\[[0-9]+\])+$"
#: A text is closed if it ends in one of the signs, closers aside.
CLOSERS, SIGNS = "\"'»“”’)]", ".?!;·;"
#: A length is a field limit if LIMIT_RATIO times as many different texts have it as the lengths
#: within LIMIT_REACH around it have on average, and so many would come together by chance at any
#: length of the source in less than LIMIT_CHANCE of all cases.
LIMIT_RATIO, LIMIT_REACH, LIMIT_CHANCE = 6, 12, 0.001
#: A closing line is usual if it ends at least this share of the different texts of its kind.
USUAL_CLOSING = 0.02
#: Three letters are a usual word ending if at least this share of the words that hold them end there.
USUAL_ENDING = 0.1


def _closed(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(CLOSERS)), F.lit(1)).isin(*SIGNS)


def _may_be_marked(stripped: Column) -> Column:
    """Cheap test on the last signs, so that the pattern runs on few texts."""
    return stripped.endswith("…") | stripped.endswith("...") | stripped.endswith("�") | stripped.endswith("]") | stripped.endswith(")")


def _body(text: Column) -> Column:
    """The text without cut mark, tail and outer blanks, with line ends made alike."""
    def unmarked(t: Column) -> Column:
        return F.when(_may_be_marked(t), strip_blanks(F.regexp_replace(t, CUT_MARK, ""))).otherwise(t)

    def bare(t: Column) -> Column:
        last = F.right(t, F.lit(1))
        return F.when((last == "]") | (last > "\x7f"), strip_blanks(F.regexp_replace(t, TAIL, ""))).otherwise(t)

    # a one-element array binds each step's value, so that none is computed twice
    one = F.array(strip_blanks(F.replace(text, F.lit("\r\n"), F.lit("\n"))))
    return F.get(F.transform(F.transform(one, unmarked), bare), F.lit(0))


def _prefix_pass(batches: Iterator, columns: tuple[str, ...] = ("value",)) -> Iterator:
    """Over one sorted partition: values that later ones continue, and what the edges need.

    All values that continue a value follow it directly, so a stack of the values that the present
    one continues, each inside the next, is all that is kept. ``after`` is the first sign other than
    a line end with which some longer value goes on, or the line end if all do with that.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    first = None
    stack: list[list] = []  # [value, sign with which it goes on so far]
    names = ["what", "pid", "value", "after"]

    def rows(what: str, items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([what] * len(items), pa.string()), pa.array([pid] * len(items), pa.int32()), pa.array([v for v, _ in items], pa.string()), pa.array([a for _, a in items], pa.string())], names=names)

    for batch in batches:
        hits = []
        for v in batch.column(0).to_pylist():
            if not v:
                continue
            first = v if first is None else first
            while stack and not v.startswith(stack[-1][0]):
                if (top := stack.pop())[1] is not None:
                    hits.append(top)
            if stack and stack[-1][1] in (None, "\n"):  # those further down go on as the one above them does
                stack[-1][1] = v[len(stack[-1][0])]
            stack.append([v, None])
        yield rows("hit", hits)
    yield rows("hit", [x for x in stack if x[1] is not None])
    if first is not None:
        yield rows("first", [(first, None)])
        yield rows("last", [(v, None) for v, a in stack if a in (None, "\n")])


def strict_prefixes(values: DataFrame, value: str) -> DataFrame:
    """``(value, after)`` for each different non-empty value that is a strict prefix of another one;
    ``after`` is a character with which a longer value goes on, a line end only if all seen do so.

    Copies fold before the sort, and a partition is read as a stream, so neither hot values nor
    common beginnings gather in memory. A value at the end of a partition is held against the first
    of the next. Null and empty values are left out.
    """
    v = values.select(F.col(f"`{value}`").alias("value")).distinct()
    parts = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = v.repartitionByRange(parts, "value").sortWithinPartitions("value")
    seen = materialise(map_batches(ordered, _prefix_pass, "what string, pid int, value string, after string"))
    hits = seen.where("what = 'hit'").select("value", "after")
    # partitions that hold any value are numbered, a table of one row for each
    firsts = seen.where("what = 'first'").select("pid", "value", F.row_number().over(Window.orderBy("pid")).alias("nth"))
    last = seen.where("what = 'last'").select("pid", "value").join(firsts.select("pid", "nth"), "pid")
    nxt = firsts.select((F.col("nth") - 1).alias("nth"), F.col("value").alias("next"))
    over = last.join(nxt, "nth").where(F.col("next").startswith(F.col("value"))).select("value", F.substring("next", F.length("value") + 1, F.lit(1)).alias("after"))
    return hits.union(over).groupBy("value").agg(F.max("after").alias("after"))


def field_limits(rows: DataFrame) -> DataFrame:
    """``(source, measure, length)``: the lengths in characters or bytes at which texts of a source
    pile up. Each different text (``h1``, ``h2``) counts once at a length, however often it is repeated."""
    by = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-LIMIT_REACH, LIMIT_REACH)
    counts = rows.select("source", "h1", "h2", F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length")))).alias("x")).select("source", "x.*", "h1", "h2").distinct().groupBy("source", "measure", "length").count()
    near = F.sum("count").over(by) - F.col("count")
    k, mean = F.col("count"), (F.col("near") + 1) / (2 * LIMIT_REACH)  # one more, as none seen is not none possible
    # Chernoff's bound of the Poisson chance of k or more, for each of the source's lengths
    chance = k - mean - k * F.log(k / mean) + F.log("lengths")
    counts = counts.withColumn("near", near).withColumn("lengths", F.count("*").over(Window.partitionBy("source", "measure")))
    return counts.where((k >= LIMIT_RATIO * mean) & (chance < math.log(LIMIT_CHANCE))).select("source", "measure", "length")


def _words(body: Column) -> Column:
    """The words in order, in small letters without marks; the last is empty after a sign."""
    src, dst = base_letter_table()
    t = F.lower(F.translate(body, src, dst))
    return F.split(F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, r"\p{M}+", "")), r"\P{L}+")


def _ending(word: Column) -> Column:
    return F.right(F.concat(F.lit("^"), word), F.lit(3))


def word_stumps(rows: DataFrame, last: DataFrame) -> DataFrame:
    """``(word)``: those values of ``last(word)`` that are words cut short.

    A stump stands nowhere in the ``body`` of ``rows`` but at open ends, is a strict prefix of
    another word, and ends in three letters (or its beginning) with which few words end. Open ends
    do not count as known words, so another text cut at the same letters hides nothing.
    """
    # the words are a column of their own, so that the generator does not make them again
    said = rows.select(_words(F.col("body")).alias("w"), _closed(F.col("body")).alias("whole"))
    sure = F.when(F.col("whole"), F.col("w")).otherwise(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))
    known = materialise(said.select(F.explode(sure).alias("word")).where("word <> ''").distinct())
    fresh = materialise(last.where("word <> ''").distinct().join(known, "word", "left_anti"))
    longer = strict_prefixes(known.union(fresh), "word").select(F.col("value").alias("word"))
    padded = F.concat(F.lit("^"), F.col("word"))
    n = F.greatest(F.length("word") - 1, F.lit(1))
    threes = known.select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(padded, i, F.lit(3)).alias("ending"), (i == n).alias("final")))).alias("x"))
    shares = threes.groupBy("x.ending").agg(F.avg(F.col("x.final").cast("int")).alias("share"))
    found = fresh.join(longer, "word", "left_semi").withColumn("ending", _ending(F.col("word"))).join(shares, "ending", "left")
    return found.where(F.coalesce("share", F.lit(0.0)) < USUAL_ENDING).select("word")


def _form(kind: Column, body: Column) -> Column:
    """``verse``, ``list``, ``letter`` or ``prose``; by shape where the kind is missing, and
    ``unknown`` if the shape leaves prose and letter open."""
    lines = F.split(body, "\n+")
    listed = F.size(F.filter(lines, lambda x: x.rlike(r"^[^:]{1,60}: \S")))
    closed = F.size(F.filter(lines, _closed))
    shape = F.when((F.size(lines) >= 2) & (listed * 3 >= F.size(lines) * 2), "list").when((F.size(lines) >= 2) & (closed * 4 <= F.size(lines)), "verse").otherwise("prose")
    return F.when(kind == "glossary", "list").when(kind == "verse", "verse").when(kind == "letter", "letter").when(kind.isNotNull() | (shape != "prose"), F.when(kind.isNotNull(), "prose").otherwise(shape)).otherwise("unknown")


def truncations(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, form, evidence)`` for each text that was cut short.

    ``evidence`` is one of ``mark`` (open before a cut mark), ``prefix`` (open, and continued in
    another text), ``closing`` (ends in the beginning of a usual closing line), ``open`` (prose
    without closing sign), ``limit`` (verse or list at a field limit of its source, within a
    line; a whole poem of exactly that length cannot be told apart and counts too) and ``word``
    (verse or list that stops inside a word, see :func:`word_stumps`). Not found without another
    sign: verse and lists cut between two words, or where the rest of the word is a word or ends
    like one. Null, empty and blank texts are no case; repeated rows each come out; ties and extra
    columns change nothing; an empty table gives an empty result.
    """
    body = _body(F.col("text"))
    stripped = strip_blanks(F.col("text"))
    rows = documents.where(stripped != "").select(
        "doc_id", "source", "kind", (_may_be_marked(stripped) & stripped.rlike(CUT_MARK)).alias("marked"), body.alias("body"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")
    )
    lines = F.split("body", "\n+")
    lengths = F.transform(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.length)
    rows = rows.withColumn("form", _form(F.col("kind"), F.col("body")))
    letter = F.col("form").isin("letter", "unknown") & (F.size(lines) >= 2)
    judged = rows.select(
        "doc_id", "source", "marked", "chars", "bytes", "form",
        (~_closed(F.col("body"))).alias("open"), F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"),
        F.when(letter, F.regexp_replace(F.element_at(lines, -1), r"[.?!]+$", "")).alias("bare"),
        F.length(F.element_at(lines, -1)).alias("last_len"), F.array_min(lengths).alias("least_len"), "body",
    )
    may_stop = F.col("form").isin("verse", "list") & F.col("open")
    judged = materialise(judged.withColumn("word", F.when(may_stop, F.element_at(_words(F.col("body")), -1))).drop("body"))
    # 1. strict prefixes of longer texts
    prefixes = strict_prefixes(rows, "body").where(F.col("after") != "\n").select(F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2")).distinct().withColumn("is_prefix", F.lit(True))
    # 2. usual closing lines of letters, and their strict beginnings: each closing line is that of a
    # share of the texts, so at most 1 / USUAL_CLOSING are often; they come as one array
    closings = judged.where((F.col("form") == "letter") & F.col("bare").isNotNull()).groupBy("bare").agg(F.countDistinct("h1", "h2").alias("n"))
    every = closings.agg(F.sum("n")).scalar()
    often = closings.where(F.col("n") >= every * USUAL_CLOSING).agg(F.collect_list(F.struct("bare", "n"))).scalar()
    limits = field_limits(judged).withColumn("limit", F.lit(True))
    chars = limits.where("measure = 'chars'").select("source", F.col("length").alias("chars"), F.col("limit").alias("at_chars"))
    octets = limits.where("measure = 'bytes'").select("source", F.col("length").alias("bytes"), F.col("limit").alias("at_bytes"))
    # 3. last words that are cut
    stumps = word_stumps(rows, judged.where(F.col("word").isNotNull()).select("word")).withColumn("is_stump", F.lit(True))
    known = (
        judged.withColumn("often", F.when(F.col("bare").isNotNull(), often))
        .join(prefixes, ["h1", "h2"], "left")
        .join(chars, ["source", "chars"], "left")
        .join(octets, ["source", "bytes"], "left")
        .join(stumps, "word", "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    short = F.col("last_len") < F.col("least_len")
    goes_on = lambda c: c["bare"].startswith(F.col("bare")) & (c["bare"] != F.col("bare"))
    times = F.coalesce(F.array_max(F.transform(F.filter("often", lambda c: c["bare"] == F.col("bare")), lambda c: c["n"])), F.lit(0))
    # a line that is the beginning of a more frequent one is no usual closing itself
    usual = F.coalesce((times > 0) & ~F.exists("often", lambda c: goes_on(c) & (c["n"] > times)), F.lit(False))
    begun = F.coalesce((F.col("bare") != "") & F.exists("often", goes_on) & ~usual, F.lit(False))
    evidence = (
        F.when(begun, "closing")
        .when(F.col("marked") & F.col("open"), "mark")
        .when(yes("is_prefix") & F.col("open"), "prefix")
        .when(F.col("form").isin("prose", "letter", "unknown") & F.col("open") & ~usual, "open")
        .when((F.col("form") == "verse") & F.col("open") & (yes("at_chars") | yes("at_bytes")), "limit")
        .when((F.col("form") == "list") & F.col("open") & (yes("at_chars") | yes("at_bytes")) & short, "limit")
        .when(may_stop & yes("is_stump"), "word")
    )
    return known.withColumn("evidence", evidence).where(F.col("evidence").isNotNull()).select("doc_id", "source", "form", "evidence")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """``(source, n_documents, n_cut, rate)``; documents without text count as not cut."""
    cut = truncations(documents).groupBy("source").agg(F.count("*").alias("n_cut"))
    total = documents.groupBy("source").agg(F.count("*").alias("n_documents"))
    n = F.coalesce("n_cut", F.lit(0))
    return total.join(cut, total["source"].eqNullSafe(cut["source"]), "left").select(total["source"], "n_documents", n.alias("n_cut"), (n / F.col("n_documents")).alias("rate"))
