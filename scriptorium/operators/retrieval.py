"""Passage index, identification of quoted passages, canonical lines and commentary look-up."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SHINGLE_WORDS, words
from ..session import map_batches, materialise
from .ranges import covering

# Start and factor of the 64-bit hash, and the bits that are kept.
HASH_START, HASH_FACTOR, HASH_BITS = 1469598103934665603, 1099511628211, 63
#: Shingles that must agree on one alignment; shorter excerpts must be unique instead.
LEAST_VOTES = 3
#: Offsets of a work are looked up in blocks of 2 to this power, so no work is gathered in one task.
SUPERBLOCK = 20
#: Units of a work that are summed together, and words of a work that make one stream.
UNIT_BLOCK, STREAM_BLOCK = 4096, 1 << 16


def unit_offsets(units: DataFrame, work: str, order: str, text: str) -> DataFrame:
    """The units plus ``n_words`` and ``tok_offset``: the words of the work before the unit.

    ``order`` is a number. Sums are taken within blocks of it and over the blocks' totals, so a work
    with a third of all rows is not sorted in one task. Null and wordless units have length 0 and
    share the offset of the next one.
    """
    w = units.withColumn("n_words", F.size(words(F.col(text)))).withColumn("__block", F.floor(F.col(order) / UNIT_BLOCK))
    totals = w.groupBy(F.col(work).alias("__work"), F.col("__block").alias("__b")).agg(F.sum("n_words").alias("__n"))
    earlier = Window.partitionBy("__work").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__work", "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(work, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("tok_offset", F.coalesce(F.sum("n_words").over(inside), F.lit(0)))
    full = w.join(base, w[work].eqNullSafe(F.col("__work")) & w["__block"].eqNullSafe(F.col("__b")))
    return full.withColumn("tok_offset", F.col("tok_offset") + F.col("__base")).drop("__block", "__work", "__b", "__base")


def work_streams(units: DataFrame, work: str, order: str, text: str) -> DataFrame:
    """``(work, base, words)``: the words of each work in order, in blocks of STREAM_BLOCK words from
    ``base`` on, each with the first words of the next block, so that no run of words is cut."""
    u = unit_offsets(units, work, order, text).where("n_words > 0").select(work, "tok_offset", "n_words", words(F.col(text)).alias("w"))
    start, end = F.col("tok_offset"), F.col("tok_offset") + F.col("n_words")
    reach = SHINGLE_WORDS - 1
    block = F.explode(F.sequence(F.greatest(F.floor((start - reach) / STREAM_BLOCK), F.lit(0)), F.floor((end - 1) / STREAM_BLOCK))).alias("block")
    p = u.select(work, "tok_offset", "n_words", "w", block).withColumn("base", F.col("block") * STREAM_BLOCK)
    lo = F.greatest(F.col("base") - start, F.lit(0))
    hi = F.least(F.col("base") + STREAM_BLOCK + reach - start, F.col("n_words"))
    p = p.select(work, "base", F.struct((start + lo).alias("at"), F.slice("w", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("w")).alias("piece"))
    return p.groupBy(work, "base").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["w"])).alias("words"))


def shingle_rows(streams: DataFrame, key: str, word_array: str, counted: bool = False) -> DataFrame:
    """``(hash, key, tok_offset)`` of each run of five words, with ``n``, the words of its stream, if
    ``counted``. Streams of fewer words give none.

    A column ``base``, where there is one, counts the words before the stream, and only runs that
    begin in the first STREAM_BLOCK words of such a stream are taken. The hash is the index's own
    63-bit one (over the bytes of the words, each with a blank behind), computed for all runs of a
    batch at once.
    """
    import pyarrow as pa

    base_column = F.col("base") if "base" in streams.columns else F.lit(None).cast("bigint")
    source = streams.select(F.col(key), F.array_join(F.col(word_array), " ").alias("stream"), base_column.cast("bigint").alias("base"))
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            owner, offset, begin, end, size, raw, base = [], [], [], [], [], [], 0
            for k, (s, before) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                b = np.frombuffer((s + " ").encode("ascii", "replace"), np.uint8) if s else np.zeros(0, np.uint8)
                stops = np.flatnonzero(b == 32) + 1  # behind each word's blank
                if len(stops) >= SHINGLE_WORDS:
                    starts = np.concatenate([[0], stops[:-1]])
                    n = len(stops) - SHINGLE_WORDS + 1
                    if before is not None:
                        n = min(n, STREAM_BLOCK)
                    owner.append(np.full(n, k))
                    size.append(np.full(n, len(stops), np.int64))
                    offset.append(np.arange(n) + (before or 0))
                    begin.append(starts[:n] + base)
                    end.append(stops[SHINGLE_WORDS - 1 : SHINGLE_WORDS - 1 + n] + base)
                raw.append(b)
                base += len(b)
            if not owner:
                continue
            data, at, stop = np.concatenate(raw), np.concatenate(begin), np.concatenate(end)
            h = np.full(len(at), HASH_START, np.uint64)
            live = np.arange(len(at))
            with np.errstate(over="ignore"):
                while len(live):
                    h[live] = (h[live] ^ data[at[live]]) * np.uint64(HASH_FACTOR)
                    at[live] += 1
                    live = live[at[live] < stop[live]]
            keys = batch.column(0).take(pa.array(np.concatenate(owner)))
            columns = [pa.array((h & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)), keys, pa.array(np.concatenate(offset).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(np.concatenate(size))] if counted else [])], names=names)

    names = ["hash", key, "tok_offset", *(["n"] if counted else [])]
    return map_batches(source, run, f"hash bigint, `{key}` {kind}, tok_offset bigint" + (", n bigint" if counted else ""))


def locate(positions: DataFrame, units: DataFrame) -> DataFrame:
    """``(work_id, at, unit)``: for each different ``positions(work_id, at)`` the unit of the work with
    the greatest offset not beyond ``at``; of units at one offset the last by (ref, leaf). Positions
    before all units are left out.

    Units and positions of a superblock of offsets lie in one window that runs along them and carries
    the last unit seen; what comes in from the superblocks before, one row for each, is added by a
    join. A superblock has no more positions than words, so no window grows with the data.
    """
    sb = lambda c: F.shiftright(c, SUPERBLOCK).alias("sb")
    none = "struct<tok_offset:bigint,ref:string,leaf:int>"
    u = units.where("tok_offset IS NOT NULL").select("work_id", sb("tok_offset"), F.col("tok_offset").alias("at"), F.struct(F.col("tok_offset").cast("bigint").alias("tok_offset"), "ref", F.col("leaf").cast("int").alias("leaf")).alias("unit"))
    q = positions.where("at IS NOT NULL").select("work_id", "at").distinct().select("work_id", sb("at"), "at", F.lit(None).cast(none).alias("unit"))
    every = u.unionByName(q).withColumn("asked", F.col("unit").isNull())
    along = Window.partitionBy("work_id", "sb").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = every.withColumn("unit", F.max("unit").over(along)).where("asked").select("work_id", "sb", "at", "unit")
    before = Window.partitionBy("work_id").orderBy("sb").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.groupBy("work_id", "sb").agg(F.max("unit").alias("unit")).select("work_id", "sb", F.max("unit").over(before).alias("carried"))
    return here.join(carried, ["work_id", "sb"]).select("work_id", "at", F.coalesce("unit", "carried").alias("unit")).where("unit IS NOT NULL")


def as_of(queries: DataFrame, units: DataFrame, query: str, at: str) -> DataFrame:
    """``(query, unit)``: the unit of :func:`locate` for each query row with ``work_id`` and ``at``."""
    q = queries.select(F.col(query), "work_id", F.col(at).alias("at"))
    return q.join(locate(q, units), ["work_id", "at"]).select(query, "unit")


def _title(author: Column, title: Column) -> Column:
    """The title without a leading author name; titles that are nothing else stay."""
    t = F.trim(F.when(F.lower(F.left(title, F.length(author))) == F.lower(author), F.regexp_replace(F.substring(title, F.length(author) + 1, F.length(title)), r"^\s*[:,]\s*", "")).otherwise(title))
    return F.when((F.length(title) == F.length(author)) | (t == "") | author.isNull(), title).otherwise(t)


def identify(texts: DataFrame, key: str, text: str, shingle: DataFrame, loc: DataFrame, works: DataFrame, main_source: str, least_votes: int = LEAST_VOTES) -> DataFrame:
    """One row for each text that is confidently a passage of one work.

    ``key, work, author, title, unit, ref, ref_end, line_start, line_end, confidence, matched,
    possible, citation``. Each of the text's runs of five words votes for the alignment (work,
    offset of the text's first word). Most votes win, then the main source, then the smaller work
    id, earlier first hit, earlier offset. Texts of fewer than ``least_votes`` runs are accepted
    only without a rival of equal votes in the winner's source; others need ``least_votes`` votes.
    Null, empty and short texts have no row. Repeated index rows count once.
    """
    w = texts.select(F.col(key), words(F.col(text)).alias("__w")).where(F.size("__w") >= SHINGLE_WORDS)
    # each run of words brings the length of its text along, so that texts are split into words once
    query = shingle_rows(w, key, "__w", counted=True).withColumnRenamed("tok_offset", "i")
    index = shingle.select("hash", "work_id", "tok_offset").distinct()
    votes = query.join(index, "hash").groupBy(key, "work_id", (F.col("tok_offset") - F.col("i")).alias("base")).agg(F.count("*").alias("votes"), F.min("i").alias("first"), F.max("n").alias("n"))
    src = works.select(F.col("id").alias("work_id"), F.coalesce("source", F.lit(main_source)).alias("source"))
    ranked = votes.join(src, "work_id", "left").withColumn("source", F.coalesce("source", F.lit(main_source))).withColumn("main", F.col("source") == main_source)
    order = F.struct("votes", "main", (-F.col("work_id")).alias("w"), (-F.col("first")).alias("f"), (-F.col("base")).alias("b"), "n")
    # counted per (votes, source) before the winner is picked: no alignment list is gathered
    peers = ranked.groupBy(key, "votes", "source").agg(F.count("*").alias("peers"), F.max(order).alias("best"))
    win = peers.groupBy(key).agg(F.max(F.struct("best", "peers", "source")).alias("x"))
    n = F.col("x.best.n")
    win = win.select(key, (-F.col("x.best.w")).alias("work_id"), (-F.col("x.best.b")).alias("base"), F.col("x.best.votes").alias("matched"), (F.col("x.peers") - 1).alias("rivals"), n.alias("n"), (n - SHINGLE_WORDS + 1).alias("possible"))
    # written once: the look-up of both ends and the rest of the row read it
    good = materialise(win.where(F.when(F.col("possible") < least_votes, F.col("rivals") == 0).otherwise(F.col("matched") >= least_votes)))
    ends = good.select(key, "work_id", F.explode(F.array(F.struct("base", F.lit(True).alias("first")), F.struct((F.col("base") + F.col("n") - 1).alias("base"), F.lit(False).alias("first")))).alias("x")).select(key, "work_id", F.col("x.base").alias("at"), "x.first")
    found = ends.join(locate(ends, loc), ["work_id", "at"]).groupBy(key).agg(F.max(F.when(F.col("first"), F.col("unit"))).alias("s"), F.max(F.when(~F.col("first"), F.col("unit"))).alias("e"))
    meta = works.select(F.col("id").alias("work_id"), F.col("key").alias("work"), "author", "title", "unit")
    full = good.join(found.where("s IS NOT NULL"), key).join(meta, "work_id")
    same = F.col("e.ref").eqNullSafe(F.col("s.ref"))
    where = F.when(F.coalesce(F.col("s.ref"), F.lit("")) == "", F.concat(F.lit("line "), F.col("s.leaf"))).otherwise(F.concat_ws(".", "s.ref", "s.leaf"))
    where = F.concat(where, F.when(same & (F.col("e.leaf") != F.col("s.leaf")), F.concat(F.lit("-"), F.col("e.leaf"))).otherwise(""))
    return full.select(
        key, "work", "author", "title", "unit", F.col("s.ref").alias("ref"), F.coalesce("e.ref", "s.ref").alias("ref_end"), F.col("s.leaf").alias("line_start"), F.coalesce("e.leaf", "s.leaf").alias("line_end"),
        F.least(F.lit(1.0), F.bround(F.col("matched") / F.col("possible"), 3)).alias("confidence"), "matched", F.col("possible").cast("bigint").alias("possible"),
        F.concat(F.coalesce(F.concat("author", F.lit(", ")), F.lit("")), _title(F.col("author"), F.col("title")), F.lit(" "), where).alias("citation"),
    )


def canonical_lines(requests: DataFrame, loc: DataFrame, works: DataFrame) -> DataFrame:
    """``requests(request, work, ref, first, last)`` -> ``(request, line, text)`` in the edition cited.

    Both ends are included. Requests with a null part, or of an unknown work, have no line.
    """
    lines = loc.join(works.select(F.col("id").alias("work_id"), F.col("key").alias("work")), "work_id").select("work", "ref", F.col("leaf").alias("line"), "text")
    return covering(lines, "line", requests.select("request", "work", "ref", "first", "last"), "first", "last", ["work", "ref"]).select("request", "line", "text")


def notes_for(requests: DataFrame, notes: DataFrame, limit: int = 12, lemma: bool = False) -> DataFrame:
    """Commentary on single lines: ``requests(request, work, ref, line[, lemma])`` -> the notes with
    ``rank`` 1..limit: those with a lemma first, Latin before others, by first line, then id.

    A note covers its lines from ``line_start`` to ``line_end`` (one line if that is missing); a
    note without lines covers all of its ref. Of the latter only the first ``limit`` of a ref can be
    among a line's best, so the others are dropped before they meet every line.
    """
    order = [F.when(F.coalesce("lemma", F.lit("")) != "", 0).otherwise(1), F.when(F.col("language") == "la", 0).otherwise(1), F.col("line_start").asc_nulls_first(), F.col("id")]
    n = notes.select("work", "ref", "id", "author", "language", "line_start", "line_end", "lemma", "text")
    keys = ["work", "ref"] + (["lemma"] if lemma else [])
    general = n.where(F.col("line_start").isNull()).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= limit).drop("k")
    ranged = n.where(F.col("line_start").isNotNull())
    r = requests.select("request", "work", "ref", "line", *(["lemma"] if lemma else []))
    ranged = ranged.withColumn("__last", F.coalesce("line_end", "line_start"))
    found = r.join(general, keys).unionByName(covering(r, "line", ranged, "line_start", "__last", keys).drop("__last"))
    best = Window.partitionBy("request", "line").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def commentary_for(spans: DataFrame, notes: DataFrame, most_lines: int = 25, per_line: int = 8) -> DataFrame:
    """``spans(request, work, ref, first, last)`` -> the notes on up to ``most_lines`` lines, up to
    ``per_line`` each, every (author, lemma, first 60 characters) once, at its first line.

    A passage over several refs is several spans of one request. Spans with a null end, or whose
    end lies before its start, give nothing.
    """
    lines = spans.where(F.col("first") <= F.col("last")).select("request", "work", "ref", F.explode(F.sequence("first", F.least("last", F.col("first") + most_lines - 1))).alias("line"))
    got = notes_for(lines, notes, per_line)
    once = Window.partitionBy("request", "author", "lemma", F.left("text", F.lit(60))).orderBy("line", "rank", "id")
    return got.withColumn("k", F.row_number().over(once)).where(F.col("k") == 1).drop("k")


def coverage(loc: DataFrame, works: DataFrame, notes: DataFrame) -> DataFrame:
    """``(work, ref, n_required, n_present, n_noted, present, noted, gaps)``: of lines 1 to the last,
    how many a ref has, how many a note covers, in percent, and how many are missing."""
    lines = loc.join(works.select(F.col("id").alias("work_id"), F.col("key").alias("work")), "work_id").where(F.col("leaf").isNotNull()).select("work", "ref", F.col("leaf").alias("line")).distinct()
    refs = lines.groupBy("work", "ref").agg(F.max("line").cast("bigint").alias("n_required"), F.count("*").alias("n_present"))
    spans = notes.where(F.col("line_start").isNotNull()).select("work", "ref", F.col("line_start").alias("a"), F.coalesce("line_end", "line_start").alias("b")).distinct()
    noted = covering(lines, "line", spans, "a", "b", ["work", "ref"]).select("work", "ref", "line").distinct().groupBy("work", "ref").agg(F.count("*").alias("n_noted"))
    full = refs.join(noted, ["work", "ref"], "left").withColumn("n_noted", F.coalesce("n_noted", F.lit(0)))
    pct = lambda c: F.bround(100.0 * F.col(c) / F.col("n_required"), 1)
    return full.select("work", "ref", "n_required", "n_present", "n_noted", pct("n_present").alias("present"), pct("n_noted").alias("noted"), (F.col("n_required") - F.col("n_present")).alias("gaps"))
