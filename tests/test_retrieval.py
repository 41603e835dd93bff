from pyspark.sql import functions as F

from scriptorium.functions.text import words
from scriptorium.operators import gate, retrieval

LOC = "loc_id bigint, work_id bigint, tok_offset bigint, ref string, leaf int, text string"
WORKS = "id bigint, key string, author string, title string, unit string, source string"
NOTE = "id bigint, author string, work string, language string, ref string, line_start int, line_end int, lemma string, text string"
LINES = ["arma virumque cano Troiae qui", "primus ab oris Italiam fato profugus", "Laviniaque venit litora multum ille", "et terris iactatus et alto"]


def library(spark):
    """Two works that hold the same lines; the second belongs to another source."""
    units = spark.createDataFrame([(w, k, LINES[k]) for w in (1, 2) for k in range(4)] + [(3, 0, "quis quid ubi cur quando"), (4, 0, "quis quid ubi cur quando")], "work_id bigint, seq int, text string")
    loc = retrieval.unit_offsets(units, "work_id", "seq", "text").select(F.monotonically_increasing_id().alias("loc_id"), "work_id", "tok_offset", F.lit("1").alias("ref"), (F.col("seq") + 1).alias("leaf"), "text")
    shingle = retrieval.shingle_rows(retrieval.work_streams(units, "work_id", "seq", "text"), "work_id", "words")
    works = spark.createDataFrame([(1, "v.a", "Vates", "Vates: Arma", "line", "main"), (2, "x/a.txt", "Vates", "arma", "line", "other"), (3, "q.a", "Q", "Quid", "line", "main"), (4, "q.b", "Q", "Quod", "line", "main")], WORKS)
    return shingle, loc, works


def test_hash_of_known_words(spark):
    s = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, ["a"]), (3, [])], "k int, w array<string>")
    h = 1469598103934665603
    for b in b"a b c d e ":
        h = ((h ^ b) * 1099511628211) % 2**64
    assert [tuple(r) for r in retrieval.shingle_rows(s, "k", "w").collect()] == [(h % 2**63, 1, 0)]


def test_identify(spark):
    shingle, loc, works = library(spark)
    texts = spark.createDataFrame(
        [(1, "Ārma uirumque cano, TROIAE qui primus ab oris Italiam"), (2, "venit litora multum ille et"), (3, "nothing of the kind is here at all"), (4, "arma virumque"), (5, None), (6, ""), (7, "quis quid ubi cur quando")], "k int, t string"
    )
    got = {r.k: r for r in retrieval.identify(texts, "k", "t", shingle.union(shingle), loc, works, "main").collect()}
    assert set(got) == {1, 2}  # 7 stands in two works of one source
    assert (got[1].work, got[1].line_start, got[1].line_end, got[1].confidence, got[1].citation) == ("v.a", 1, 2, 1.0, "Vates, Arma 1.1-2")
    assert (got[2].work, got[2].line_start, got[2].line_end, got[2].matched) == ("v.a", 3, 4, 1)


def test_as_of_over_blocks(spark):
    units = spark.createDataFrame([(1, 5, "1", 1), (1, 3000, "1", 2), (1, 2_000_000, "2", 1), (2, 0, "1", 1)], "work_id bigint, tok_offset bigint, ref string, leaf int")
    q = spark.createDataFrame([("a", 1, 4), ("b", 1, 5), ("c", 1, 2999), ("d", 1, 3001), ("e", 1, 1_999_999), ("f", 1, 9_000_000), ("g", 3, 1), ("h", 2, 7)], "q string, work_id bigint, at bigint")
    got = {r.q: (r.unit.ref, r.unit.leaf) for r in retrieval.as_of(q, units, "q", "at").collect()}
    assert got == {"b": ("1", 1), "c": ("1", 1), "d": ("1", 2), "e": ("1", 2), "f": ("2", 1), "h": ("1", 1)}


def notes(spark):
    rows = [(1, "A", "w", "la", "1", 1, 7, "arma", "x"), (2, "A", "w", "en", "1", 3, None, "cano", "y"), (3, "B", "w", "en", "1", None, None, None, "all"), (4, "A", "w", "la", "1", 3, 3, "", "z"), (5, "A", "w", "la", "2", 3, 3, "arma", "q"), (6, "A", "w", "la", "1", 1, 7, "arma", "x")]
    return spark.createDataFrame(rows, NOTE)


def test_notes_for(spark):
    r = spark.createDataFrame([(1, "w", "1", 3), (2, "w", "1", 9), (3, None, "1", 3)], "request int, work string, ref string, line int")
    got = [(x.request, x.id) for x in retrieval.notes_for(r, notes(spark)).orderBy("request", "rank").collect()]
    assert got == [(1, 1), (1, 6), (1, 2), (1, 4), (1, 3), (2, 3)]
    assert retrieval.notes_for(r, notes(spark), limit=2).count() == 3
    with_lemma = r.withColumn("lemma", F.lit("cano"))
    assert [x.id for x in retrieval.notes_for(with_lemma, notes(spark), lemma=True).collect()] == [2]


def test_commentary_once_at_first_line(spark):
    s = spark.createDataFrame([(1, "w", "1", 1, 40), (2, "w", "1", 5, 4)], "request int, work string, ref string, first int, last int")
    got = sorted((x.line, x.id) for x in retrieval.commentary_for(s, notes(spark)).collect())
    assert got == [(1, 1), (1, 3), (3, 2), (3, 4)]


def test_canonical_lines_and_coverage(spark):
    _, loc, works = library(spark)
    r = spark.createDataFrame([(1, "v.a", "1", 2, 3), (2, "none", "1", 1, 9)], "request int, work string, ref string, first int, last int")
    assert sorted(x.line for x in retrieval.canonical_lines(r, loc, works).collect()) == [2, 3]
    n = spark.createDataFrame([(1, "A", "v.a", "la", "1", 2, None, "", "")], NOTE)
    row = [x for x in retrieval.coverage(loc.where("leaf <> 3"), works, n).collect() if x.work == "v.a"][0]
    assert (row.n_required, row.n_present, row.n_noted, row.present, row.gaps) == (4, 3, 1, 75.0, 1)


def test_gate(spark):
    known = spark.createDataFrame([(w,) for line in LINES for w in ("arma uirumque cano troiae qui et in est non ad").split()], "word string")
    t = spark.createDataFrame([(1, "arma virumque cano ad arma troiae"), (2, "the cat is on the mat and it was not for you"), (3, "arma xx yy zz"), (4, ""), (5, None), (6, "arma cano Troiae et xx non est qui")], "k int, t string")
    rates = gate.analysable(t, "k", "t", known)
    got = {r.k: r for r in gate.assess(rates, gate.language_scores(t, "k", "t"), "k").collect()}
    assert got[1].is_latin and got[1].message == "" and got[1].latin == 1.0
    assert not got[2].is_latin and got[2].competitor == "en" and got[2].message == "another language"
    assert not got[3].is_latin and got[3].latin is None and got[3].message == "too few words are known"
    assert not got[4].is_latin and got[4].message == "no words" and got[5].confidence == 0.0
    assert got[6].is_latin and got[6].message == ""
    assert [(r.position, r.word) for r in gate.unrecognised(t, "k", "t", known).where("k = 3").orderBy("position").collect()] == [(1, "xx"), (2, "yy"), (3, "zz")]


def test_empty_tables(spark):
    shingle, loc, works = library(spark)
    none = spark.createDataFrame([], "k int, t string")
    assert retrieval.identify(none, "k", "t", shingle, loc, works, "main").count() == 0
    assert retrieval.identify(spark.createDataFrame([(1, LINES[0])], "k int, t string"), "k", "t", shingle.limit(0), loc.limit(0), works.limit(0), "main").count() == 0
    assert words(F.lit(None)) is not None


def test_streams_in_blocks(spark, monkeypatch):
    """Small blocks give the same offsets and runs as whole works."""
    rows = [(w, k, " ".join(f"w{'abcdefghik'[(w * k + j) % 10]}{'xyz'[k % 3]}" for j in range(n))) for w in (1, 2) for k, n in enumerate([3, 0, 7, 1, 1, 12, 2, 0, 4, 30, 1])]
    units = spark.createDataFrame(rows, "work_id bigint, seq int, text string")
    whole = {w: [x for v, _, t in rows if v == w for x in t.split()] for w in (1, 2)}
    monkeypatch.setattr(retrieval, "UNIT_BLOCK", 2)
    monkeypatch.setattr(retrieval, "STREAM_BLOCK", 8)
    at = {(r.work_id, r.seq): r.tok_offset for r in retrieval.unit_offsets(units, "work_id", "seq", "text").collect()}
    assert at == {(w, k): sum(len(t.split()) for v, q, t in rows if v == w and q < k) for w, k, _ in rows}
    streams = spark.createDataFrame(list(whole.items()), "work_id bigint, w array<string>")
    one = sorted(map(tuple, retrieval.shingle_rows(streams.withColumn("base", F.lit(None).cast("bigint")), "work_id", "w").collect()))
    blocks = retrieval.work_streams(units, "work_id", "seq", "text")
    assert max(len(r.words) for r in blocks.collect()) <= 12
    # the batches run in worker processes, where the block is as the package has it: take the runs here
    got = sorted((r.work_id, r.base + i, tuple(r.words[i : i + 5])) for r in blocks.collect() for i in range(min(8, len(r.words) - 4)))
    assert got == sorted((w, i, tuple(s[i : i + 5])) for w, s in whole.items() for i in range(len(s) - 4)) and len(one) == len(got)


def test_covering(spark):
    from scriptorium.operators.ranges import covering

    points = spark.createDataFrame([("a", k) for k in (0, 1, 63, 64, 65, 5000, 10**6)] + [(None, 1), ("b", 7), ("a", None)], "k string, at int")
    ranges = spark.createDataFrame([(1, "a", 1, 64), (2, "a", 0, 10**7), (3, "a", 9, 3), (4, "a", 65, 65), (5, "c", 0, 9), (6, "a", None, 5), (7, "b", -70, 7)], "id int, k string, x int, y int")
    got = sorted((r.id, r.at) for r in covering(points, "at", ranges, "x", "y", ["k"]).collect())
    assert got == [(1, 1), (1, 63), (1, 64), *((2, k) for k in (0, 1, 63, 64, 65, 5000, 10**6)), (4, 65), (7, 7)]
