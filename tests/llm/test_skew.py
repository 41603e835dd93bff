"""One key, place or text in a third or more of all rows: results stay whole and no pairs are formed."""

import datetime as dt
import random

from pyspark.sql import functions as F

from scriptorium.llm import shared_spans, survivor, tokenise, truncation, visual


def test_one_stretch_in_many_works(spark):
    many = spark.range(3000).select(F.col("id").alias("work_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tok_offset")).withColumn("hash", F.col("tok_offset") * 7)
    rest = spark.range(6000).selectExpr("xxhash64(id) AS hash", "9999L AS work_id", "id AS tok_offset")
    df = many.select("hash", "work_id", F.col("tok_offset").cast("bigint").alias("tok_offset")).union(rest)
    got = shared_spans.shared_runs(df)
    assert got.count() == 3000 and [tuple(r) for r in got.select("tok_first", "tok_last").distinct().collect()] == [(0, 13)]


def test_one_place_loaded_often(spark):
    works = spark.createDataFrame([(1, "a.b", "s", "a", "b", "line")], "id bigint, key string, source string, author string, title string, unit string")
    sources = spark.createDataFrame([("s", "x", 5)], "source string, code string, trust int")
    at = dt.datetime(2024, 1, 1)
    loc = spark.range(9000).select(F.col("id").alias("loc_id"), F.lit(1).cast("bigint").alias("work_id"), F.lit(0).cast("bigint").alias("tok_offset"), F.lit("1").alias("ref"),
                                   F.when(F.col("id") < 6000, 1).otherwise(F.col("id")).cast("int").alias("leaf"), F.lit("text").alias("text"), (F.lit(at) + F.expr("make_dt_interval(0, 0, 0, id)")).cast("timestamp").alias("loaded_at"))
    assert [(r.loc_id, r.copies) for r in survivor.survivors(loc, works, sources).collect()] == [(5999, 6000)]


def test_one_text_in_many_rows(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'canο virum' ELSE concat('plain ', id) END AS t")
    got = visual.changed_values(df, "t")
    assert got.count() == 2500 and got.select("canonical").distinct().collect()[0][0] == "cano virum"
    docs = df.selectExpr("id AS doc_id", "t AS text", "'s' AS source", "'passage' AS kind")
    assert truncation.truncations(docs).count() == 5000  # all are open
    assert truncation.strict_prefixes(docs, "text").count() > 0
    assert tokenise.token_count(docs, "doc_id", "text").select("n_tokens").distinct().count() < 10


def test_one_poem_or_letter_in_many_rows(spark):
    """A repeated whole text makes no limit, hides none, and changes no usual closing line."""
    r = random.Random(5)
    line = lambda: " ".join("".join(r.choice("aeiormst") for _ in range(r.randrange(3, 9))) for _ in range(6))
    poem = lambda n: "\n".join(line() for _ in range(n))
    hot = next(t for t in iter(lambda: poem(10), None) if 392 <= len(t) <= 398)
    cut = [t[:400] for t in (poem(30) for _ in range(60))]
    rows = [(k, t, "paste", "verse") for k, t in enumerate([hot] * 400 + cut + [poem(r.randrange(2, 9)) for _ in range(300)])]
    rows += [(1000 + k, f"Bene vales. Nummer {'x' * k}.\nVale", "post", "letter") for k in range(12)]
    rows += [(2000 + k, "Bene vales.\nCura ut valeas amice carissime atque scribas.", "post", "letter") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, kind string")
    assert {x.doc_id for x in truncation.truncations(docs).collect()} == set(range(400, 460))
