"""The pN_ queries of the problems in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixture, near_duplicates, shared_spans, survivor, tokenise, truncation, visual
from ..plans.domain_queries import words_sql
from ..session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = _table(spark, sf_dir, "loc")
    return survivor.survivors(loc, _table(spark, sf_dir, "works"), _table(spark, sf_dir, "text_source")).select("loc_id")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors with what the editions together say of their work, field by field."""
    loc, works, sources = (_table(spark, sf_dir, n) for n in ("loc", "works", "text_source"))
    return survivor.survivors(loc, works, sources).join(survivor.work_records(works, sources), "identity", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_runs(_table(spark, sf_dir, "shingle"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_shares(_table(spark, sf_dir, "shingle")).withColumn("share", F.bround("share", 6))


def _all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc, note = _table(spark, sf_dir, "loc"), _table(spark, sf_dir, "note")
    fields = note.select(F.col("id").alias("row_id"), F.inline(F.array(F.struct(F.lit("text").alias("field"), F.col("text")), F.struct(F.lit("lemma").alias("field"), F.col("lemma").alias("text")))))
    return loc.select(F.lit("loc").alias("tbl"), F.col("loc_id").alias("row_id"), F.lit("text").alias("field"), "text").unionByName(fields.withColumn("tbl", F.lit("note")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.changed_values(_all_values(spark, sf_dir), "text").select("tbl", "row_id", "field")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.consistent_values(_all_values(spark, sf_dir), "text").select("tbl", "row_id", "field", "canonical")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(_table(spark, sf_dir, "note"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(_table(spark, sf_dir, "note"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(_table(spark, sf_dir, "loc"), "loc_id", "text")
    return pairs.select(F.col("record_a").alias("loc_id_a"), F.col("record_b").alias("loc_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(_table(spark, sf_dir, "loc"), "loc_id", "text")
    return groups.select(F.col("record").alias("loc_id"), F.col("class").alias("class_id"), "class_size", "links")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode_documents(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"))
    return chosen.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"))[1]


def p8_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mixture of as many tokens as all sources have, where the caps bind."""
    return mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"), "available")[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncations(_table(spark, sf_dir, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (p1_found, p1_survivors, p2_found, p2_shares, p4_found, p4_forms, p5_found, p5_segments, p6_found, p6_groups, p7_ids, p8_mix, p8_shares, p8_shares_full, p9_found, p9_rates)
    return {f.__name__: f for f in all_of}


# The shared runs by brute force on word positions: 12 consecutive words are the shingles at +0, +1 .. +7.
_RUNS = """
WITH s AS (SELECT DISTINCT work_id, tok_offset, hash FROM shingle WHERE hash IS NOT NULL),
w AS (SELECT a.work_id, a.tok_offset, a.hash AS h0, b.hash AS h5, c.hash AS h7
      FROM s a JOIN s b ON b.work_id = a.work_id AND b.tok_offset = a.tok_offset + 5
               JOIN s c ON c.work_id = a.work_id AND c.tok_offset = a.tok_offset + 7),
k AS (SELECT h0, h5, h7 FROM w GROUP BY ALL HAVING count(DISTINCT work_id) > 1),
o AS (SELECT DISTINCT w.work_id, w.tok_offset + i.i AS t FROM w JOIN k USING (h0, h5, h7), (SELECT unnest(range(12)) AS i) i),
g AS (SELECT work_id, t, t - row_number() OVER (PARTITION BY work_id ORDER BY t) AS n FROM o),
r AS (SELECT work_id, min(t)::BIGINT AS tok_first, max(t)::BIGINT AS tok_last FROM g GROUP BY work_id, n)
"""


# Survivors by plain ranking, from the wording of the task: these tables have no missing load times,
# so no precedence is needed. A place is the list of all numbers in ref and leaf; a leaf that ref
# repeats is told by the number of parts that most rows of the work have.
_NUMBERS = "list_filter(string_split_regex({ref}, '[^0-9A-Za-z]+'), lambda x: x <> '')"
_ARABIC = """list_transform({parts}, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::BIGINT ELSE
  list_sum(list_transform(regexp_extract_all(upper(x), 'CM|CD|XC|XL|IX|IV|[IVXLCDM]'), lambda r: CASE r WHEN 'CM' THEN 900 WHEN 'CD' THEN 400 WHEN 'XC' THEN 90 WHEN 'XL' THEN 40 WHEN 'IX' THEN 9 WHEN 'IV' THEN 4
    WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END))::BIGINT END)"""
_SURVIVORS = f"""
WITH k AS (SELECT w.id, s.trust, w.author, w.title, w.unit, translate(lower(trim(w.key)), 'vj', 'ui') AS name, s.code FROM works w LEFT JOIN text_source s USING (source)),
e AS (SELECT id, trust, author, title, unit, CASE WHEN starts_with(name, code || '.') OR starts_with(name, code || '/') OR starts_with(name, code || ':') THEN substr(name, length(code) + 2) ELSE name END AS name FROM k),
w AS (SELECT id, trust, author, title, unit, array_to_string(regexp_extract_all(regexp_replace(name, '[.]txt$', ''), '[a-z0-9]+'), '') AS identity FROM e),
l AS (SELECT loc_id, identity, trust, loaded_at, leaf, {_ARABIC.format(parts=_NUMBERS.format(ref="ref"))} AS nums, length(coalesce(trim(text, E' \\t\\n\\r'), '')) AS n FROM loc JOIN w ON w.id = loc.work_id WHERE ref IS NOT NULL),
u AS (SELECT identity, mode(len(nums)) AS usual FROM l WHERE leaf IS NOT NULL GROUP BY identity),
p AS (SELECT l.*, array_to_string(CASE WHEN leaf IS NULL OR (len(nums) > usual AND nums[-1] = leaf) THEN nums ELSE list_append(nums, leaf) END, '.') AS path FROM l JOIN u USING (identity) WHERE len(nums) > 0 AND (leaf IS NOT NULL OR len(nums) > usual)),
g AS (SELECT *, count(*) OVER (PARTITION BY identity, path) AS copies, max(n) OVER (PARTITION BY identity, path) AS longest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY identity, path ORDER BY trust DESC NULLS LAST, loaded_at DESC NULLS LAST, loc_id) AS k FROM g WHERE copies >= 2 AND n * 5 >= longest * 4),
best AS (SELECT identity, arg_max(trim(author), (trust, -id)) FILTER (trim(author) <> '') AS author, arg_max(trim(title), (trust, -id)) FILTER (trim(title) <> '') AS title, arg_max(trim(unit), (trust, -id)) FILTER (trim(unit) <> '') AS unit FROM w GROUP BY identity)
"""


def _one_form(column: str) -> str:
    """The consistent form of a text in the other engine: characters by translation, words of mixed
    scripts by their letters, and its own normal form for marks."""
    plain, _ = visual.decompositions()
    quote = lambda x: x.replace("'", "''")
    one = {a: b for a, b in plain.items() if len(b) == 1}
    gone = "".join(a for a, b in plain.items() if not b and a.isprintable() or unicodedata.category(a) in ("Cf", "Mn") and not b)
    t = f"translate({column}, '{quote(''.join(one) + gone)}', '{quote(''.join(one.values()))}')"
    for a, b in plain.items():
        if len(b) > 1 and unicodedata.decomposition(a).startswith(("<compat>", "<font>")):
            t = f"replace({t}, '{quote(a)}', '{quote(b)}')"
    twins = visual.look_alikes()
    others = r"\p{Greek}\p{Cyrillic}\p{Armenian}\p{Coptic}\p{Cherokee}\p{Lisu}"
    bare = r"regexp_replace(x, '\p{M}+', '', 'g')"
    back: dict[str, dict[str, str]] = {}
    for a, b in twins.items():
        back.setdefault(unicodedata.name(a).split()[0].capitalize(), {}).setdefault(b, a)
    ways = " ".join(
        f"WHEN regexp_matches({bare}, '\\p{{{script}}}') AND NOT regexp_matches(translate({bare}, '{''.join(m)}', ''), '\\p{{Latin}}') THEN translate(x, '{''.join(m)}', '{''.join(m.values())}')"
        for script, m in back.items() if script in ("Greek", "Cyrillic", "Armenian")
    )
    word = f"""CASE WHEN NOT (regexp_matches(x, '\\p{{Latin}}') AND regexp_matches(x, '[{others}]')) THEN x
      WHEN NOT regexp_matches(translate({bare}, '{''.join(twins)}', ''), '[{others}]') THEN translate(x, '{''.join(twins)}', '{''.join(twins.values())}') {ways} ELSE x END"""
    return f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda x: {word}), ''))"


_VALUES = "v AS (SELECT 'loc' AS tbl, loc_id AS row_id, 'text' AS field, text FROM loc UNION ALL SELECT 'note', id, 'text', text FROM note UNION ALL SELECT 'note', id, 'lemma', lemma FROM note)"


def _pairs_sql() -> str:
    """CTEs up to ``pr(a, b, same)``: pairs of records by brute force over the words they share."""
    return f"""WITH w AS (SELECT loc_id, list_sort({words_sql(_one_form('text'))}) AS ws FROM loc), r AS (SELECT * FROM w WHERE len(ws) >= 5),
    e AS (SELECT loc_id, x, count(*) AS c FROM (SELECT loc_id, unnest(ws) AS x FROM r) GROUP BY ALL),
    o AS (SELECT a.loc_id AS a, b.loc_id AS b, sum(least(a.c, b.c)) AS n FROM e a JOIN e b ON a.x = b.x AND a.loc_id < b.loc_id GROUP BY ALL),
    pr AS (SELECT o.a, o.b, ra.ws = rb.ws AS same FROM o JOIN r ra ON ra.loc_id = o.a JOIN r rb ON rb.loc_id = o.b WHERE o.n * 4 >= 3 * greatest(len(ra.ws), len(rb.ws)))
    """


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"WITH {_VALUES}, c AS (SELECT *, {_one_form('text')} AS canonical FROM v WHERE text IS NOT NULL) SELECT tbl, row_id, field FROM c WHERE canonical <> text",
        "p4_forms": f"WITH {_VALUES} SELECT tbl, row_id, field, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN '' ELSE {_one_form('text')} END AS canonical FROM v",
        "p6_found": _pairs_sql() + "SELECT a AS loc_id_a, b AS loc_id_b FROM pr",
        "p6_groups": _pairs_sql()
        + """, k AS (SELECT ws, min(loc_id) AS class_id, count(*) AS class_size FROM r GROUP BY ws), l AS (SELECT id, count(*) FILTER (WHERE NOT same) AS links FROM (SELECT a AS id, same FROM pr UNION ALL SELECT b, same FROM pr) GROUP BY id)
        SELECT r.loc_id, k.class_id, k.class_size, coalesce(l.links, 0)::BIGINT AS links FROM r JOIN k ON k.ws = r.ws LEFT JOIN l ON l.id = r.loc_id""",
        "p1_found": _SURVIVORS + "SELECT loc_id FROM r WHERE k = 1",
        "p1_survivors": _SURVIVORS + "SELECT loc_id, copies, identity, path, author, title, unit FROM r LEFT JOIN best USING (identity) WHERE k = 1",
        "p2_found": _RUNS + "SELECT * FROM r",
        "p2_shares": _RUNS
        + """, t AS (SELECT work_id, max(tok_offset) + 5 AS n_words FROM s GROUP BY work_id),
        x AS (SELECT work_id, sum(tok_last - tok_first + 1) AS n_shared, count(*) AS n_runs FROM r GROUP BY work_id)
        SELECT work_id, n_words::BIGINT AS n_words, coalesce(n_shared, 0)::BIGINT AS n_shared,
               CAST(round_even(CAST(coalesce(n_shared, 0)::DOUBLE / n_words AS DOUBLE), 6) AS DOUBLE) AS share, coalesce(n_runs, 0)::BIGINT AS n_runs
        FROM t LEFT JOIN x USING (work_id)""",
    }
