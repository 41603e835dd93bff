"""Named queries of the core, and the SQL that an independent engine answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.refs import plain_ref
from ..operators.constructions import CAVEATS, CLAUSE_CAVEAT, catalogue, constructions, explained, family_findings, token_tags
from ..operators.figures import GROUPS, anaphora, figures
from ..operators.intervals import periods_and_gaps
from ..operators.rules import FAMILIES
from ..session import spread
from ..sources.surrogate import annotate
from . import grammar_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "note").select("source", "work", plain_ref(F.col("ref")).alias("ref"), "line_start", "line_end")
    return periods_and_gaps(notes, ["source", "work", "ref"], "line_start", "line_end")


# plain reference of a citation path: Roman numerals are spelt out additively and their letters counted
PLAIN_REF_SQL = """array_to_string(list_transform(list_filter(string_split_regex(regexp_replace({ref}, '[[:space:].,:;]+', '.', 'g'), '[.]'), lambda p: p <> ''),
  lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN regexp_replace(p, '^0+([0-9])', '\\1')
    WHEN regexp_full_match(p, '(?i)[ivxlcdm]+') THEN CAST(list_sum(list_transform(string_split(replace(replace(replace(replace(replace(replace(upper(p), 'CM', 'DCCCC'), 'CD', 'CCCC'), 'XC', 'LXXXX'), 'XL', 'XXXX'), 'IX', 'VIIII'), 'IV', 'IIII'), ''),
      lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END))::BIGINT AS VARCHAR)
    ELSE p END), '.')"""

P3_SQL = f"""
WITH n AS (SELECT source, work, {PLAIN_REF_SQL.format(ref="ref")} AS ref, least(line_start, coalesce(line_end, line_start)) AS a, greatest(line_start, coalesce(line_end, line_start)) AS b
           FROM note WHERE line_start IS NOT NULL),
u AS (SELECT DISTINCT source, work, ref, unnest(range(a, b + 1)) AS line FROM n),
g AS (SELECT source, work, ref, line, line - row_number() OVER (PARTITION BY source, work, ref ORDER BY line) AS k FROM u),
p AS (SELECT source, work, ref, min(line) AS a, max(line) AS b FROM g GROUP BY source, work, ref, k),
l AS (SELECT *, lead(a) OVER (PARTITION BY source, work, ref ORDER BY a) AS nxt FROM p)
SELECT source, work, ref, 'period' AS kind, a::BIGINT AS line_first, b::BIGINT AS line_last FROM l
UNION ALL SELECT source, work, ref, 'gap', (b + 1)::BIGINT, (nxt - 1)::BIGINT FROM l WHERE nxt IS NOT NULL
"""


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in tokens of every loc row (see :mod:`surrogate`)."""
    lines = table(spark, sf_dir, "loc").select("work_id", "loc_id", "text").where(F.col("text").isNotNull())
    return annotate(spread(lines), "work_id", "loc_id", "text")


def _family(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: family_findings(tokens_of(spark, sf_dir), [name])


def constructions_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constructions(tokens_of(spark, sf_dir))
    return found.groupBy("key").agg(F.count("*").alias("n"))


def construction_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tags(constructions(tokens_of(spark, sf_dir)))


def construction_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark)


def findings_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokens_of(spark, sf_dir)
    got = explained(constructions(tokens), tokens)
    return got.select("doc_id", "sent_id", "key", "anchor", "tokens", "name", "reference", "words", "label", "strength", "evidence", "caveat")


def _figures(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: figures(tokens_of(spark, sf_dir), [name])


def figures_anaphora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anaphora(tokens_of(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"p3_found": p3_found}
    out |= {f"findings_{name}": _family(name) for name in FAMILIES}
    out |= {f.__name__: f for f in (constructions_counts, construction_tags, construction_catalogue, figures_anaphora, findings_explained)}
    out |= {f"figures_{name}": _figures(name) for name in GROUPS}
    return out


def oracle_sql() -> dict[str, str]:
    out = {"p3_found": P3_SQL}
    out |= {f"findings_{name}": grammar_sql.findings_sql([name]) for name in FAMILIES}
    rows = [(*r, f) for f, t in (("construction", L.CONSTRUCTIONS), ("case use", L.CASE_USES), ("clause", L.CLAUSES)) for r in L.catalogue_rows(t)] + [(r[0], r[1], "", "figure") for r in L.catalogue_rows(L.DEVICES)]
    values = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    quoted = {k: v.replace("'", "''") for k, v in CAVEATS.items()}
    by_key = " ".join(f"WHEN kept.key = '{k.split('|')[0]}'" + (f" AND kept.label = '{k.split('|')[1]}'" if "|" in k else "") + f" THEN '{v}'" for k, v in quoted.items())
    caveats = f"CASE {by_key} WHEN cx.family = 'clause' THEN '{CLAUSE_CAVEAT}' ELSE '' END"
    out["construction_catalogue"] = f"SELECT * FROM (VALUES {values}) t(key, name, reference, family)"
    out["findings_explained"] = (
        grammar_sql.all_sql()
        + f""", kept AS (SELECT *, {grammar_sql.LABELS} AS label FROM {grammar_sql.KEPT.replace(') kept', ') f')}), cx AS (SELECT * FROM (VALUES {values}) t(key, name, reference, family)), u AS (SELECT DISTINCT doc_id, sent_id, key, tokens FROM kept),
    ex AS (SELECT u.*, unnest(string_split(tokens, ','))::INT AS i, unnest(range(len(string_split(tokens, ',')))) AS k FROM u),
    sx AS (SELECT ex.doc_id, ex.sent_id, ex.key, ex.tokens, string_agg(tok.text, ' ' ORDER BY ex.k) AS words FROM ex JOIN tok ON tok.doc_id = ex.doc_id AND tok.sent_id = ex.sent_id AND tok.i = ex.i GROUP BY ALL)
    SELECT kept.doc_id, kept.sent_id, kept.key, kept.anchor, kept.tokens, cx.name, cx.reference, sx.words, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'moderate' ELSE 'tentative' END AS strength, kept.label, {caveats} AS caveat,
      chr(39) || sx.words || chr(39) || ': ' || cx.name || CASE WHEN cx.reference = '' THEN '' ELSE ' (' || cx.reference || ')' END AS evidence FROM kept JOIN sx USING (doc_id, sent_id, key, tokens) JOIN cx USING (key)"""
    )
    out |= {"constructions_counts": grammar_sql.suppressed_sql(), "construction_tags": grammar_sql.tags_sql()}
    out |= {f"figures_{name}": grammar_sql.figures_sql(name) for name in GROUPS if name != "alliteration"} | {"figures_anaphora": grammar_sql.anaphora_sql()}
    return out
