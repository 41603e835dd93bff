"""What a reader sees of a word or a line: dictionary entries, parses, findings, notes, feet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the dictionary's codes, and how many entries and parses are shown.
FREQUENCY = {"A": "very frequent", "B": "frequent", "C": "common", "D": "lesser used", "E": "uncommon", "F": "very rare", "I": "inscription", "N": "Pliny only"}
AGE = {"A": "archaic", "B": "early", "C": "classical", "D": "late", "E": "later", "F": "medieval", "G": "scholastic", "H": "modern", "X": "all periods"}
DECLENSION = {"1": "first declension", "2": "second declension", "3": "third declension", "4": "fourth declension", "5": "fifth declension"}
CONJUGATION = {"1": "first conjugation", "2": "second conjugation", "3": "third conjugation", "4": "fourth conjugation", "5": "irregular / third-io"}
GENDER = {"M": "masculine", "F": "feminine", "N": "neuter"}
CASE = {"Nom": "nominative", "Gen": "genitive", "Dat": "dative", "Acc": "accusative", "Abl": "ablative", "Voc": "vocative", "Loc": "locative"}
MOST_ENTRIES, MOST_PARSES, UNCERTAIN = 4, 12, 0.9


def named(code: Column, names: dict[str, str]) -> Column:
    """The name of a code; null for unknown codes."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def lexicon_entries(entries: DataFrame, token: str, order: str) -> DataFrame:
    """The first entries of each token with their codes spelt out: ``headword, pos, declension,
    gender, frequency, age`` beside ``token`` and ``order``, and where the dictionary has them the
    lists ``glosses``, ``principal_parts`` and ``source_refs`` (empty for null). Ties in ``order`` go
    by headword."""
    first = Window.partitionBy(token).orderBy(order, "headword")
    e = entries.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= MOST_ENTRIES)
    which = F.when(F.col("pos").isin("N", "ADJ"), named(F.col("decl"), DECLENSION)).when(F.col("pos") == "V", named(F.col("decl"), CONJUGATION))
    return e.select(token, order, "headword", "pos", which.alias("declension"), named(F.col("gender"), GENDER).alias("gender"), named(F.col("freq"), FREQUENCY).alias("frequency"), named(F.col("age"), AGE).alias("age"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("glosses", "principal_parts", "source_refs") if c in entries.columns])


def distinct_parses(parses: DataFrame, token: str, order: str) -> DataFrame:
    """Of the first parses of each token one for each (lemma, case, number, pos), the earliest;
    case and number spelt out, with ``headword``, ``stem``, ``ending``, ``declension`` (of ``decl``)
    and ``meaning`` (without a closing semicolon) where the analyser gives them. Null features are
    equal to each other."""
    first = Window.partitionBy(token).orderBy(order, "lemma")
    p = parses.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= MOST_PARSES)
    once = Window.partitionBy(token, "lemma", "case", "number", "pos").orderBy("__k")
    p = p.withColumn("__d", F.row_number().over(once)).where(F.col("__d") == 1)
    more = [F.col(c) for c in ("headword", "stem", "ending") if c in parses.columns]
    more += [F.col("decl").alias("declension")] if "decl" in parses.columns else []
    more += [F.regexp_replace(F.coalesce(F.trim("meaning"), F.lit("")), ";+$", "").alias("meaning")] if "meaning" in parses.columns else []
    number = F.when(F.col("number") == "S", "singular").when(F.col("number").isNotNull(), "plural")
    return p.select(token, order, "lemma", "pos", F.coalesce(named(F.left(F.initcap("case"), F.lit(3)), CASE), "case").alias("case"), number.alias("number"), *more)


def findings_by_token(findings: DataFrame) -> DataFrame:
    """Every finding at each token that it contains (``i``), strongest first by ``rank``."""
    each = findings.withColumn("i", F.explode(F.array_distinct(F.split("tokens", ",").cast("array<int>"))))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "sent_id", "i").orderBy(F.col("confidence").desc(), "key", "anchor", "tokens")))


def findings_at(findings: DataFrame, tokens: DataFrame) -> DataFrame:
    """The findings that contain each of ``tokens(doc_id, sent_id, i)``, strongest first by ``rank``."""
    hit = findings.join(tokens, ["doc_id", "sent_id"]).where(F.array_contains(F.split("tokens", ","), F.col("i").cast("string")))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "sent_id", "i").orderBy(F.col("confidence").desc(), "key", "anchor", "tokens")))


def uncertain(readings: DataFrame) -> DataFrame:
    """Tokens whose likeliest reading has a probability below 0.9."""
    return readings.where((F.col("rank") == 1) & (F.col("probability") < UNCERTAIN))


def notes_by_line(notes: DataFrame) -> DataFrame:
    """``(request, line, notes)``: ids of the notes of a line in their order, joined by commas."""
    g = notes.groupBy("request", "line").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return g.select("request", "line", F.array_join(F.transform("x", lambda y: y["id"]), ",").alias("notes"))


def sentence_spans(tokens: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, first, last, n_tokens)`` of each sentence."""
    return tokens.groupBy("doc_id", "sent_id").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n_tokens"))


def foot_groups(syllables: DataFrame) -> DataFrame:
    """Runs of neighbouring syllables of one foot: ``syllables(line_id, k, foot)`` in order ``k``;
    a syllable without foot (elided) goes with the group on its left. ``(line_id, n, foot, members)``.
    """
    by = Window.partitionBy("line_id").orderBy("k")
    s = syllables.withColumn("carried", F.last("foot", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    new = F.when(F.lag("carried").over(by).eqNullSafe(F.col("carried")) & F.lag("k").over(by).isNotNull(), 0).otherwise(1)
    s = s.withColumn("new", new).withColumn("n", F.sum("new").over(by))
    g = s.groupBy("line_id", "n").agg(F.first("carried").alias("foot"), F.array_sort(F.collect_list("k")).alias("m"))
    return g.select("line_id", "n", "foot", F.array_join("m", ",").alias("members"))
