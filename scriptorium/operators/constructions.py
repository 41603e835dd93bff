"""Grammatical constructions: the rules of :mod:`rules` in one pass over the token context."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..session import materialise
from .rules import FAMILIES, SPECIAL, Rule, columns_of, render
from .token_context import token_context

FINDING_SCHEMA = "doc_id bigint, sent_id bigint, key string, anchor int, tokens string, confidence double, label string"


def _struct(rule: Rule) -> str:
    tokens = ", ".join(f"CAST({render(x, 'spark')} AS STRING)" for x in rule.tokens)
    return f"named_struct('key', '{rule.key}', 'anchor', CAST({rule.anchor} AS INT), 'tokens', concat_ws(',', {tokens}), 'confidence', CAST({render(rule.conf, 'spark')} AS DOUBLE), 'label', {render(rule.label, 'spark')})"


def _expression(family: str) -> str:
    alone, cascade = FAMILIES[family]
    parts = [f"CASE WHEN {render(r.when, 'spark')} THEN {_struct(r)} END" for r in alone]
    if cascade:
        parts.append("CASE " + " ".join(f"WHEN {render(r.when, 'spark')} THEN {_struct(r) if r.key else 'NULL'}" for r in cascade) + " END")
    return f"filter(array({', '.join(parts)}), f -> f IS NOT NULL)"


def nominal_absolutes(tokens: DataFrame) -> DataFrame:
    """Ablative absolutes without participle: a role word and a nominal ablative within two places.

    Word by word from the left; a pair whose first word is already part of an absolute is passed
    over for the next candidate.
    """
    return family_findings(tokens, ["nominal"])


#: Detectors that users add: name -> function of the tokens that gives rows of FINDING_SCHEMA.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def detector(name: str) -> Callable:
    """Register a further detector; its findings are united with those of the built-in rules."""

    def add(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        DETECTORS[name] = fn
        return fn

    return add


def family_findings(tokens: DataFrame, families: Iterable[str]) -> DataFrame:
    """Findings of some families, as ``FINDING_SCHEMA``, without suppression."""
    families = list(families)
    context = token_context(tokens, columns_of(families))
    parts = [_expression(f) for f in families]
    out = context.select("doc_id", "sent_id", F.expr(f"inline({parts[0] if len(parts) == 1 else 'concat(' + ', '.join(parts) + ')'})"))
    if "genitive" in families:  # the objective reading always comes with the subjective one
        rows = F.filter(F.array(F.struct("key", "anchor", "tokens", "confidence", "label"), F.when(F.col("key") == "genitive_subjective", F.struct(F.lit("genitive_objective").alias("key"), "anchor", "tokens", F.lit(0.5).alias("confidence"), "label"))), lambda x: x.isNotNull())
        out = out.select("doc_id", "sent_id", F.inline(rows))
    return out


def constructions(tokens: DataFrame) -> DataFrame:
    """All findings of all rules and registered detectors.

    Overlapping readings are kept, duplicates too; only purpose and result clauses give way at an
    anchor with a more special clause. No order: sort by confidence where one is shown. Null
    features never equal a value; sentences without tokens give nothing.
    """
    # the shuffle of this window moves findings, which are few and narrow beside the tokens
    special = F.max(F.col("key").isin(*SPECIAL)).over(Window.partitionBy("doc_id", "sent_id", "anchor"))
    found = family_findings(tokens, FAMILIES).withColumn("special", special)
    found = found.where(~(F.col("special") & F.col("key").isin("purpose_clause", "result_clause"))).drop("special")
    for fn in DETECTORS.values():
        found = found.unionByName(fn(tokens), allowMissingColumns=True)
    return found


def token_tags(findings: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, i, keys)``: the keys of the findings each token takes part in, with
    repeats, in alphabetical order."""
    each = findings.select("doc_id", "sent_id", "key", F.explode(F.split("tokens", ",")).alias("i"))
    return each.groupBy("doc_id", "sent_id", F.col("i").cast("int").alias("i")).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))


#: What to keep in mind with some findings, by key or by key and label.
CAVEATS: dict[str, str] = {
    "ablative_absolute_nominal": "There is no participle: the reading rests on two ablatives standing together.",
    "partitive_genitive": "A genitive on a noun may also possess, describe or be an object.",
    "greek_accusative": "Most accusatives are objects; this one hangs on an adjective, a participle or a passive.",
    "double_dative": "It holds only if both datives belong to the same verb.",
    "accusative_place_to_which": "A bare accusative is mostly an object; look at the verb.",
    "genitive_with_adjective|against the parser": "The parser saw another case; the adjective and the other readings of the form speak for the genitive.",
    "genitive_subjective": "In form it is the same as the objective genitive; the sense decides.",
    "genitive_objective": "In form it is the same as the subjective genitive; the sense decides.",
    "genitive_possessive": "Such a genitive may also be partitive, descriptive, subjective or objective.",
    "dative_with_compound": "Not every compound verb takes a dative.",
    "dative_ethical": "Only if no verb of the clause asks for the dative.",
    "dative_of_reference": "Taken where nothing more exact fits; try the verb, an adjective and possession first.",
    "ablative_of_cause": "Cause and means are not sharply apart.",
    "ablative_of_means": "A bare ablative may as well be cause, manner, respect or price.",
    "dative_direction": "That the text is verse is not checked; weigh the place, the genre and other datives.",
    "alliteration": "Two neighbouring words weigh less than a run of them.",
    "assonance": "With few vowels some repetition comes by itself.",
    "homoeoteleuton": "Agreement alone makes equal endings.",
    "ellipsis": "A fragment, a heading or a list looks the same.",
}
CLAUSE_CAVEAT = "It rests on where the parser hangs the conjunction; look at the bounds of the clause."


def explained(findings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Findings or figures plus ``name``, ``reference``, ``words`` (the texts of their tokens in the
    order given), ``between`` (for a hyperbaton the words that stand apart what belongs together),
    ``strength``, a sentence of ``evidence`` and ``caveat``. Unknown keys keep null names.

    The catalogue is a table of fixed size and is broadcast; words come by one join with the tokens.
    """
    f = findings if "label" in findings.columns else findings.withColumn("label", F.lit(""))
    f = materialise(f.withColumn("id", F.xxhash64("doc_id", "sent_id", "key", "tokens")))  # used twice
    at = F.split("tokens", ",").cast("array<int>")
    said = F.transform(at, lambda i, k: F.struct(k.alias("k"), i.alias("i"), F.lit(False).alias("apart")))
    lo, hi = F.array_min(at), F.array_max(at)
    inside = F.when((F.col("key") == "hyperbaton") & (hi - lo > 1), F.transform(F.sequence(lo + 1, hi - 1), lambda i: F.struct(i.alias("k"), i.alias("i"), F.lit(True).alias("apart")))).otherwise(F.array().cast("array<struct<k:int,i:int,apart:boolean>>"))
    place = f.select("doc_id", "sent_id", "id", F.inline(F.concat(said, inside))).distinct()
    text = tokens.select("doc_id", "sent_id", "i", "text").distinct()
    joined = lambda apart: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("apart") == apart, F.struct("k", "text")))), lambda x: x["text"]), " ")
    words = place.join(text, ["doc_id", "sent_id", "i"]).groupBy("doc_id", "sent_id", "id").agg(joined(False).alias("words"), joined(True).alias("between"))
    named = catalogue(findings.sparkSession).select("key", "name", "reference", "family")
    full = f.join(words, ["doc_id", "sent_id", "id"], "left").join(F.broadcast(named), "key", "left").drop("id")
    strength = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.7, "moderate").otherwise("tentative")
    where = F.when(F.col("reference") == "", "").otherwise(F.concat(F.lit(" ("), "reference", F.lit(")")))
    caveats = F.create_map(*[F.lit(x) for pair in CAVEATS.items() for x in pair])
    caveat = F.coalesce(F.try_element_at(caveats, F.concat_ws("|", "key", "label")), F.try_element_at(caveats, F.col("key")), F.when(F.col("family") == "clause", CLAUSE_CAVEAT).otherwise(""))
    return full.withColumns({"strength": strength, "evidence": F.concat(F.lit("'"), "words", F.lit("': "), "name", where), "caveat": caveat}).drop("family")


def catalogue(spark) -> DataFrame:
    """``(key, name, reference, family)`` of everything that can be found, by name."""
    rows = [(*r, f) for f, t in (("construction", L.CONSTRUCTIONS), ("case use", L.CASE_USES), ("clause", L.CLAUSES)) for r in L.catalogue_rows(t)]
    rows += [(r[0], r[1], "", "figure") for r in L.catalogue_rows(L.DEVICES)]
    return spark.createDataFrame(rows, "key string, name string, reference string, family string").orderBy("name", "key")
