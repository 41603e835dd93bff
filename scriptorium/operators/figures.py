"""Rhetorical figures of parsed sentences: one pass over the array of each sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .rules import within
from .token_context import flat_tokens, sentences

WORD = "(t.pos NOT IN ('PUNCT', 'X') AND t.text <> '')"
PAIR = "t.pos IN ('ADJ', 'DET', 'NUM') AND t.dep IN ('amod', 'det', 'nummod') AND exists(s, x -> x.i = t.head)"
COORDINATOR = "(t.dep = 'cc' OR t.l IN ('et', 'que', 'atque', 'ac'))"
CONTENT = "t.pos IN ('VERB', 'NOUN', 'ADJ', 'PROPN', 'ADV', 'NUM') AND t.text <> ','"
NOMINAL5 = "t.pos IN ('NOUN', 'PROPN', 'ADJ', 'PRON', 'VERB') AND length(t.l) > 2"
#: First sound of a word: these pairs of letters count as one.
SOUND = "regexp_extract({}.form, '^(qu|ch|ph|th|gn|sc|sp|st|.)', 1)"


def _f(key: str, tokens: str, conf: str) -> str:
    return f"named_struct('key', '{key}', 'tokens', array_join({tokens}, ','), 'confidence', CAST({conf} AS DOUBLE))"


def _each(condition: str, key: str, tokens: str, conf: str, source: str = "s") -> str:
    return f"transform(filter({source}, t -> {condition}), t -> {_f(key, tokens, conf)})"


NONE = "CAST(array() AS array<struct<key:string,tokens:string,confidence:double>>)"


def _if(condition: str, key: str, tokens: str, conf: str) -> str:
    return f"CASE WHEN {condition} THEN array({_f(key, tokens, conf)}) ELSE {NONE} END"


_pairs = f"transform(filter(s, t -> {PAIR} AND abs(t.i - t.head) > 1), t -> named_struct('a', t.i, 'n', t.head))"
_shapes = f"""transform({_pairs}, (p, k) -> transform(slice({_pairs}, k + 2, greatest(size({_pairs}) - k - 1, 0)), q ->
  array_sort(array(named_struct('i', p.a, 'c', 'A'), named_struct('i', p.n, 'c', 'a'), named_struct('i', q.a, 'c', 'B'), named_struct('i', q.n, 'c', 'b')))))"""
_shape = "array_join(transform(q, y -> y.c), '')"
CROSSED = f"""slice(transform(filter(flatten({_shapes}), q -> q[3].i - q[0].i <= 8 AND size(array_distinct(transform(q, y -> y.i))) = 4 AND {_shape} IN ('ABba', 'BAab', 'ABab', 'BAba')),
  q -> named_struct('key', CASE WHEN {_shape} IN ('ABba', 'BAab') THEN 'chiasmus' ELSE 'synchysis' END, 'tokens', array_join(transform(q, y -> y.i), ','), 'confidence', 0.65D)), 1, 3)"""
GOLDEN = _if(
    "size(w) = 5 AND w[0].pos = 'ADJ' AND w[1].pos = 'ADJ' AND w[2].pos IN ('VERB', 'AUX') AND w[3].pos IN ('NOUN', 'PROPN') AND w[4].pos IN ('NOUN', 'PROPN')",
    "golden_line", "transform(w, t -> t.i)", "CASE WHEN w[0].cas <=> w[4].cas AND w[1].cas <=> w[3].cas THEN 0.8 ELSE 0.5 END",
)
_of = "filter(s, t -> {} AND t.l = v)"
_group = f"filter(s, t -> {NOMINAL5} AND t.l = v)"
POLYPTOTON = f"""slice(transform(filter(array_distinct(transform(filter(s, t -> {NOMINAL5}), t -> t.l)), v -> size({_group}) >= 2 AND size(array_distinct(transform({_group}, t -> t.form))) >= 2
  AND array_max(transform({_group}, t -> t.i)) - array_min(transform({_group}, t -> t.i)) <= 10), v -> {_f("polyptoton", f"transform({_group}, t -> t.i)", "0.7")}), 1, 3)"""
_conj = "filter(s, t -> t.dep = 'conj')"
_comma = "transform(filter(s, t -> {}), t -> size(filter(s, x -> x.text = ',' AND x.i < t.i)))".format(CONTENT)
ASYNDETON = f"""CASE WHEN exists(s, t -> {COORDINATOR}) THEN {NONE}
  WHEN size({_conj}) >= 2 THEN array({_f("asyndeton", f"concat(transform(filter(s, x -> x.i = {_conj}[0].head), x -> x.i), transform({_conj}, t -> t.i))", "0.65")})
  WHEN size(array_distinct({_comma})) >= 3 AND size(array_distinct({_comma})) = size({_comma}) THEN array({_f("asyndeton", f"transform(filter(s, t -> {CONTENT}), t -> t.i)", "0.65")}) ELSE {NONE} END"""
POLYSYNDETON = _if(f"size(filter(s, t -> {COORDINATOR})) >= 3", "polysyndeton", f"transform(filter(s, t -> {COORDINATOR}), t -> t.i)", "0.6")
TRICOLON = f"""transform(filter(array_distinct(transform(filter(s, t -> t.dep = 'conj' AND exists(s, x -> x.i = t.head)), t -> t.head)), h -> size(filter(s, t -> t.dep = 'conj' AND t.head = h)) = 2),
  h -> {_f("tricolon", "concat(array(h), transform(filter(s, t -> t.dep = 'conj' AND t.head = h), t -> t.i))", "0.6")})"""
_denied = f"filter(s, u -> u.i > t.i AND u.i <= t.i + 2 AND {within('u.l', L.NEGATIVE_SENSE)})"
LITOTES = _each(f"{within('t.l', L.NEGATORS)} AND size({_denied}) > 0", "litotes", f"array(t.i, {_denied}[0].i)", "0.7")
SIMILE = _each(within("t.l", L.SIMILE_MARKERS), "simile", "array(t.i)", "0.7")
APOSTROPHE = f"slice({_each("t.cas = 'Voc' AND t.dep NOT IN ('nsubj', 'nsubj:pass') AND t.pos IN ('NOUN', 'PROPN', 'PRON', 'ADJ')", "apostrophe", "array(t.i)", "0.7")}, 1, 3)"
ELLIPSIS = _if("size(w) >= 3 AND NOT exists(s, t -> coalesce(t.vf, '') LIKE '%Fin%')", "ellipsis", "transform(slice(w, 1, 6), t -> t.i)", "0.6")
_rhymes = "filter(slice(w, k + 2, 3), b -> length(a.form) >= 3 AND length(b.form) >= 3 AND right(a.form, 3) = right(b.form, 3) AND a.l <> b.l)"
HOMOEOTELEUTON = f"slice(flatten(transform(w, (a, k) -> CASE WHEN size({_rhymes}) > 0 THEN array({_f('homoeoteleuton', f'array(a.i, {_rhymes}[0].i)', '0.45')}) ELSE {NONE} END)), 1, 3)"
_vowels = "regexp_extract_all(array_join(transform(q, t -> t.form), ''), '([aeiou])', 1)"
_common = f"filter(array_distinct({_vowels}), v -> forall(q, t -> contains(t.form, v)))"
ASSONANCE = f"""slice(flatten(transform(CASE WHEN size(w) >= 3 THEN transform(sequence(1, size(w) - 2), k -> slice(w, k, 4)) ELSE array(w) END, q ->
  CASE WHEN size(w) >= 3 AND size({_common}) > 0 AND size(filter({_vowels}, v -> v = {_common}[0])) >= 6 THEN array({_f("assonance", "transform(q, t -> t.i)", "0.5")}) ELSE {NONE} END)), 1, 2)"""
_same = f"filter(slice(w, k + 2, 5), u -> {SOUND.format('u')} = {SOUND.format('w[k]')} AND NOT {within('u.form', L.SOUND_STOPWORDS)})"
ALLITERATION = f"""aggregate(CASE WHEN size(w) > 0 THEN sequence(0, size(w) - 1) ELSE CAST(array() AS array<int>) END, named_struct('used', CAST(array() AS array<int>), 'found', {NONE}),
  (acc, k) -> aggregate(array(transform({_same}, u -> u.i)), acc, (a, g) -> CASE
    WHEN array_contains(a.used, w[k].i) OR w[k].form = '' OR left(w[k].form, 1) IN ('a', 'e', 'i', 'o', 'u', 'y') OR size(g) = 0 OR (size(g) = 1 AND g[0] - w[k].i > 1) THEN a
    ELSE named_struct('used', concat(a.used, array(w[k].i), g), 'found', concat(a.found, array(named_struct('key', 'alliteration', 'tokens', array_join(concat(array(w[k].i), g), ','),
      'confidence', CASE WHEN size(g) = 1 THEN 0.5D ELSE 0.6D + 0.1D * least(size(g) - 2, 3) END)))) END), acc -> acc.found)"""

#: Sentences of a document that are looked at together for anaphora.
SENTENCE_BLOCK = 4096

HYPERBATON = _each(f"{PAIR} AND abs(t.i - t.head) - 1 >= 3", "hyperbaton", "array(t.i, t.head)", "0.7")

GROUPS: dict[str, list[str]] = {
    "order": [HYPERBATON, CROSSED, GOLDEN, _each("t.dep = 'case' AND t.pos = 'ADP' AND exists(s, x -> x.i = t.head AND t.i = x.i + 1)", "anastrophe", "array(t.head, t.i)", "0.75")],
    "words": [POLYPTOTON, LITOTES, SIMILE, APOSTROPHE, ELLIPSIS],
    "coordination": [ASYNDETON, POLYSYNDETON, TRICOLON],
    "sound": [HOMOEOTELEUTON, ASSONANCE],
    "alliteration": [ALLITERATION],
}


def figures(tokens: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``(doc_id, sent_id, key, tokens, confidence)`` of the figures inside sentences.

    Where a figure is capped per sentence (three chiasmi, two assonances and so on) the first in
    word order stay. Missing features never match; sentences of one word have no figures.
    """
    s = sentences(tokens).withColumn("w", F.expr(f"filter(s, t -> {WORD})"))
    parts = [x for g in (groups or GROUPS) for x in GROUPS[g]]
    return s.select("doc_id", "sent_id", F.expr(f"inline({parts[0] if len(parts) == 1 else 'concat(' + ', '.join(parts) + ')'})"))


def anaphora(tokens: DataFrame) -> DataFrame:
    """Runs of two or more consecutive sentences of a document that open with the same word:
    ``(doc_id, sent_id, key, tokens, confidence)``, the sentence being the first of the run and the
    tokens ``sentence:word`` of each opening. Each run comes once, at its full length.

    Runs are found within blocks of sentences; only those at the ends of blocks are then compared
    along the document, so a document with a third of all sentences is not sorted in one task.
    """
    first = flat_tokens(tokens).alias("t").where(WORD).groupBy("doc_id", "sent_id").agg(F.min(F.struct("i", "form")).alias("t"))
    s = first.select("doc_id", "sent_id", F.floor(F.col("sent_id") / SENTENCE_BLOCK).alias("block"), "t.i", "t.form")
    by = Window.partitionBy("doc_id", "block").orderBy("sent_id")
    new = F.when(F.lag("form").over(by).eqNullSafe(F.col("form")), 0).otherwise(1)
    runs = s.withColumn("new", new).withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "block", "run")
    runs = runs.agg(F.first("form").alias("form"), F.min("sent_id").alias("sent_id"), F.array_sort(F.collect_list(F.struct("sent_id", "i"))).alias("x"))
    last = F.max("run").over(Window.partitionBy("doc_id", "block"))
    runs = runs.withColumn("opens", F.col("run") == 1).withColumn("closes", F.col("run") == last)
    ends = Window.partitionBy("doc_id").orderBy("sent_id")
    joins = (F.lag("form").over(ends) == F.col("form")) & F.lag("closes").over(ends) & F.col("opens")
    edge = runs.where("opens OR closes").withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("chain", F.sum("new").over(ends))
    chained = edge.groupBy("doc_id", "chain").agg(F.min("sent_id").alias("sent_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "x"))), lambda y: y["x"])).alias("x"))
    every = runs.where("NOT opens AND NOT closes").select("doc_id", "sent_id", "x").unionByName(chained.select("doc_id", "sent_id", "x")).where(F.size("x") >= 2)
    return every.select("doc_id", "sent_id", F.lit("anaphora").alias("key"), F.array_join(F.transform("x", lambda y: F.concat_ws(":", y["sent_id"], y["i"])), ",").alias("tokens"), F.lit(0.75).alias("confidence"))


def hyperbaton_tokens(tokens: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, i)`` of every token in a hyperbaton, for suppressing anomalies there."""
    h = sentences(tokens).select("doc_id", "sent_id", F.expr(f"inline({HYPERBATON})"))
    return h.select("doc_id", "sent_id", F.explode(F.split("tokens", ",").cast("array<int>")).alias("i")).distinct()
