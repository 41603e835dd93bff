"""Is this text the language that the engine analyses? And what looks irregular in it?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .figures import hyperbaton_tokens
from .token_context import flat_tokens

# Shares of analysable words below which a text is refused, or accepted with doubt;
# words from which the language scores count; score below which a competitor decides.
FLOOR, DOUBT, SCORED_WORDS, VETO, COMPETITOR = 0.75, 0.85, 5, 0.15, 0.3

#: Frequent words of some languages, for the built-in scores. A trained scorer can take their place.
FUNCTION_WORDS = {
    "la": "et in est non ad cum ut ex qui quae quod sed si de ab ne nec per autem enim tamen haec hoc atque quoque pro sub inter".split(),
    "en": "the of and to in a is that it for with as was on which not be this are by from at or so".split(),
    "de": "der die das und ist nicht ein eine den dem zu von mit auf es auch an sich man so wird hier was".split(),
    "fr": "le la les de des du et est un une que qui dans ce cette il pas ne on au se sur plus par son".split(),
    "it": "il lo la di che e un una per non con si del della anche questo qui come dello sia nel pi dove".split(),
    "es": "el la los las de que y en un una por no con su se del al lo como para este".split(),
}


def language_scores(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_words, latin, competitor)`` by share of function words: ``latin`` is Latin's share
    of all hits, ``competitor`` the strongest other language if its share is more than 0.3. Both are
    null for texts of fewer than five words; texts without a hit have latin 0."""
    w = words(F.col(text))
    count = lambda listed: F.size(F.filter("w", lambda x: x.isin(*listed)))
    hits = {k: count(v) for k, v in FUNCTION_WORDS.items()}
    t = texts.select(F.col(key), w.alias("w")).select(key, F.size("w").alias("n_words"), *[h.alias(k) for k, h in hits.items()])
    total = sum((F.col(k) for k in FUNCTION_WORDS), F.lit(0))
    others = F.array_sort(F.array(*[F.struct((-F.col(k)).alias("n"), F.lit(k).alias("k")) for k in FUNCTION_WORDS if k != "la"]))
    t = t.withColumn("total", total).withColumn("top", others[0])
    enough = F.col("n_words") >= SCORED_WORDS
    return t.select(
        key, "n_words", F.when(enough, F.coalesce(F.try_divide(F.col("la"), F.col("total")), F.lit(0.0))).alias("latin"),
        F.when(enough & (F.try_divide(-F.col("top.n"), F.col("total")) > COMPETITOR), F.col("top.k")).alias("competitor"),
    )


def analysable(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """``(key, n_words, n_known)``: how many words of each text are in ``known(word)``.

    The distinct words of each text meet the lexicon; texts without words are kept with 0, a null
    key is no text.
    """
    # a word that is frequent in a text is one row with its count, so hot words cost little; the runs
    # of the sorted words give the counts without a shuffle
    w = texts.select(key, F.sort_array(words(F.col(text))).alias("w"))
    w = w.select(key, "w", F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (F.get("w", i - 1) != x), i)), lambda i: i.isNotNull()).alias("at"))
    runs = F.transform("at", lambda i, k: F.struct(F.get("w", i).alias("word"), (F.coalesce(F.get("at", k + 1), F.size("w")) - i).alias("n")))
    counts = w.select(key, F.inline(runs))
    lexicon = known.select("word").distinct().withColumn("there", F.lit(1))
    hit = counts.join(lexicon, "word", "left").groupBy(F.col(key).alias("__key")).agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.coalesce("there", F.lit(0))).alias("n_known"))
    out = texts.select(key).distinct().join(hit, F.col(key) == F.col("__key"), "left")
    return out.select(key, F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_known", F.lit(0)).alias("n_known"))


def unrecognised(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """``(key, position, word)`` of every word that the lexicon lacks, in order, repeats included."""
    every = texts.select(F.col(key), F.posexplode(words(F.col(text))).alias("position", "word"))
    return every.join(known.select("word").distinct(), "word", "left_anti").select(key, "position", "word")


def assess(rates: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """``(key, is_latin, confidence, analysable_rate, latin, competitor, message)`` of each text.

    ``rates`` is :func:`analysable`'s result and ``scores`` one of the form of
    :func:`language_scores`. Texts without words are not Latin, with confidence 0.
    """
    t = rates.join(scores.select(key, "latin", "competitor"), key, "left").withColumn("rate", F.try_divide(F.col("n_known"), F.col("n_words")))
    scored = F.col("n_words") >= SCORED_WORDS
    foreign = scored & (F.coalesce("latin", F.lit(0.0)) < VETO) & F.col("competitor").isNotNull()
    yes = F.coalesce((F.col("rate") >= FLOOR) & ~(foreign & F.col("latin").isNotNull()), F.lit(False))
    message = (
        F.when(F.col("n_words") == 0, "no words")
        .when(~yes & foreign, "another language")
        .when(~yes & (F.col("rate") < 0.2), "hardly a word is known")
        .when(~yes, "too few words are known")
        .when(F.col("rate") < DOUBT, "some words are unknown")
        .otherwise("")
    )
    conf = F.when(F.col("n_words") == 0, 0.0).when(yes, F.col("rate")).otherwise(1 - F.col("rate"))
    r3 = lambda c: F.bround(c, 3)
    return t.select(key, yes.alias("is_latin"), r3(conf).alias("confidence"), r3(F.coalesce("rate", F.lit(0.0))).alias("analysable_rate"), r3(F.when(scored, F.col("latin"))).alias("latin"), F.when(scored, F.col("competitor")).alias("competitor"), message.alias("message"))


def _differ(a: str, b: str) -> Column:
    """True if both have values and none in common; several values are joined by commas."""
    return F.coalesce(~F.arrays_overlap(F.split(a, ","), F.split(b, ",")), F.lit(False))


def anomalies(tokens: DataFrame, suppress: bool = True) -> DataFrame:
    """``(doc_id, sent_id, i, kind, feature)``: modifiers that disagree with their head in the first
    of case, number and gender, but for those in a hyperbaton if ``suppress``; and documents without
    a finite verb (``kind`` no_finite_verb, token 0, at their first sentence)."""
    flat = flat_tokens(tokens)
    head = flat.select("doc_id", "sent_id", F.col("i").alias("head"), F.col("cas").alias("h_cas"), F.col("num").alias("h_num"), F.col("gen").alias("h_gen"))
    mods = flat.where(F.col("dep").isin("amod", "det", "nummod") & F.col("pos").isin("ADJ", "DET", "NUM")).select("doc_id", "sent_id", "i", "head", "cas", "num", "gen")
    pair = mods.join(head, ["doc_id", "sent_id", "head"])
    which = F.when(_differ("cas", "h_cas"), "Case").when(_differ("num", "h_num"), "Number").when(_differ("gen", "h_gen"), "Gender")
    wrong = pair.withColumn("feature", which).where(F.col("feature").isNotNull()).select("doc_id", "sent_id", "i", F.lit("agreement").alias("kind"), "feature")
    if suppress:
        wrong = wrong.join(hyperbaton_tokens(tokens), ["doc_id", "sent_id", "i"], "left_anti")
    finite = F.max(F.coalesce(F.contains("vf", F.lit("Fin")), F.lit(False)))
    bare = flat.groupBy("doc_id").agg(finite.alias("finite"), F.min("sent_id").alias("sent_id")).where(~F.col("finite"))
    return wrong.unionByName(bare.select("doc_id", "sent_id", F.lit(0).alias("i"), F.lit("no_finite_verb").alias("kind"), F.lit("").alias("feature")))
