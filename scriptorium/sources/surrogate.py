"""A deterministic stand-in for a parser, to run the grammar rules over whole tables.

It is no linguistics: lemma, part of speech, head and features are read from the md5 of the row id
and the word's place. As chance alone makes hardly any of the rarer constructions, some sentences
begin with one of PLANTED, sentences parsed by hand. Real annotation comes in through
:func:`scriptorium.sources.plain.read_conllu` or any table of the token schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L

#: Lemmas to draw from: particles more often than others, then all classes of the rules.
PARTICLES = "sum sum sum sum ut ut ne ne cum cum quo quod si nisi dum qui quis non in ab de ex ad sine quin quominus quia quoniam quamquam donec antequam et atque quam causa ego tu velut tam".split()
_CLASSES = [n for n in dir(L) if n.isupper() and isinstance(getattr(L, n), list) and n != "DATIVE_COMPOUND_PREFIXES"]
LEMMAS = PARTICLES * 6 + sorted({w for n in _CLASSES for w in getattr(L, n)})
POS = "NOUN NOUN NOUN VERB VERB VERB ADJ ADJ PROPN PRON ADP SCONJ AUX NUM ADV DET".split()
DEP = "obj obl nsubj nsubj:pass amod det nummod case case mark mark mark mark advmod advcl advcl advcl:abs ccomp ccomp csubj acl:relcl acl xcomp cop conj conj cc nmod iobj aux".split()
CASES = ["", "Nom", "Gen", "Gen", "Dat", "Dat", "Acc", "Acc", "Abl", "Abl", "Abl", "Loc", "Voc"]
FEATURES = {  # name: (values, hex digit of the md5 from which it is read)
    "Case": (CASES, 9), "Number": (["Sing", "Plur", ""], 11), "Gender": (["Masc", "Fem", "Neut", ""], 13), "Mood": (["Sub", "Sub", "Ind", "Imp", ""], 15),
    "Tense": (["Pres", "Past", "Imp", "Pqp", "Fut", ""], 17), "Voice": (["Pass", "Act", ""], 19), "VerbForm": (["Fin", "Part", "Inf", "Gdv", "Sup", "Ger", ""], 21),
    "Person": (["1", "2", "3", ""], 23), "PronType": (["Rel", "", ""], 25), "Aspect": (["Prosp", "Perf", ""], 27),
}
ENTITIES = ["", "", "", "LOC", "GPE", "PERSON"]

#: One sentence in so many may begin with each planted one; longer ones go on by chance.
PLANT_EVERY = 64
_FIN, _SUB = "Mood=Ind VerbForm=Fin", "Mood=Sub VerbForm=Fin"
#: What must be found -> tokens as (word or "" for the sentence's own, lemma, part of speech, relation,
#: head, features). Those under a name with "=" are planted only where they fill the whole sentence.
PLANTED: dict[str, list[tuple[str, str, str, str, int, str]]] = {
    "genitive_with_interest": [("", "rex", "NOUN", "nmod", 1, "Case=Gen Number=Sing"), ("", "interest", "VERB", "ROOT", 1, _FIN)],
    "dative_ethical": [("mihi", "ego", "PRON", "obl", 1, "Case=Dat"), ("", "ago", "VERB", "ROOT", 1, _FIN)],
    "cognate_accusative": [("", "pugna", "NOUN", "nmod", 1, "Case=Acc"), ("", "pugno", "VERB", "ROOT", 1, _FIN)],
    "ablative_of_agent": [("", "ab", "ADP", "case", 1, ""), ("", "rex", "NOUN", "obl", 2, "Case=Abl"), ("", "laudo", "VERB", "ROOT", 2, f"Voice=Pass {_FIN}")],
    "ablative_of_accompaniment": [("", "cum", "ADP", "case", 1, ""), ("", "amicus", "NOUN", "obl", 2, "Case=Abl"), ("", "uenio", "VERB", "ROOT", 2, _FIN)],
    "ablative_of_place_where": [("", "in", "ADP", "case", 1, ""), ("", "urbs", "NOUN", "obl", 2, "Case=Abl"), ("", "habito", "VERB", "ROOT", 2, _FIN)],
    "gerund_accusative_purpose": [("", "ad", "ADP", "case", 1, ""), ("", "disco", "VERB", "advcl", 2, "Case=Acc VerbForm=Ger"), ("", "uenio", "VERB", "ROOT", 2, _FIN)],
    "hindering_clause": [("", "impedio", "VERB", "ROOT", 0, _FIN), ("", "quominus", "SCONJ", "mark", 2, ""), ("", "facio", "VERB", "ccomp", 0, _SUB)],
    "substantive_purpose": [("", "impero", "VERB", "ROOT", 0, _FIN), ("", "ut", "SCONJ", "mark", 2, ""), ("", "facio", "VERB", "ccomp", 0, _SUB)],
    "substantive_result": [("", "accido", "VERB", "ROOT", 0, _FIN), ("", "ut", "SCONJ", "mark", 2, ""), ("", "facio", "VERB", "csubj", 0, _SUB)],
    "relative_purpose": [("", "mitto", "VERB", "ROOT", 0, _FIN), ("", "legatus", "NOUN", "obj", 0, "Case=Acc"), ("", "qui", "PRON", "nsubj", 3, "PronType=Rel"), ("", "peto", "VERB", "acl:relcl", 1, _SUB)],
    "dative_direction": [("", "caelum", "NOUN", "obl", 1, "Case=Dat"), ("", "uenio", "VERB", "ROOT", 1, _FIN)],
    "fear_clause": [("", "timeo", "VERB", "ROOT", 0, _FIN), ("", "ne", "SCONJ", "mark", 2, ""), ("", "uenio", "VERB", "ccomp", 0, _SUB)],
    "conditional_clause": [("", "si", "SCONJ", "mark", 1, ""), ("", "habeo", "VERB", "advcl", 2, f"Tense=Imp {_SUB}"), ("", "do", "VERB", "ROOT", 2, f"Tense=Pqp {_SUB}")],
    "hyperbaton": [("", "magnus", "ADJ", "amod", 4, "Case=Nom"), ("", "tum", "ADV", "advmod", 2, ""), ("", "cano", "VERB", "ROOT", 2, _FIN), ("", "bene", "ADV", "advmod", 2, ""), ("", "uates", "NOUN", "nsubj", 2, "Case=Nom")],
    "chiasmus": [("", "magnus", "ADJ", "amod", 4, "Case=Nom"), ("", "longus", "ADJ", "amod", 3, "Case=Acc"), ("", "cano", "VERB", "ROOT", 2, _FIN), ("", "carmen", "NOUN", "obj", 2, "Case=Acc"), ("", "uates", "NOUN", "nsubj", 2, "Case=Nom")],
    "golden_line=": [("", "magnus", "ADJ", "amod", 4, "Case=Nom"), ("", "longus", "ADJ", "amod", 3, "Case=Acc"), ("", "cano", "VERB", "ROOT", 2, _FIN), ("", "carmen", "NOUN", "obj", 2, "Case=Acc"), ("", "uates", "NOUN", "nsubj", 2, "Case=Nom")],
    "asyndeton=": [("ueni", "uenio", "VERB", "ROOT", 0, _FIN), (",", ",", "PUNCT", "punct", 0, ""), ("uidi", "uideo", "VERB", "parataxis", 0, _FIN), (",", ",", "PUNCT", "punct", 2, ""), ("uici", "uinco", "VERB", "parataxis", 0, _FIN)],
}


def planted_rows() -> list[tuple]:
    """(number, tokens, exact, i, word, lemma, pos, dep, head, features) of the planted sentences."""
    return [(k, len(t), name.endswith("="), i, word or None, lemma, pos, dep, head, dict(f.split("=") for f in feats.split())) for k, (name, t) in enumerate(PLANTED.items()) for i, (word, lemma, pos, dep, head, feats) in enumerate(t)]


def annotate(lines: DataFrame, document: str, sentence: str, text: str) -> DataFrame:
    """Token rows (schema ``TOKEN_SCHEMA``) of each row's words, one sentence a row."""

    def pick(values: list[str], at: int, width: int = 2):
        n = F.conv(F.substring("m", at, width), 16, 10).cast("int") % len(values)
        return F.element_at(F.array(*map(F.lit, values)), n + 1)

    words = F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit("([a-z]+)"), 1)
    t = lines.select(F.col(f"`{document}`").alias("doc_id"), F.col(f"`{sentence}`").alias("sent_id"), words.alias("w"))
    t = t.select("doc_id", "sent_id", F.size("w").alias("n"), F.posexplode("w").alias("i", "text"))
    t = t.withColumn("m", F.md5(F.concat_ws(":", "sent_id", "i")))
    shift = F.conv(F.substring("m", 31, 2), 16, 10).cast("int") % 7 - 3
    t = t.withColumn("head", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("i") + shift)))
    morph = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*[pick(v, at) for v, at in FEATURES.values()])), lambda k, v: v != "")
    gen = F.conv(F.substring("m", 29, 1), 16, 10).cast("int") < 4
    planted = t.sparkSession.createDataFrame(planted_rows(), "p_no int, p_size int, p_exact boolean, p_i int, p_text string, p_lemma string, p_pos string, p_dep string, p_head int, p_morph map<string,string>")
    number = F.conv(F.substring(F.md5(F.concat(F.lit("t"), F.col("sent_id").cast("string"))), 1, 2), 16, 10).cast("int") % PLANT_EVERY
    fits = (F.col("p_no") == number) & (F.col("p_i") == F.col("i")) & F.when(F.col("p_exact"), F.col("n") == F.col("p_size")).otherwise(F.col("n") >= F.col("p_size"))
    t = t.join(F.broadcast(planted), fits, "left")  # of fixed size
    own = lambda c, chance: F.when(F.col("p_no").isNull(), chance).otherwise(F.col(c))
    gen = gen & F.col("p_no").isNull()
    return t.select(
        "doc_id", "sent_id", "i", F.coalesce("p_text", "text").alias("text"), own("p_lemma", pick(LEMMAS, 1, 4)).alias("lemma"), own("p_pos", pick(POS, 5)).alias("pos"), own("p_dep", F.when(F.col("head") == F.col("i"), "ROOT").otherwise(pick(DEP, 7))).alias("dep"), own("p_head", F.col("head")).alias("head"),
        own("p_morph", morph).alias("morph"), F.when(gen, F.array(F.create_map(F.lit("case"), F.lit("GEN")))).otherwise(F.array().cast("array<map<string,string>>")).alias("candidates"),
        F.when(F.col("p_no").isNull(), pick(ENTITIES, 30, 1)).otherwise("").alias("ent"), F.lit("").alias("gloss"),
    )


def annotation_sql() -> str:
    """The same tokens from ``loc`` in DuckDB, with features as columns, as CTE ``flat``."""

    def pick(values: list[str], at: int, width: int = 2) -> str:
        return f"({list(values)!r})[1 + ('0x' || substr(m, {at}, {width}))::INT % {len(values)}]"

    names = {"cas": "Case", "num": "Number", "gen": "Gender", "person": "Person", "tense": "Tense", "voice": "Voice", "mood": "Mood", "aspect": "Aspect", "vf": "VerbForm", "pt": "PronType"}
    feats = "__".join(f"nullif({pick(*FEATURES[f])}, '')" for f in names.values())
    text = lambda x: "NULL" if x is None else "'" + str(x) + "'"
    rows = ", ".join(f"({no}, {size}, {exact}, {i}, {text(word)}, {text(lemma)}, {text(pos)}, {text(dep)}, {head}, {', '.join(text(f.get(n)) for n in names.values())})" for no, size, exact, i, word, lemma, pos, dep, head, f in planted_rows())
    chosen = ", ".join(f"CASE WHEN no IS NULL THEN {x.split(' AS ')[0]} ELSE pl_{c} END AS {c}" for x, c in zip(feats.split("__"), names))
    folded = lambda c: f"replace(replace({c}, 'v', 'u'), 'j', 'i')"
    return f"""
w AS (SELECT work_id AS doc_id, loc_id AS sent_id, regexp_extract_all(lower(text), '([a-z]+)', 1) AS ws FROM loc WHERE text IS NOT NULL),
e AS (SELECT doc_id, sent_id, len(ws)::INT AS n, unnest(ws) AS text, (unnest(range(len(ws))))::INT AS i FROM w),
d AS (SELECT *, md5(sent_id || ':' || i) AS m, ('0x' || left(md5('t' || sent_id), 2))::INT % {PLANT_EVERY} AS pick_no FROM e),
plant AS (SELECT * FROM (VALUES {rows}) t(no, size, exact, pl_i, pl_text, pl_lemma, pl_pos, pl_dep, pl_head, {', '.join(f'pl_{c}' for c in names)})),
h AS (SELECT d.*, plant.*, greatest(0, least(n - 1, i + ('0x' || substr(m, 31, 2))::INT % 7 - 3))::INT AS head0 FROM d LEFT JOIN plant ON no = pick_no AND pl_i = i AND CASE WHEN exact THEN n = size ELSE n >= size END),
flat0 AS (SELECT doc_id, sent_id, i, coalesce(pl_text, text) AS text, {folded('coalesce(pl_text, text)')} AS form, {folded(f'coalesce(pl_lemma, {pick(LEMMAS, 1, 4)})')} AS l,
  coalesce(pl_pos, {pick(POS, 5)}) AS pos, coalesce(pl_dep, CASE WHEN head0 = i THEN 'ROOT' ELSE {pick(DEP, 7)} END) AS dep, coalesce(pl_head, head0)::INT AS head, CASE WHEN no IS NULL THEN {pick(ENTITIES, 30, 1)} ELSE '' END AS ent,
  {chosen}, no IS NULL AND ('0x' || substr(m, 29, 1))::INT < 4 AS cand_gen FROM h)"""
