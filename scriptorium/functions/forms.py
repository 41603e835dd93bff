"""Spelling functions that keep track of the original: folds with origins, enclitics, morphology.

Folds that need no origin are column expressions; those that map each character back are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

# Characters of editions and what stands for them.
EDITORIAL = "[]<>{}†‡*⟨⟩⌈⌉"
LIGATURES = {"æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ﬁ": "fi", "ﬂ": "fl"}
GLYPHS = {"ſ": "s", "’": "'", "‘": "'", "“": '"', "”": '"', "—": " -- ", "–": "-"}
QUANTITY_MARKS = "̣̄̆̈"  # macron, breve, diaeresis, dot below
FOLDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("origin", T.ArrayType(T.IntegerType()))])

# Words that only look as if a particle were attached, and endings that forbid it.
QUE_WORDS = (
    "absque atque cumque denique itaque namque neque plerumque quoque susque undique usque utique ubique quisque quidque quodque quemque "
    "quamque quosque quasque cuiusque cuique quaque quibusque uterque utraque utrumque utriusque utrique plerique pleraque pleraeque plerosque "
    "plerasque quicumque quaecumque quodcumque quemcumque quocumque quacumque quotcumque ubicumque quandocumque utcumque quinque torque coque "
    "cinque aeque abusque seque"
).split()
NE_WORDS = (
    "bene sine paene pone omne plane superne inferne interne digne benigne maligne impune commune immune iuvene iuuene cane mane sane vane uane "
    "plene obscene serene amoene"
).split()
VE_WORDS = (
    "breve grave leve suave dulce nove noue prave praue salve salue cave caue solve solue volve uolue fave faue serve serue nerve nerue curve "
    "curue vive uiue move moue lave laue"
).split()
NE_ENDINGS = "ine mine dine gine tudine one ione gone rne sne cne gne pne tne".split()
CUM_HOSTS = {"mecum": "me", "tecum": "te", "secum": "se", "nobiscum": "nobis", "uobiscum": "uobis", "vobiscum": "vobis", "quocum": "quo", "quacum": "qua", "quicum": "qui", "quibuscum": "quibus"}


def _traced(text: str | None, index: bool) -> dict | None:
    if text is None:
        return None
    out, origin = [], []
    for k, c in enumerate(text):
        if c in EDITORIAL:
            continue
        new = LIGATURES.get(c) or GLYPHS.get(c) or c
        if index:
            new = "".join(x for x in unicodedata.normalize("NFD", new) if not unicodedata.combining(x)).lower().replace("v", "u").replace("j", "i")
        out.append(new)
        origin += [k] * len(new)
    return {"text": "".join(out), "origin": origin}


@F.pandas_udf(FOLDED)
def _display(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_traced(t, False) or {"text": None, "origin": None} for t in text], columns=["text", "origin"])


@F.pandas_udf(FOLDED)
def _index(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_traced(t, True) or {"text": None, "origin": None} for t in text], columns=["text", "origin"])


def surface_form(original: Column, start: Column, parsed: Column) -> Column:
    """The text as pasted under a parsed token that starts at ``start`` (from 0), since a parser may
    respell it; the parsed form where the original has fewer characters left."""
    there = F.substring(original, start + 1, F.length(parsed))
    return F.when(F.length(there) == F.length(parsed), there).otherwise(parsed)


@F.pandas_udf(T.StringType())
def _unmarked(text: pd.Series) -> pd.Series:
    drop = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if c not in QUANTITY_MARKS))
    return text.map(drop, na_action="ignore")


def fold_display(text: Column) -> Column:
    """Ligatures spelt out, old glyphs and quotes made plain, editorial marks dropped; with the place
    of origin (counted from 0) of every character. Null gives null parts."""
    ship(SparkSession.active())
    return _display(text)


def fold_index(text: Column) -> Column:
    """The display fold without marks and case, v as u, j as i; with origins."""
    ship(SparkSession.active())
    return _index(text)


def original_span(fold: Column, start: Column, end: Column) -> Column:
    """``struct(lo, hi)``: where the characters [start, end) of a fold lie in the original. Null for an
    empty or reversed span; (0, 0) where the fold is empty."""
    origin = fold["origin"]
    inside = F.struct(F.get(origin, start).alias("lo"), (F.get(origin, F.least(end, F.size(origin)) - 1) + 1).alias("hi"))
    empty = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    return F.when(start < end, F.when(F.size(origin) == 0, empty).otherwise(inside))


def original_slice(original: Column, fold: Column, start: Column, end: Column) -> Column:
    """The original text under the characters [start, end) of its fold."""
    span = original_span(fold, start, end)
    return F.substring(original, span["lo"] + 1, span["hi"] - span["lo"])


def strip_quantities(text: Column) -> Column:
    """Macron, breve, diaeresis and dot below go; all other marks stay composed."""
    ship(SparkSession.active())
    return _unmarked(text)


def split_enclitic(word: Column, known: Column | None = None, stem_known=None) -> Column:
    """``struct(stem, enclitic)`` of a folded word; ``enclitic`` is null where nothing is split off.

    A known word stays whole; then pronouns with cum; then -que, -ne and -ve, unless the word is one
    that only ends so, or too short. ``stem_known`` (stem -> boolean column) refuses unknown stems.
    """

    def pair(stem: Column, enclitic: str | None) -> Column:
        return F.struct(stem.alias("stem"), F.lit(enclitic).cast("string").alias("enclitic"))

    out = F.when(word.isNull(), F.lit(None))
    if known is not None:
        out = out.when(known, pair(word, None))
    for host, stem in CUM_HOSTS.items():
        out = out.when(word == host, pair(F.lit(stem), "cum"))
    for enc, whole, endings in (("que", QUE_WORDS, ["cumque"]), ("ne", NE_WORDS, NE_ENDINGS), ("ve", VE_WORDS, [])):
        stem = F.left(word, F.length(word) - len(enc))
        fits = word.endswith(enc) & (F.length(word) > len(enc) + 1) & ~word.isin(*whole)
        for e in endings:
            fits = fits & ~word.endswith(e)
        out = out.when(fits & stem_known(stem) if stem_known else fits, pair(stem, enc))
    return out.otherwise(pair(word, None))


def first_sense(gloss: Column) -> Column:
    """The first sense of a dictionary gloss; empty for none."""
    return F.coalesce(F.trim(F.get(F.split(gloss, "[,;]"), F.lit(0))), F.lit(""))


# Words of a morphological description; a value without a name stands for itself.
MORPH_NAMES = {
    "Case": {"Nom": "nominative", "Gen": "genitive", "Dat": "dative", "Acc": "accusative", "Abl": "ablative", "Voc": "vocative", "Loc": "locative"},
    "Number": {"Sing": "singular", "Plur": "plural"},
    "Gender": {"Masc": "masculine", "Fem": "feminine", "Neut": "neuter"},
    "Person": {"1": "1st person", "2": "2nd person", "3": "3rd person"},
    "Tense": {"Pres": "present", "Past": "perfect", "Fut": "future", "Pqp": "pluperfect"},
    "Voice": {"Act": "active", "Pass": "passive"},
    "Mood": {"Ind": "indicative", "Sub": "subjunctive", "Imp": "imperative"},
}
POS_NAMES = {
    "NOUN": "noun", "PROPN": "proper noun", "VERB": "verb", "AUX": "auxiliary verb", "ADJ": "adjective", "ADV": "adverb", "PRON": "pronoun", "DET": "determiner", "ADP": "preposition",
    "CCONJ": "coordinating conjunction", "SCONJ": "subordinating conjunction", "NUM": "numeral", "PART": "particle", "INTJ": "interjection", "PUNCT": "punctuation", "X": "unclassified",
}
VERBAL_NOUNS = {"Part": "participle", "Ger": "gerund", "Gdv": "gerundive", "Sup": "supine"}


def _named(value: Column, names: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), otherwise)


def describe_morph(morph: Column, pos: Column) -> Column:
    """A line such as ``3rd person singular present active indicative verb`` for a token.

    Verbal nouns and adjectives have tense (or what the aspect says of it) and voice before their
    name and gender, case and number behind it, but a prospective passive participle is a plain
    gerundive; verbs have person, number, tense, voice, mood; all others gender, case, number and
    their part of speech. Missing features are left out.
    """
    raw = lambda f: F.nullif(F.try_element_at(morph, F.lit(f)), F.lit(""))
    label = lambda f: _named(raw(f), MORPH_NAMES[f], raw(f))
    has = lambda f, *values: F.coalesce(raw(f).isin(*values), F.lit(False))
    kind = _named(pos, POS_NAMES, F.lower(pos))
    agree = [label(f) for f in ("Gender", "Case", "Number")]
    said = F.when(has("Aspect", "Perf") | has("Tense", "Past"), "perfect").when(has("Aspect", "Prosp") | has("Tense", "Fut"), "future").when(has("Aspect", "Imp") | has("Tense", "Pres"), "present")
    gerundive = has("VerbForm", "Part") & has("Aspect", "Prosp") & has("Voice", "Pass")
    name = F.when(gerundive, "gerundive").otherwise(_named(raw("VerbForm"), VERBAL_NOUNS, F.lit("")))
    before = [F.when(has("VerbForm", "Part") & ~gerundive, x) for x in (said, label("Voice"))]
    verb = [label("Person"), label("Number"), label("Tense"), label("Voice"), F.when(has("VerbForm", "Inf"), "infinitive").otherwise(label("Mood")), F.when(pos == "VERB", "verb").otherwise(kind)]
    return (
        F.when(has("VerbForm", *VERBAL_NOUNS), F.concat_ws(" ", *before, name, *agree))
        .when(has("VerbForm", "Inf") | F.coalesce(pos.isin("VERB", "AUX"), F.lit(False)), F.concat_ws(" ", *verb))
        .otherwise(F.concat_ws(" ", *agree, kind))
    )
