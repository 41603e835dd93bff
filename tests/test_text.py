from pyspark.sql import functions as F

from scriptorium.functions import forms
from scriptorium.functions.refs import plain_ref
from scriptorium.functions.text import shingles, strip_blanks, words


def column(spark, values, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


def test_words(spark):
    got = column(spark, ["Arma virumque canō", "ARMA VIRVMQVE CANO", "Lāvīniaque, jam; œcæ", "volnus uos seruos equom quoi", None, "", " \t12 "], words)
    assert got[0] == got[1] == ["arma", "uirumque", "cano"]
    assert got[2] == ["lauiniaque", "iam", "oecae"]
    assert got[3] == ["uulnus", "uos", "seruus", "equum", "cui"]
    assert got[4:] == [[], [], []]


def test_shingles_need_five_words(spark):
    got = column(spark, ["a b c d", "a b c d e f", None], lambda c: shingles(words(c)))
    assert got == [[], ["a b c d e", "b c d e f"], []]


def test_plain_ref(spark):
    got = column(spark, ["XIV.iv", " 001 . 014.", "１２:3", "MCMXC", "1,, 0", None, "", "2.pr"], plain_ref)
    assert got == ["14.4", "1.14", "12.3", "1990", "1.0", None, "", "2.pr"]


def test_strip_blanks(spark):
    assert column(spark, ["  a b \n", None, "\t"], strip_blanks) == ["a b", None, ""]


def test_folds_and_origins(spark):
    df = spark.createDataFrame([("[C]æsar “ſic” Canō",), (None,), ("",)], "v string").select("v", forms.fold_index(F.col("v")).alias("x"), forms.fold_display(F.col("v")).alias("d"), forms.strip_quantities(F.col("v")).alias("q"))
    rows = df.select("v", "x", "d", "q", forms.original_slice(F.col("v"), F.col("x"), F.lit(0), F.lit(3)).alias("o"), forms.original_span(F.col("x"), F.lit(2), F.lit(2)).alias("none")).collect()
    assert rows[0].x.text == 'caesar "sic" cano' and rows[0].d.text == 'Caesar "sic" Canō' and rows[0].q == "[C]æsar “ſic” Cano"
    assert rows[0].o == "C]æ" and rows[0].none is None
    assert rows[0].x.origin[:4] == [1, 3, 3, 4]
    assert rows[1].q is None and rows[2].x.text == ""


def test_enclitics(spark):
    got = column(spark, ["uirumque", "quinque", "mecum", "uirgine", "tune", "breue", "aliudue", "que", None, "quicumque"], forms.split_enclitic)
    assert [(r.stem, r.enclitic) if r else None for r in got] == [("uirum", "que"), ("quinque", None), ("me", "cum"), ("uirgine", None), ("tu", "ne"), ("breue", None), ("aliudue", None), ("que", None), None, ("quicumque", None)]


def test_known_words_stay_whole(spark):
    got = column(spark, ["undique", "armaque", "xque"], lambda w: forms.split_enclitic(w, known=w == "armaque", stem_known=lambda s: s != "und"))
    assert [r.enclitic for r in got] == [None, None, None]


def test_describe_morph(spark):
    golden = [
        ({"Case": "Abl", "Number": "Sing", "Gender": "Fem"}, "NOUN", "feminine ablative singular noun"),
        ({"Mood": "Ind", "Person": "3", "Number": "Sing", "Tense": "Pres", "Voice": "Act", "VerbForm": "Fin"}, "VERB", "3rd person singular present active indicative verb"),
        ({"VerbForm": "Part", "Tense": "Past", "Voice": "Pass", "Case": "Nom", "Number": "Plur", "Gender": "Masc"}, "VERB", "perfect passive participle masculine nominative plural"),
        ({"VerbForm": "Part", "Aspect": "Prosp", "Voice": "Pass", "Case": "Nom"}, "VERB", "gerundive nominative"), ({"VerbForm": "Part", "Aspect": "Prosp", "Voice": "Act"}, "VERB", "future active participle"),
        ({"VerbForm": "Part", "Aspect": "Imp", "Case": "Acc"}, "ADJ", "present participle accusative"), ({"VerbForm": "Ger", "Case": "Gen", "Tense": "Pres"}, "VERB", "gerund genitive"), ({"VerbForm": "Sup"}, "VERB", "supine"),
        ({"VerbForm": "Inf", "Tense": "Past", "Voice": "Act"}, "VERB", "perfect active infinitive verb"), ({"VerbForm": "Inf", "Tense": "Pres"}, "AUX", "present infinitive auxiliary verb"), ({"Tense": "Imp", "Mood": "Sub"}, "VERB", "Imp subjunctive verb"),
        ({}, "ADP", "preposition"), (None, "ADV", "adverb"), ({"Case": ""}, "SYM", "sym"), ({}, "CCONJ", "coordinating conjunction"), ({"Case": "Xyz"}, "PRON", "Xyz pronoun"),
    ]
    df = spark.createDataFrame([(k, m, p) for k, (m, p, _) in enumerate(golden)], "k int, m map<string,string>, p string")
    got = {r[0]: r[1] for r in df.select("k", forms.describe_morph(F.col("m"), F.col("p"))).collect()}
    assert got == {k: d for k, (*_, d) in enumerate(golden)}


def test_surface_form(spark):
    df = spark.createDataFrame([("Arma Virumque", 5, "uirumque"), ("Arma", 2, "mamma"), (None, 0, "x")], "o string, s int, p string")
    assert [r[0] for r in df.select(forms.surface_form(F.col("o"), F.col("s"), F.col("p"))).collect()] == ["Virumque", "mamma", "x"]
