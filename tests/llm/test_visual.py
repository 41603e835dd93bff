import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions.text import words
from scriptorium.llm.visual import changed_values, consistent_values, plain_text

CASES = [
    ("ａｂｃ def", "abc def"), ("su‌bponit", "subponit"), ("a b c　d", "a b c d"), ("praecremavеrunt", "praecremaverunt"), ("hօmines", "homines"), ("consiliο.", "consilio."),
    ("exvivendō", "exvivendō"), ("ﬂuviis oﬀicium ofﬁcina", "fluviis officium officina"), ("iɡitur", "igitur"), ("vero﻿̄rum", "verōrum"), ("ọ̄", "ọ̄"), ("ọ̄", "ọ̄"),
    ("χρόνoς", "χρόνος"), ("Βeispiel Αusdruck", "Beispiel Ausdruck"), ("​", ""), ("​Regula", "Regula"), ("é̄x", "é̄x"),
]
PLAIN = ["", None, "lætarum ōrum Ætas", "(берег сказка)", "[y̆, v̄]", "Ὁ μὲν ποιμήν σοφός ἐστιν", "für così été", "a\nb\tc", "…", "слово word", "ᏣᎳᎩ ⲁⲛⲟⲕ", "ꓐꓯ"]


def test_cases(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(CASES)], "k int, t string")
    got = {r.k: r.canonical for r in changed_values(df, "t").collect()}
    assert {k: got.get(k) for k in range(len(CASES))} == {k: b for k, (_, b) in enumerate(CASES)}


def test_no_case(spark):
    df = spark.createDataFrame([(k, a) for k, a in enumerate(PLAIN)], "k int, t string")
    assert changed_values(df, "t").count() == 0
    assert {r.k: r.canonical for r in consistent_values(df, "t").collect()} == dict(enumerate(PLAIN))


def test_repeats_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "ａ", "x"), (1, "ａ", "x"), (2, None, None)], "k int, t string, text string")
    rows = changed_values(df, "t").collect()
    assert [(r.k, r.t, r.text, r.canonical) for r in rows] == [(1, "ａ", "x", "a")] * 2
    assert changed_values(df.limit(0), "t").count() == 0
    assert consistent_values(df, "t").count() == 3


def test_long_text(spark):
    long = "canο " * 20_000
    assert changed_values(spark.createDataFrame([(1, long)], "k int, t string"), "t").first().canonical == "cano " * 20_000


def test_words_agree(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(CASES)] + [(99, None)], "k int, t string")
    a = {r.k: r.w for r in consistent_values(df, "t").select("k", words(F.col("canonical")).alias("w")).collect()}
    b = {r.k: r.w for r in df.select("k", words(plain_text(F.col("t"))).alias("w")).collect()}
    assert a == b


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="aeoxῡ̣̆́ éōʼ", max_size=12), min_size=1, max_size=40))
def test_composition_is_nfc(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.canonical for r in consistent_values(df, "t").collect()}
    for k, t in enumerate(texts):
        assert unicodedata.normalize("NFC", got[k]) == got[k]
        if not any("GREEK" in unicodedata.name(c) for c in t):
            assert got[k] == unicodedata.normalize("NFC", t)
