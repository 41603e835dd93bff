import math
import base64
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import language, mixture, tokenise, truncation

DOC = "doc_id bigint, text string, source string, kind string, ids string"


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(tokenise.TOKENIZERS, tokenise.VOCABULARY).read_bytes().splitlines() if x)}
    return ranks, tiktoken.Encoding("check", pat_str=tokenise.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_exact(reference):
    ranks, enc = reference
    ids_of = tokenise._tables(Path(tokenise.TOKENIZERS, tokenise.VOCABULARY).read_bytes())
    r = random.Random(4)
    tokens = list(ranks)
    texts = ["", None, " ", "\n\n  x", "a" * 3000, "'s 'S don't", "<|endoftext|>", "ὁ μὲν ποιμήν 📜 �", "  lead", "12345 67"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x800), r.randrange(0x3000, 0x9000)])) for _ in range(r.randrange(1, 30))) for _ in range(300)]
    texts += [b"".join(r.choice(tokens) for _ in range(r.randrange(1, 6))).decode("utf-8", "ignore") for _ in range(1500)]
    for t in texts:
        assert ids_of(t) == (enc.encode_ordinary(t) if t else []), t


def test_encode_documents(spark, reference):
    _, enc = reference
    df = spark.createDataFrame([(1, "arma virumque cano", "s", "verse", "x"), (2, None, None, None, None), (3, "", "", "", ""), (1, "arma virumque cano", "s", "verse", "x")], DOC)
    got = sorted((r.doc_id, r.ids) for r in tokenise.encode_documents(df, "doc_id", "text").collect())
    arma = enc.encode_ordinary("arma virumque cano")
    assert got == [(1, arma), (1, arma), (2, []), (3, [])]
    assert sorted((r.doc_id, r.source, r.n_tokens) for r in tokenise.token_count(df.where("doc_id < 3"), "doc_id", "text", keep=("source",)).collect()) == [(1, "s", len(arma)), (1, "s", len(arma)), (2, None, 0)]
    assert tokenise.encode_documents(df.limit(0), "doc_id", "text").count() == 0


def test_prefixes_by_brute_force(spark):
    r = random.Random(4)
    values = {"".join(r.choice("ab\n") for _ in range(r.randrange(0, 9))) for _ in range(400)}
    df = spark.createDataFrame([(v,) for v in values for _ in range(2)], "v string")
    got = {x.value: x.after for x in truncation.strict_prefixes(df.coalesce(1), "v").collect()}
    longer = {v: {w[len(v)] for w in values if w.startswith(v) and w != v} for v in values if v}
    assert set(got) == {v for v, a in longer.items() if a}
    assert sum((got[v] == "\n") != (a == {"\n"}) for v, a in longer.items() if a) <= 8  # only at the edges of partitions


def test_long_usual_closing_line(spark):
    end = "Cura ut valeas et nos, quod facis, ut amicum decet semper ama"
    rows = [(k, f"Salve {'x' * k}. Bene est.\n{end}", "post", "letter") for k in range(60)] + [(99, f"Salve. Bene est.\n{end[:41]}", "post", "letter")]
    assert [x.doc_id for x in truncation.truncations(spark.createDataFrame(rows, "doc_id bigint, text string, source string, kind string")).collect()] == [99]


def test_byte_outside_the_vocabulary():
    import pytest

    enc = tokenise.PrefixEncoder({b"a": 0, b"b": 1, b"ab": 2})
    assert enc.encode("abba") == [2, 1, 0]
    with pytest.raises(ValueError):
        enc.encode("abc")


def test_entry_rate_inverts_poisson(spark):
    cdf = lambda k, m: sum(math.exp(-m) * m**i / math.factorial(i) for i in range(k))
    rows = [(u, k) for u in (0.001, 0.2, 0.5, 0.9) for k in (1, 2, 3, 5)]
    df = spark.createDataFrame(rows, "u double, k int").withColumn("m", mixture._entry_rate(F.col("u"), F.col("k")))
    for r in df.collect():
        assert abs(cdf(r.k, r.m) - r.u) < 1e-4


def mix_tables(spark):
    r = random.Random(8)
    rows = [(k, "word " * r.randrange(5, 60), s, "x", "") for k, s in enumerate(["big"] * 900 + ["small"] * 60 + ["mid"] * 300 + ["other"] * 40)] + [(9000, None, "big", None, None), (9001, "", "mid", None, None), (9002, "x y", None, None, None)]
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.3, 3), ("mid", 0.25, 4), ("lost", 0.05, 9), ("none", None, 2), (None, 0.5, 2)], "source string, weight double, max_repeats int")
    return spark.createDataFrame(rows, DOC), targets


def test_entry_rate_beyond_any_cap(spark):
    rows = [(u, k) for u in (1e-9, 0.01, 0.5, 0.999) for k in (65, 80, 120, 1000)]
    df = spark.createDataFrame(rows, "u double, k int").withColumn("m", mixture._entry_rate(F.col("u"), F.col("k")))
    for r in df.collect():
        below = sum(math.exp(i * math.log(r.m) - r.m - math.lgamma(i + 1)) for i in range(r.k))
        assert abs(below - r.u) < 1e-6 * r.u + 1e-12, r


def test_many_repeats_of_a_small_source(spark):
    docs = spark.createDataFrame([(k, "a", "arma virumque cano " * 3) for k in range(40)] + [(100 + k, "b", f"word {k} " * 50) for k in range(800)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 120), ("b", 0.5, 1)], "source string, weight double, max_repeats int")
    got = {r.source: r for r in mixture.mixture(docs, targets)[1].collect()}
    assert got["a"].most_repeats > 64 and abs(got["a"].share - 0.5) < 0.02
    full = {r.source: r for r in mixture.mixture(docs, targets, "available")[1].collect()}
    assert sum(r.n_goal for r in full.values()) <= sum(r.n_available for r in full.values()) + 2


def test_mixture(spark):
    """Without a total every source that has documents is at its weight."""
    docs, targets = mix_tables(spark)
    chosen, shares = mixture.mixture(docs, targets)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "small", "mid", "lost", "none"} and got["lost"].n_tokens == got["none"].n_tokens == 0
    for s, w in (("big", 0.4), ("small", 0.3), ("mid", 0.25)):
        assert abs(got[s].share - w / 0.95) < 0.01 and got[s].most_repeats <= got[s].max_repeats
    assert got["small"].n_tokens == 3 * got["small"].n_available  # the one with the least room
    rows = chosen.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in got.values())
    again = {(r.doc_id, r.copy) for r in mixture.mixture(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.copy) for r in rows}


def test_mixture_larger_than_its_sources(spark):
    """With a large total the short source gives all it may, the others keep their proportion."""
    docs, targets = mix_tables(spark)
    got = {r.source: r for r in mixture.mixture(docs, targets, total_tokens=40_000)[1].collect()}
    assert got["small"].n_tokens == 3 * got["small"].n_available
    assert abs(got["big"].n_tokens / got["mid"].n_tokens - 0.4 / 0.25) < 0.05
    assert abs(sum(r.n_tokens for r in got.values()) - 40_000) < 500


def test_mixture_total_and_empty(spark):
    docs, targets = mix_tables(spark)
    got = {r.source: r for r in mixture.mixture(docs, targets, total_tokens=4000)[1].collect()}
    assert abs(got["small"].share - 0.3 / 0.95) < 0.02 and abs(got["big"].share - 0.4 / 0.95) < 0.02
    chosen, shares = mixture.mixture(docs.limit(0), targets)
    assert chosen.count() == 0 and shares.count() == 5
    assert mixture.mixture(docs, targets.limit(0))[0].count() == 0


PROSE = "Man vergleiche den Vers im nächsten Buch. Der Kampf kehrt hier wieder"
CUT = [
    (1, PROSE + ", und man dar", "forum", "commentary"), (2, PROSE + "…", "forum", "commentary"), (3, PROSE + " [...]", "forum", "commentary"), (4, PROSE + " de�", "forum", None),
    (5, "arma cano\nfata\nlongum carmen et al", "paste", "verse"), (6, PROSE + ".\nVa", "paste", "letter"),
]
WHOLE = [
    (20, PROSE + ".", "forum", "commentary"), (21, PROSE + '!"', "forum", "commentary"), (22, PROSE + ". [20]", "forum", "commentary"), (23, PROSE + ". 📜", "forum", "passage"), (24, PROSE + "?)\n", "forum", None),
    (25, "arma sonant\nfata\nlongum carmen", "paste", "verse"), (26, "os, -is: mouth\npes: foot\nmons: hill", "gloss", "glossary"), (27, None, "x", None), (28, "", "x", None), (29, " \n", "x", None), (30, "os: mouth\npes: foot\nmons: hill", "gloss", None),
]


def docs(spark, rows):
    letters = [(100 + k, f"{PROSE}. Nummer {'x' * k}.\nVale", "paste", "letter") for k in range(12)]
    tails = [(300 + k, "arma cano\nfata\nlongum carmen et altum mare\nmulta", "paste", "verse") for k in range(2)]
    spread = [(200 + k, "a" * (20 + 3 * k) + ".", "paste", "passage") for k in range(12)]
    return spark.createDataFrame([(*r, "clash") for r in [*rows, *letters, *tails, *spread]], DOC)


def test_truncations(spark):
    got = {r.doc_id: r.evidence for r in truncation.truncations(docs(spark, CUT + WHOLE)).collect()}
    assert got == {1: "open", 2: "mark", 3: "mark", 4: "mark", 5: "prefix", 6: "closing"}
    rates = {r.source: (r.n_cut, r.n_documents) for r in truncation.truncation_rates(docs(spark, CUT + WHOLE)).collect()}
    assert rates["forum"] == (4, 9) and rates["x"] == (0, 3)


def test_field_limit_of_verse(spark):
    r = random.Random(2)
    line = lambda: " ".join("".join(r.choice("aeiormst") for _ in range(r.randrange(3, 9))) for _ in range(6))
    poems = ["\n".join(line() for _ in range(r.randrange(2, 30))) for _ in range(300)]
    rows = [(k, t[:400] if k % 2 else t, "paste", "verse", "") for k, t in enumerate(poems)]
    got = {x.doc_id for x in truncation.truncations(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {k for k, t in enumerate(poems) if k % 2 and len(t) > 400 or len(t) == 400}


def test_field_limit_of_a_small_source(spark):
    """Four texts at one length among forty of scattered lengths are a limit, two are none."""
    r = random.Random(6)
    vocab = ["".join(r.choice("aeiormst") for _ in range(r.randrange(3, 9))) for _ in range(60)]
    poem = lambda n: "\n".join(" ".join(r.choice(vocab) for _ in range(6)) for _ in range(n))
    rows = [(k, poem(40)[: 600 if k < 4 else 700], "paste", "verse", "") for k in range(6)]
    rows += [(10 + k, poem(2 + k), "paste", "verse", "") for k in range(40)]
    got = {x.doc_id for x in truncation.truncations(spark.createDataFrame(rows, DOC)).where("evidence = 'limit'").collect()}
    assert got == {0, 1, 2, 3}


def test_verse_and_lists_cut_inside_a_word(spark):
    """Cut at no field limit, without mark or longer copy; an inflected or repeated word is no stump."""
    rows = [
        (1, "fata canunt\narma deum perfal", "paste", "verse", ""), (2, "arma deum\nfata ferunt Pērfal", "hymns", "verse", ""), (3, "os: mouth\nmons: moun", "gloss", "glossary", ""),
        (4, "fata canunt\narma deum resoluunt", "paste", "verse", ""), (5, "arma deum\nfata canunt et moun,", "paste", "verse", ""), (6, "fata ferunt\narma sine causis et fata", "paste", "verse", ""), (7, "arma\nfata deum zephyr", "paste", "verse", ""),
        (8, "Legunt et dicunt perfallendo resoluuntur in fatali mountain perfallit.", "forum", "commentary", ""),
    ]
    got = {r.doc_id: r.evidence for r in truncation.truncations(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: "word", 2: "word"}  # (5) shows that "moun" is a word
    got = {r.doc_id: r.evidence for r in truncation.truncations(spark.createDataFrame([r for r in rows if r[0] != 5], DOC)).collect()}
    assert got == {1: "word", 2: "word", 3: "word"}


def test_strict_prefixes(spark):
    values = ["ab", "abc", "abcd", "b", "", None, "bb", "ab", "c", "zz", "zzz"]
    got = {tuple(r) for r in truncation.strict_prefixes(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    assert got == {("ab", "c"), ("abc", "d"), ("b", "b"), ("zz", "z")}
    assert truncation.strict_prefixes(spark.createDataFrame([], "v string"), "v").count() == 0


def test_truncations_of_nothing(spark):
    assert truncation.truncations(spark.createDataFrame([], DOC)).count() == 0
    assert truncation.truncation_rates(spark.createDataFrame([], DOC)).count() == 0


TEXTS = {
    "la": ["Quaeritur cur poeta dixerit arma virumque.", "Alii legunt cum praepositione, sed melius sine ea intellegitur.", "Bene antiquos dixit, nec enim temporibus sine causa."],
    "en": ["The reader should not look for another meaning here.", "It is hardly possible that the poet wrote this line.", "Most copies give the older reading of the word."],
    "de": ["Man darf nicht an einen anderen Dichter denken.", "Die meisten Abschriften haben hier ein anderes Wort.", "Der Vers wiederholt den Gedanken der folgenden Zeile."],
    "fr": ["On ne doit pas chercher un autre sens dans cette phrase.", "La plupart des copies donnent une autre leçon.", "Il n'est pas certain que ce vers soit du même auteur."],
    "it": ["Non bisogna cercare un altro senso in questa frase.", "Quasi tutte le copie hanno una lezione diversa.", "Si può unire questa parola con il verso seguente."],
    "grc": ["Τοῦτο δὲ δηλοῖ ὁ πρῶτος ποταμὸς διὰ τὸν χρόνον.", "Οὐ γὰρ λέγει ὁ οἶκος περὶ τούτων, ἀλλὰ μικρός τις.", "Ὁ μὲν ποιμήν σοφός ἐστιν, ὁ δὲ νόμος τὸν τρόπον λέγει."],
}
NOTE = "id bigint, language string, text string, lemma string"


def note_rows():
    rows, k = [], 0
    for lang, texts in TEXTS.items():
        for t in texts * 4:
            rows.append((k, lang, t, ""))
            k += 1
    return rows


def test_mislabelled(spark):
    extra = [
        (900, None, TEXTS["de"][0], ""), (901, "unknown", TEXTS["fr"][1], ""), (902, "en", TEXTS["it"][2], ""), (903, "Latin", TEXTS["la"][1], ""), (904, "en-GB", TEXTS["en"][0], ""), (905, "el", TEXTS["grc"][0], ""),
        (906, "de", TEXTS["de"][1] + " " + TEXTS["en"][1], ""), (907, "de", "Das Wort 'quaeritur cur poeta dixerit' ist hier nicht an einen anderen Dichter gerichtet. Cf. οἶκος νόμος λόγος.", ""), (908, None, None, ""), (909, "", "", ""), (910, "la", "12 !", ""), (911, "en", TEXTS["en"][0].upper(), ""),
        (900, None, TEXTS["de"][0], ""),
    ]
    df = spark.createDataFrame(note_rows() + extra, NOTE)
    got = sorted((r.note_id, r.language) for r in language.mislabelled(df).collect() if r.note_id >= 900)
    assert got == [(900, "de"), (901, "fr"), (902, "it"), (906, "de"), (906, "en")]
    seg = {(r.segment, r.language, r.sentences) for r in language.segments(df).where("note_id = 906").collect()}
    assert seg == {(1, "de", 1), (2, "en", 1)}
    assert language.mislabelled(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    """Trained on three quarters of the labelled notes of a test table, tried on the rest."""
    path = Path("/root/testdata/sf0.01/note.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    notes = spark.read.parquet(str(path)).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(4)))
    model = language.trained(notes.where("fold > 0"))
    got = language.segments(notes.where("fold = 0"), model).where("label IS NOT NULL AND label <> 'other'")
    n, right = got.count(), got.where("label = language").count()
    assert n > 300 and right / n > 0.9  # labels of about one note in twenty are wrong by design


def test_labels(spark):
    values = ["LA", " la ", "Latin", "lat", "en-GB", "German", "ger", "Français", "el", "GRC", "-", "", None, "und", "unknown", "es", "Ancient Greek"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = [r.x for r in df.select("k", language.label_language(F.col("v")).alias("x")).orderBy("k").collect()]
    assert got == ["la"] * 4 + ["en", "de", "de", "fr", "grc", "grc", None, None, None, None, None, "other", "grc"]
