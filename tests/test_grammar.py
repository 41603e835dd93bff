import pytest

from scriptorium.operators.constructions import DETECTORS, catalogue, constructions, detector, nominal_absolutes, token_tags
from scriptorium.operators.figures import anaphora, figures
from scriptorium.operators.gate import anomalies
from scriptorium.operators.token_context import TOKEN_SCHEMA


def tokens(spark, *sentences):
    """Sentences of (text, lemma, pos, dep, head, morph[, ent]) tuples."""
    rows = []
    for s, sent in enumerate(sentences):
        for i, (text, lemma, pos, dep, head, morph, *ent) in enumerate(sent):
            rows.append((1, s, i, text, lemma, pos, dep, head, morph, [], (ent or [""])[0], ""))
    return spark.createDataFrame(rows, TOKEN_SCHEMA)


def clause(marker, governor, mood="Sub", dep="advcl", extra=()):
    return [(governor, governor, "VERB", "ROOT", 0, {"Mood": "Ind", "VerbForm": "Fin"}), (marker, marker, "SCONJ", "mark", 2, {}), ("faciat", "facio", "VERB", dep, 0, {"Mood": mood, "VerbForm": "Fin"}), *extra]


def keys(spark, sent):
    return {r.key for r in constructions(tokens(spark, sent)).collect()}


CLAUSES = [
    ("quominus", "impedio", "Sub", "ccomp", "hindering_clause"), ("ut", "impero", "Sub", "ccomp", "substantive_purpose"), ("ne", "moneo", "Sub", "ccomp", "substantive_purpose"),
    ("ut", "accido", "Sub", "csubj", "substantive_result"), ("quia", "uenio", "Ind", "advcl", "causal_clause"), ("quod", "gaudeo", "Ind", "ccomp", "substantive_quod"),
    ("quamvis", "uenio", "Sub", "advcl", "concessive_clause"), ("dummodo", "uenio", "Sub", "advcl", "proviso_clause"), ("antequam", "uenio", "Ind", "advcl", "temporal_before"),
    ("priusquam", "uenio", "Sub", "advcl", "temporal_before"), ("donec", "uenio", "Ind", "advcl", "temporal_until"), ("si", "uenio", "Ind", "advcl", "conditional_clause"), ("nisi", "uenio", "Sub", "advcl", "conditional_clause"),
]


def test_clauses(spark):
    sents = [clause(m, g, mood, dep) for m, g, mood, dep, _ in CLAUSES]
    got = {}
    for r in constructions(tokens(spark, *sents)).collect():
        got.setdefault(r.sent_id, set()).add(r.key)
    for k, (*_, key) in enumerate(CLAUSES):
        assert key in got.get(k, set()), CLAUSES[k]
    assert "purpose_clause" not in got[1]  # gives way to the substantive clause


def test_exact_sets(spark):
    negative = ("non", "non", "PART", "advmod", 0, {})
    only = {"proviso_clause", "temporal_until"}
    assert keys(spark, clause("dum", "uenio")) == only
    assert keys(spark, clause("dum", "uenio", "Ind")) == {"temporal_until"}
    assert "hindering_clause" not in keys(spark, clause("quin", "dubito", dep="ccomp"))
    assert "hindering_clause" in keys(spark, clause("quin", "dubito", dep="ccomp", extra=[negative]))


NOUN = {"Case": "Abl", "Number": "Sing"}
CASES = [
    ("ablative_absolute", [("urbe", "urbs", "NOUN", "nsubj:pass", 1, NOUN), ("capta", "capio", "VERB", "advcl:abs", 2, {"Case": "Abl", "VerbForm": "Part", "Voice": "Pass"}), ("fugerunt", "fugio", "VERB", "ROOT", 2, {"VerbForm": "Fin"})]),
    ("dative_of_possession", [("mihi", "ego", "PRON", "obl", 1, {"Case": "Dat"}), ("est", "sum", "AUX", "ROOT", 1, {"VerbForm": "Fin"}), ("liber", "liber", "NOUN", "nsubj", 1, {"Case": "Nom"})]),
    ("dative_special_verb", [("regi", "rex", "NOUN", "obl", 1, {"Case": "Dat"}), ("servit", "servio", "VERB", "ROOT", 1, {"VerbForm": "Fin"})]),
    ("genitive_of_charge", [("Verrem", "Verres", "PROPN", "obj", 2, {"Case": "Acc"}), ("avaritiae", "avaritia", "NOUN", "nmod", 0, {"Case": "Gen"}), ("accusat", "accuso", "VERB", "ROOT", 2, {"VerbForm": "Fin"})]),
    ("ablative_of_agent", [("a", "ab", "ADP", "case", 1, {}), ("rege", "rex", "NOUN", "obl", 2, NOUN), ("laudatur", "laudo", "VERB", "ROOT", 2, {"Voice": "Pass", "VerbForm": "Fin"})]),
    ("passive_periphrastic", [("Carthago", "Carthago", "PROPN", "nsubj", 1, {"Case": "Nom"}), ("delenda", "deleo", "VERB", "ROOT", 1, {"VerbForm": "Gdv"}), ("est", "sum", "AUX", "cop", 1, {"VerbForm": "Fin"})]),
    ("gerund_accusative_purpose", [("ad", "ad", "ADP", "case", 1, {}), ("discendum", "disco", "VERB", "advcl", 2, {"VerbForm": "Ger", "Case": "Acc"}), ("venit", "venio", "VERB", "ROOT", 2, {"VerbForm": "Fin"})]),
    ("indirect_statement", [("dicit", "dico", "VERB", "ROOT", 0, {"VerbForm": "Fin"}), ("Caesarem", "Caesar", "PROPN", "nsubj", 2, {"Case": "Acc"}, "LOC"), ("venire", "venio", "VERB", "ccomp", 0, {"VerbForm": "Inf"})]),
]


@pytest.mark.parametrize("key,sent", CASES)
def test_case_uses(spark, key, sent):
    assert key in keys(spark, sent)


def test_no_destination_without_motion(spark):
    assert "accusative_place_to_which" not in keys(spark, CASES[-1][1])


def test_nominal_absolute_takes_each_word_once(spark):
    abl = {"Case": "Abl", "Number": "Sing"}
    sent = [("Cicerone", "Cicero", "PROPN", "obl", 3, abl), ("consule", "consul", "NOUN", "nmod", 0, abl), ("duce", "dux", "NOUN", "obl", 3, abl), ("vixit", "vivo", "VERB", "ROOT", 3, {})]
    assert [(r.tokens, r.anchor) for r in nominal_absolutes(tokens(spark, sent)).collect()] == [("0,1", 1)]


def test_odd_tokens(spark):
    rows = [(1, 0, 0, "", None, "X", None, 9, None, None, None, None), (1, 0, 0, "", None, "X", None, 9, None, None, None, None), (1, 1, 0, "a", "a", "NOUN", "obj", 0, {"Case": None}, [], "", "")]
    df = spark.createDataFrame(rows, TOKEN_SCHEMA)
    assert constructions(df).count() >= 0 and figures(df).count() >= 0
    empty = spark.createDataFrame([], TOKEN_SCHEMA)
    assert constructions(empty).count() == 0 and figures(empty).count() == 0 and anomalies(empty).count() == 0


def test_registered_detector(spark):
    @detector("mine")
    def mine(t):
        from pyspark.sql import functions as F

        return t.where("i = 0").select("doc_id", "sent_id", F.lit("mine").alias("key"), F.col("i").alias("anchor"), F.lit("0").alias("tokens"), F.lit(0.1).alias("confidence"))

    try:
        assert "mine" in keys(spark, CASES[0][1])
    finally:
        del DETECTORS["mine"]


def test_tags(spark):
    tags = {r.i: r["keys"] for r in token_tags(constructions(tokens(spark, CASES[0][1]))).collect()}
    assert "ablative_absolute" in tags[0] and "ablative_absolute" in tags[1]


def test_planted_sentences(spark):
    """Each sentence parsed by hand gives what its name says."""
    from scriptorium.sources.surrogate import PLANTED

    sents = [[(word or lemma, lemma, pos, dep, head, dict(f.split("=") for f in feats.split())) for word, lemma, pos, dep, head, feats in t] for t in PLANTED.values()]
    t = tokens(spark, *sents)
    got: dict[int, set] = {}
    for r in constructions(t).select("sent_id", "key").union(figures(t).select("sent_id", "key")).collect():
        got.setdefault(r.sent_id, set()).add(r.key)
    missing = {name for k, name in enumerate(PLANTED) if name.rstrip("=") not in got.get(k, set())}
    assert not missing
    labels = {r.label for r in constructions(t).where("key = 'conditional_clause'").collect()}
    assert labels == {"contrary to fact"}


LABELLED = [
    ("cum_clause", "circumstantial or causal", [("cum", "cum", "SCONJ", "mark", 1, {}), ("esset", "sum", "VERB", "advcl", 2, {"Mood": "Sub", "Tense": "Past"}), ("venit", "venio", "VERB", "ROOT", 2, {"VerbForm": "Fin"})]),
    ("cum_clause", "causal or concessive", [("cum", "cum", "SCONJ", "mark", 1, {}), ("sit", "sum", "VERB", "advcl", 2, {"Mood": "Sub", "Tense": "Pres"}), ("venit", "venio", "VERB", "ROOT", 2, {"VerbForm": "Fin"})]),
    ("cum_clause", "temporal", [("cum", "cum", "SCONJ", "mark", 1, {}), ("venit", "venio", "VERB", "advcl", 2, {"Mood": "Ind"}), ("vidit", "video", "VERB", "ROOT", 2, {"VerbForm": "Fin"})]),
    ("subjunctive_independent", "hortatory, negated", [("ne", "ne", "PART", "advmod", 1, {}), ("eamus", "eo", "VERB", "ROOT", 1, {"Mood": "Sub", "Person": "1", "Number": "Plur"})]),
    ("subjunctive_independent", "deliberative", [("eam", "eo", "VERB", "ROOT", 0, {"Mood": "Sub", "Person": "1", "Number": "Sing"})]),
    ("subjunctive_independent", "jussive", [("eat", "eo", "VERB", "ROOT", 0, {"Mood": "Sub", "Person": "3"})]),
    ("subjunctive_independent", "optative or potential", [("eas", "eo", "VERB", "ROOT", 0, {"Mood": "Sub", "Person": "2"})]),
    ("supine", "accusative, purpose", [("rogatum", "rogo", "VERB", "ROOT", 0, {"VerbForm": "Sup"})]), ("supine", "ablative, respect", [("dictu", "dico", "VERB", "ROOT", 0, {"VerbForm": "Sup"})]),
    ("ablative_absolute", "completed action", CASES[0][1]),
]


def test_labels(spark):
    rows = {(r.sent_id, r.key): r.label for r in constructions(tokens(spark, *[x for *_, x in LABELLED])).collect()}
    assert {k: rows.get((k, key)) for k, (key, *_) in enumerate(LABELLED)} == {k: label for k, (_, label, _) in enumerate(LABELLED)}


def test_catalogue(spark):
    rows = catalogue(spark).collect()
    assert len(rows) == 99 and sum(r.family != "figure" for r in rows) == 82


def word(text, pos="NOUN", dep="obj", head=None, i=0, **morph):
    return (text, text, pos, dep, i if head is None else head, morph)


def found(spark, *sents, groups=None):
    return {(r.key, r.tokens) for r in figures(tokens(spark, *sents), groups).collect()}


def test_figures(spark):
    allit = [word(w, i=k) for k, w in enumerate("magno misceri murmure pontum".split())]
    assert ("alliteration", "0,1,2") in found(spark, allit)
    gap = [word("altae", "ADJ", "amod", 4, 0), *[word(w, i=k + 1) for k, w in enumerate("moenia tum ingens".split())], word("Romae", i=4)]
    assert ("hyperbaton", "0,4") in found(spark, gap)
    # a1 b1 n2 n1: mirrored pairs
    chi = [word("a", "ADJ", "amod", 3, 0), word("b", "ADJ", "amod", 2, 1), word("c", i=2), word("d", i=3)]
    assert not {k for k, _ in found(spark, chi, groups=["order"])} & {"chiasmus"}  # the inner pair is adjacent
    syn = [word("a", "ADJ", "amod", 2, 0), word("b", "ADJ", "amod", 3, 1), word("c", i=2), word("d", i=3)]
    assert ("synchysis", "0,1,2,3") in found(spark, syn, groups=["order"])
    lit = [word("non", i=0), word("ignarus", "ADJ", i=1)]
    assert ("litotes", "0,1") in found(spark, lit)
    tri = [word("veni", "VERB", i=0), word("vidi", "VERB", "conj", 0, 1), word("vici", "VERB", "conj", 0, 2)]
    assert {("tricolon", "0,1,2"), ("asyndeton", "0,1,2")} <= found(spark, tri)
    assert ("ellipsis", "0,1,2") in found(spark, tri)


def test_surface_asyndeton(spark):
    sent = [word("veni", "VERB", i=0), (",", ",", "PUNCT", "punct", 0, {}), word("vidi", "VERB", i=2), (",", ",", "PUNCT", "punct", 0, {}), word("vici", "VERB", i=4)]
    assert ("asyndeton", "0,2,4") in found(spark, sent)


def test_anaphora(spark):
    s = [[word(w, i=k) for k, w in enumerate(t.split())] for t in ("Nihil te fugit", "Nihil me fallit", "nihil nos terret", "Omnia vincit", "Amor est")]
    assert [(r.sent_id, r.tokens) for r in anaphora(tokens(spark, *s)).collect()] == [(0, "0:0,1:0,2:0")]
    assert anaphora(tokens(spark, *s[2:])).count() == 0


def test_anomalies(spark):
    wrong = [("bona", "bonus", "ADJ", "amod", 1, {"Case": "Nom"}), ("viri", "vir", "NOUN", "ROOT", 1, {"Case": "Gen"})]
    got = {(r.kind, r.i, r.feature) for r in anomalies(tokens(spark, wrong)).collect()}
    assert got == {("agreement", 0, "Case"), ("no_finite_verb", 0, "")}
    apart = [wrong[0][:4] + (4, wrong[0][5]), *[word(w, i=k + 1) for k, w in enumerate("x y z".split())], ("viri", "vir", "NOUN", "ROOT", 4, {"Case": "Gen", "VerbForm": "Fin"})]
    assert anomalies(tokens(spark, apart)).count() == 0 and anomalies(tokens(spark, apart), suppress=False).count() == 1


def test_explained(spark):
    from scriptorium.operators.constructions import explained

    t = tokens(spark, CASES[0][1])
    row = [r for r in explained(constructions(t), t).collect() if r.key == "ablative_absolute"][0]
    assert (row.words, row.name, row.strength) == ("urbe capta", "Ablative Absolute", "high") and row.evidence == "'urbe capta': Ablative Absolute (A&G 419)"
    assert all(r.name for r in explained(figures(t), t).collect())
    gap = tokens(spark, [word("altae", "ADJ", "amod", 4, 0), *[word(w, i=k + 1) for k, w in enumerate("moenia tum ingens".split())], word("Romae", i=4)])
    row = [r for r in explained(figures(gap), gap).collect() if r.key == "hyperbaton"][0]
    assert (row.words, row.between) == ("altae Romae", "moenia tum ingens")
    place = tokens(spark, [("caelo", "caelum", "NOUN", "obl", 1, {"Case": "Dat"}), ("venit", "venio", "VERB", "ROOT", 1, {"VerbForm": "Fin"})])
    assert "verse" in [r.caveat for r in explained(constructions(place), place).collect() if r.key == "dative_direction"][0]


def test_anaphora_over_blocks(spark, monkeypatch):
    from scriptorium.operators import figures as f

    openings = "a a b b b a a a a a a a c a d d".split()
    sents = [[word(w, i=0), word("x", i=1)] for w in openings]
    monkeypatch.setattr(f, "SENTENCE_BLOCK", 3)
    got = sorted((r.sent_id, r.tokens.count(":")) for r in f.anaphora(tokens(spark, *sents)).collect())
    assert got == [(0, 2), (2, 3), (5, 7), (14, 2)]
