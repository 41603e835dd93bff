from pyspark.sql import functions as F

from scriptorium.plans.assemble import admitted, analyse, ranked_readings, to_documents
from scriptorium.sources import sinks
from scriptorium.sources.plain import read_conllu, read_library, stored_form
from scriptorium.sources.surrogate import annotate
from scriptorium.sources.tei import Commentary, Edition, read_commentaries, read_editions
from scriptorium.streaming import passages

VERSE = """<?xml version="1.0"?><!DOCTYPE TEI.2 PUBLIC "x" "y" [<!ENTITY mdash "-">]>
<TEI.2><teiHeader/><text><body><div1 type="Book" n="1"><l n="1">arma  virumque &mdash;cano</l><l>Troiae <note>no</note>qui</l><l n="5">quinta</l><l> </l></div1>
<div1 type="book"><l>no number</l></div1><div1 type="book" n="2"><p>una\nduae\n\ntres</p></div1></body></text></TEI.2>"""
PROSE = """<TEI.2><text><body><div1 type="book" n="1"><head>Liber</head><p>ante <milestone unit="chapter" n="1"/>Gallia <milestone unit="section" n="2"/>est <pb/>omnis
<milestone unit="section" n="2.3"/>divisa<note>x</note> in</p></div1></body></text></TEI.2>"""
NOTES = """<TEI.2><text><body><div1 type="Book" n="1"><div2 type="commline" n="1-7"><p><hi rend="caps">Arma]</hi>bella<pb/> dicit .</p></div2><div2 type="commline" n="pr"><p>praefatio</p></div2></div1>
<div2 type="commline" n="3"><p>no book</p></div2></body></text></TEI.2>"""
WORDS = """<TEI.2><text><body><div1 type="chapter" n="9"><p><lemma>no</lemma> note</p></div1><div1 type="book" n="1"><div2 type="Chapter" n="2"><p>before <lemma>Gallia,</lemma> tota; <bibl n="AG 495">x</bibl>;
<bibl n="AG 495"/> sic <lemma>est</lemma> : verbum magnum</p></div2></div1></body></text></TEI.2>"""


def write(folder, **files):
    for name, text in files.items():
        (folder / name.replace("_", ".")).write_text(text, encoding="utf-8")
    return str(folder)


def test_editions(spark, tmp_path):
    folder = write(tmp_path, v_xml=VERSE, p_xml=PROSE, bad_xml="<a>")
    got = read_editions(spark, folder, [Edition("v", "v.xml"), Edition("p", "p.xml", verse=False, milestones=("chapter", "section")), Edition("b", "bad.xml"), Edition("none", "none.xml")])
    rows = [(r.work, r.ref, r.leaf, r.text) for r in got.orderBy("work", "seq").collect()]
    assert rows == [
        ("p", "1.1", 1, "Gallia"), ("p", "1.1", 2, "est omnis"), ("p", "1.2", 3, "divisa in"),
        ("v", "1", 1, "arma virumque cano"), ("v", "1", 2, "Troiae noqui"), ("v", "1", 5, "quinta"), ("v", "2", 1, "una"), ("v", "2", 2, "duae"), ("v", "2", 3, "tres"),
    ]


def test_commentaries(spark, tmp_path):
    folder = write(tmp_path, n_xml=NOTES, w_xml=WORDS)
    got = read_commentaries(spark, folder, [Commentary("s", "S", "v", "la", "n.xml"), Commentary("w", "W", "c", "en", "w.xml", ("book", "chapter"), "lemma-prose")])
    rows = [(r.source, r.ref, r.line_start, r.line_end, r.lemma, r.grammar, r.text) for r in got.orderBy("source", "seq").collect()]
    assert rows == [("s", "1", 1, 7, "arma", "", "Arma] bella"), ("s", "1", None, None, "", "", "praefatio"), ("w", "1.2", None, None, "gallia", "AG 495", "tota; sic"), ("w", "1.2", None, None, "est", "", "verbum magnum")]


def test_broken_files_and_odd_markup(spark):
    from scriptorium.sources.tei import commentary_notes, edition_units

    section = '<TEI.2><div1 type="Speech" n="1"><p>Quo <milestone unit="section" n="2"/>usque <note>a <hi>b</hi></note>tandem<milestone unit="page" n="9"/> abutere</p></div1><div1 type="speech" n="x"><p>no</p></div1></TEI.2>'
    deep = '<TEI.2><div1 type="book" n="1"><div2 type="poem" n="3"><l>unus</l><l n="9">nouem</l><l/><l>undecim</l></div2></div1></TEI.2>'
    turned = '<TEI.2><div1 type="book" n="1"><p>ante<milestone unit="chapter" n="4"/>quattuor<milestone unit="chapter" n="pr"/>nusquam<milestone unit="section" n="5.0"/>quinque</p></div1></TEI.2>'
    files = spark.createDataFrame([("d/s.xml", section), ("d/p.xml", deep), ("d/t.xml", turned), ("d/bad.xml", "<a><b></a>"), ("d/null.xml", None), ("d/other.xml", "<a/>")], "path string, raw string")
    units, broken = edition_units(files, [Edition("s", "s.xml", ("speech",), False, ("section",)), Edition("p", "p.xml", ("book", "poem")), Edition("t", "t.xml", ("book",), False, ("chapter", "section")), Edition("b", "bad.xml"), Edition("n", "null.xml"), Edition("whole", "p.xml", ())])
    assert sorted((r.work, r.ref, r.leaf, r.text) for r in units.collect()) == [
        ("p", "1.3", 1, "unus"), ("p", "1.3", 9, "nouem"), ("p", "1.3", 11, "undecim"), ("s", "1", 1, "Quo"), ("s", "1", 2, "usque tandemb abutere"), ("t", "1.4", 1, "quattuor"), ("t", "1.5", 1, "quinque"),
        ("whole", "", 1, "unus"), ("whole", "", 9, "nouem"), ("whole", "", 11, "undecim"),
    ]
    assert [(r.path, r.spec) for r in broken.collect()] == [("d/bad.xml", "b")]
    note = "<TEI.2><div1 type='book' n='2'><div2 type='COMMLINE' n='4 – 6'><p>vide ' arma '<hi rend='CAPS'>[Regi na:</hi>, ( sic )!</p></div2><div2 type='commline' n='9'><pb/></div2></div1></TEI.2>"
    got = commentary_notes(spark.createDataFrame([("n.xml", note), ("m.xml", "")], "path string, raw string"), [Commentary("s", "S", "v", "la", "n.xml"), Commentary("m", "M", "v", "la", "m.xml")])
    assert [(r.ref, r.line_start, r.line_end, r.lemma, r.text) for r in got[0].collect()] == [("2", 4, 6, "regi na", "vide 'arma' [Regi na:, (sic)!")] and got[1].count() == 1


def test_notes_are_put_together_as_they_are_read(spark, monkeypatch):
    """No event is written, and none is shuffled by its commentary, which has one value or a few."""
    from scriptorium.sources import tei

    def written(df):
        raise AssertionError("events are written")

    monkeypatch.setattr(tei, "materialise", written)
    files = spark.createDataFrame([("d/n.xml", NOTES), ("d/w.xml", WORDS), ("d/bad.xml", "<a>"), ("d/null.xml", None), ("d/other.xml", "<a>")], "path string, raw string")
    lines, words = Commentary("s", "S", "v", "la", "n.xml"), Commentary("w", "W", "c", "en", "w.xml", ("book", "chapter"), "lemma-prose")
    notes, broken = tei.commentary_notes(files, [lines, words, Commentary("b", "B", "v", "la", "bad.xml"), Commentary("0", "N", "v", "la", "null.xml")])
    assert sorted((r.source, r.ref, r.lemma, r.text) for r in notes.collect()) == [("s", "1", "", "praefatio"), ("s", "1", "arma", "Arma] bella"), ("w", "1.2", "est", "verbum magnum"), ("w", "1.2", "gallia", "tota; sic")]
    assert [(r.path, r.spec) for r in broken.collect()] == [("d/bad.xml", "b")]
    plan = notes._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(spec#" not in plan and "BroadcastHashJoin" in plan
    assert [r.source for r in tei.commentary_notes(files, [words])[0].collect()] == ["w", "w"] and not tei.commentary_notes(files, [])[0].count()


def test_tables_of_works_and_commentaries(spark):
    from scriptorium.sources.tei import COMMENTARIES, EDITIONS, works_of

    assert len({e.work for e in EDITIONS}) == len(EDITIONS) == 15 and {c.work for c in COMMENTARIES} <= {e.work for e in EDITIONS}
    assert {r.unit for r in works_of(spark).collect()} == {"line", "section"}


def test_library(spark, tmp_path):
    (tmp_path / "caesar").mkdir()
    write(tmp_path / "caesar", a_txt="CAESAR\n\nliber primus est\n[ 1 ] Gallia est omnis\ndivisa in partes\n[2] Hi omnes lingua differunt", b_txt="12\nTitulus\nunus duo tres\nquattuor quinque sex septem\nocto novem\n", index_txt="a b c d", empty_txt="")
    rows = [(r.path[-5:], r.author, r.title, r.ref, r.leaf, r.text) for r in read_library(spark, str(tmp_path)).orderBy("path", "seq").collect()]
    assert rows == [("a.txt", "caesar", "CAESAR", "1", 1, "Gallia est omnis divisa in partes"), ("a.txt", "caesar", "CAESAR", "2", 1, "Hi omnes lingua differunt"), ("b.txt", "caesar", "Titulus", "", 1, "quattuor quinque sex septem")]
    assert stored_form(spark.createDataFrame([("x" * 900,)], "text string")).select(F.length("text")).first()[0] == 400


def test_conllu(spark, tmp_path):
    line = "\t".join
    block = [line(["1", "Urbe", "urbs", "NOUN", "_", "Case=Abl|Number=Sing", "2", "nsubj:pass", "_", "NER=LOC"]), line(["2", "capta", "capio", "VERB", "_", "_", "0", "root", "_", "_"]), line(["2.1", "x", "x", "X", "_", "_", "_", "_", "_", "_"])]
    folder = write(tmp_path, a_conllu="# text\n" + "\n".join(block) + "\n\n" + block[1].replace("2\t", "1\t", 1) + "\n")
    t = read_conllu(spark, folder).orderBy("sent_id", "i").collect()
    assert [(r.sent_id, r.i, r.dep, r.head, r.ent) for r in t] == [(0, 0, "nsubj:pass", 1, "LOC"), (0, 1, "ROOT", 1, ""), (1, 0, "ROOT", 0, "")]
    assert t[0].morph == {"Case": "Abl", "Number": "Sing"} and t[1].morph == {}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "work_id int, x int")
    sinks.replace_parts(df([(1, 1), (2, 2)]), path, "work_id")
    sinks.replace_parts(df([(2, 5)]), path, "work_id")
    sinks.replace_parts(df([]), path, "work_id")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("work_id", "x").collect()) == [(1, 1), (2, 5)]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.parquet").write_text("no parquet")
    got = {r.table: r.state for r in sinks.status(spark, {"works": str(tmp_path / "nothing"), "loc": path, "any": path, "note": str(tmp_path / "broken")}).collect()}
    assert got == {"works": "missing", "loc": "incompatible", "any": "available", "note": "unreadable"}
    sinks.export_json(df([(1, 1)]), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).select("format", "analysis.x").first()[1] == 1


def test_save_recent(spark):
    r = lambda n, start: spark.createDataFrame([(f"t{k % 25}", start + k) for k in range(n)], "text string, at int")
    got = sinks.save_recent(r(30, 0), r(1, 100), "text", "at").collect()
    assert len(got) == 20 and got[0].at == 100 and len({x.text for x in got}) == 20


def test_admission(spark):
    ok, no = admitted(spark.createDataFrame([(1, "a"), (2, "  "), (3, None), (4, "x" * 20_001), (5, "x" * 20_000)], "k int, t string"), "k", "t")
    assert sorted(r.k for r in ok.collect()) == [1, 5] and {r.k: r.reason for r in no.collect()} == {2: "blank", 3: "blank", 4: "too long"}


def test_readings(spark):
    s = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "c", -9.0), (1, "d", None)], "t int, l string, s double")
    assert [(r.l, r.probability, r["rank"]) for r in ranked_readings(s, "t", "l", "s").orderBy("rank").collect()] == [("a", 0.5, 1), ("b", 0.5, 2)]


def test_documents(spark):
    lines = spark.createDataFrame([(1, 1, "arma virumque cano Troiae"), (1, 2, "qui primus ab oris"), (2, 3, ""), (2, 4, None)], "d bigint, s bigint, t string")
    tokens = annotate(lines, "d", "s", "t")
    docs = to_documents(analyse(tokens)).collect()
    assert [r.doc_id for r in docs] == [1] and '"text":"arma"' in docs[0].analysis


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "et in est non ad cum"), (2, "the cat is on the mat of it")], passages.PASSAGE_SCHEMA).write.parquet(str(tmp_path / "in"))
    q = passages.write_each(passages.passages(spark, str(tmp_path / "in")), passages.scored, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1].latin > 0.5 and got[2].competitor == "en"


def test_documents_in_place(spark):
    """From a text to its result no token is shuffled, and nothing differs from the joined tables."""
    from scriptorium.plans.assemble import _documents, _joined_documents

    texts = [(1, "arma virumque cano\narma Troiae qui primus ab oris\nueni uidi uici"), (2, "12"), (3, "Italiam fato profugus Lauiniaque uenit")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4, "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "text")).withColumn("sent_id", F.col("sent_id").cast("bigint"))
    parts = docs.select("doc_id", F.length("text").alias("n")).repartition(4, "doc_id")
    tokens = annotate(lines, "doc_id", "sent_id", "text")
    got = _documents(tokens, parts)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3  # the texts, and for the parts both of theirs
    odd = tokens.unionByName(tokens.where("i = 1")).unionByName(tokens.where("doc_id = 3 AND i = 0").withColumn("i", F.lit(None).cast("int")))
    for t in (tokens, odd):
        rows = lambda df: sorted(df.select("doc_id", "n", F.to_json(F.struct("sentences", "anomalies"))).collect())
        assert rows(_documents(t, parts)) == rows(_joined_documents(t, parts))
