import pytest

from scriptorium.engine import Engine
from scriptorium.operators import readings
from scriptorium.plans.build import build_editions, build_library, ingest
from scriptorium.sources.tei import Commentary, Edition

BOOK = '<TEI.2><text><body><div1 type="book" n="1">{}</div1><div1 type="book" n="2"><l n="1">Conticuere omnes intentique ora tenebant</l><l>inde toro pater Aeneas sic orsus</l></div1></body></text></TEI.2>'
LINES = ["Arma virumque cano Troiae qui primus ab oris", "Italiam fato profugus Laviniaque venit litora", "multum ille et terris iactatus et alto"]
NOTES = '<TEI.2><text><body><div1 type="book" n="1"><div2 type="commline" n="3"><p><hi rend="caps">multum</hi> adverbium</p></div2></div1><div1 type="book" n="2"><div2 type="commline" n="1"><p>conticuere omnes</p></div2></div1></body></text></TEI.2>'


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    files, data = tmp_path_factory.mktemp("files"), tmp_path_factory.mktemp("data")
    (files / "a.xml").write_text(BOOK.format("".join(f"<l>{x}</l>" for x in LINES)))
    (files / "n.xml").write_text(NOTES)
    (files / "bad.xml").write_text("<TEI.2><text>")
    (files / "caesar").mkdir()
    with pytest.raises(FileNotFoundError):
        build_library(spark, str(files), str(data))
    (files / "caesar" / "bg.txt").write_text("CAESAR\nliber primus est\n[1] Gallia est omnis divisa in partes tres quarum unam incolunt Belgae")
    works = spark.createDataFrame([("v.a", "Vates", "Arma", "line")], "key string, author string, title string, unit string")
    for _ in range(2):  # a second build changes nothing
        broken = build_editions(spark, str(files), str(data), [Edition("v.a", "a.xml"), Edition("none", "none.xml"), Edition("bad", "bad.xml")], works)
        assert [r.spec for r in broken.collect()] == ["bad"]
        build_library(spark, str(files), str(data))
    counts = {r.source: r.n for r in ingest(spark, str(files), str(data), [Commentary("s", "S", "v.a", "la", "n.xml"), Commentary("t", "T", "v.a", "la", "none.xml")]).collect()}
    assert counts == {"s": 2, "t": 0}
    return Engine(spark, str(data))


def test_status_and_catalogue(built):
    assert {r.table: r.state for r in built.status().collect()} == dict.fromkeys(("works", "loc", "shingle", "note"), "available")
    assert built.catalogue().count() == 99


def test_rebuild_keeps_one_copy(built):
    assert built.table("loc").count() == 6 and built.table("works").count() == 2


def test_identify_and_comment_over_books(spark, built):
    t = spark.createDataFrame([(1, "multum ille et terris iactatus et alto conticuere omnes intentique ora tenebant"), (2, "Gallia est omnis divisa in partes")], "k int, t string")
    got = built.identify(t, "k", "t")
    rows = {r.k: r for r in got.collect()}
    assert (rows[1].work, rows[1].ref, rows[1].ref_end, rows[1].line_start, rows[1].line_end) == ("v.a", "1", "2", 3, 1)
    assert rows[2].citation == "caesar, CAESAR 1.1"
    assert sorted(r.text for r in built.commentary_on(got, "k").collect()) == ["conticuere omnes", "multum adverbium"]


def test_missing_tables_leave_a_warning(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.notes_for(spark.createDataFrame([(1, "w", "1", 1)], "request int, work string, ref string, line int")) is None
    assert e.warnings and e.warnings[0].startswith("commentary") and {r.state for r in e.status().collect()} == {"missing"}


def test_a_part_that_fails_while_it_runs_leaves_a_warning(spark, built, tmp_path):
    import shutil

    shutil.copytree(built.folder, tmp_path / "d")
    for f in (tmp_path / "d" / "note").rglob("*.parquet"):
        data = bytearray(f.read_bytes())
        footer = int.from_bytes(data[-8:-4], "little") + 8
        data[4:-footer] = b"x" * len(data[4:-footer])  # the footer stays readable, the pages do not
        f.write_bytes(bytes(data))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    e = Engine(spark, str(tmp_path / "d"))
    asked = spark.createDataFrame([(1, "v.a", "1", 3)], "request int, work string, ref string, line int")
    assert e.notes_for(asked) is None and [w.split(":")[0] for w in e.warnings] == ["commentary"]
    lines = spark.createDataFrame([(1, "v.a", "1", 1, 3)], "request int, work string, ref string, first int, last int")
    assert e.canonical_lines(lines).count() == 3 and e.health()["tables"]["note"] == "available"


def test_readings(spark):
    e = spark.createDataFrame([(1, k, f"h{k}", "N", "3", "F", "A", "X") for k in range(6)] + [(2, 0, "v", "V", "5", None, "Q", None)], "t int, n int, headword string, pos string, decl string, gender string, freq string, age string")
    got = readings.lexicon_entries(e, "t", "n").orderBy("t", "n").collect()
    assert len(got) == 5 and got[0].declension == "third declension" and got[-1].declension == "irregular / third-io" and got[-1].frequency is None
    p = spark.createDataFrame([(1, k, "rosa", c, "S", "N") for k, c in enumerate(["GEN", "DAT", "GEN", None, None, "loc"])], "t int, n int, lemma string, case string, number string, pos string")
    assert [(r.n, r.case) for r in readings.distinct_parses(p, "t", "n").orderBy("n").collect()] == [(0, "genitive"), (1, "dative"), (3, None), (5, "locative")]
    s = spark.createDataFrame([(1, k, f) for k, f in enumerate([1, 1, None, 2, 2, None])], "line_id int, k int, foot int")
    assert [(r.foot, r.members) for r in readings.foot_groups(s).orderBy("n").collect()] == [(1, "0,1,2"), (2, "3,4,5")]
