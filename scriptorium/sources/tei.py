"""TEI editions and commentaries as tables of units and notes.

A file is read whole (mixed content rules out a row-tag reader) and taken apart into *events*: the
openings, texts and tails of its elements, each with the chain of elements around it. That is all
Python does. Which division an event lies in, which milestone, line or headword holds for it, and
what texts belong together are questions to the event table, answered by array functions and by
windows along the order of a file. Files are independent, so all of it scales with their number.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, strip_blanks
from ..session import map_batches, materialise

UNIT_SCHEMA = "path string, work string, seq int, ref string, leaf int, text string"
NOTE_SCHEMA = "path string, source string, author string, work string, language string, seq int, ref string, line_start int, line_end int, lemma string, grammar string, text string"
EVENT_SCHEMA = "path string, spec string, at int, kind string, id int, tag string, unit string, n string, rend string, text string, above array<struct<id:int,tag:string,type:string,num:int>>"
#: Entities that XML itself defines; all others are dropped with the document type.
_FOREIGN_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z._][\w.-]*;")
_DOCTYPE = re.compile(r"<!DOCTYPE(?:[^>\[]*\[.*?\]\s*>|[^>]*>)", re.S)

# Elements whose own text is no running text in prose, in notes on lines (where what
# follows them is left out too) and in notes on words.
PROSE_ASIDE = ("note", "pb", "gap", "bibl", "head", "milestone")
LINE_NOTE_ASIDE = ("pb", "milestone", "anchor", "delSpan", "gap")
WORD_NOTE_ASIDE = ("lemma", "bibl", "pb", "milestone", "anchor", "gap")
# Repairs of the text of notes, in order, and signs taken off around headwords.
LINE_NOTE_REPAIRS = ((r"\s+([,.;:!?)\]])", "$1"), (r"([(\[])\s+", "$1"), (r"\s+'\s*(.*?)\s*'", " '$1'"))
WORD_NOTE_REPAIRS = ((r"\s+([,.;:])", "$1"), (r"([,;:])\s*(?=[,;:])", ""), (r"\s{2,}", " "))
LINE_LEMMA_SIGNS, WORD_LEMMA_SIGNS, WORD_NOTE_SIGNS = "[](){}.,;:†*", " ,.:", " ,;:"


@dataclass(frozen=True)
class Edition:
    """How one file of a work is marked up: the div types of the path, and for prose the
    milestone units below them (path unit and leaf unit, or the leaf unit alone)."""

    work: str
    file: str
    divs: tuple[str, ...] = ("book",)
    verse: bool = True
    milestones: tuple[str, ...] = ()
    author: str = ""
    title: str = ""


@dataclass(frozen=True)
class Commentary:
    """A file of notes: on lines (``commline``) or on words of prose chapters (``lemma-prose``)."""

    source: str
    author: str
    work: str
    language: str
    file: str
    divs: tuple[str, ...] = ("book",)
    style: str = "commline"


def _folder(row: str, author: str) -> str:
    return f"{author}/opensource/{row}.xml"


# The works of the public collection of classical texts that are indexed, with the
# layout of their files.
EDITIONS = (
    Edition("vergil.aeneid", _folder("verg.a_lat", "Vergil"), author="Vergil", title="Aeneid"),
    Edition("vergil.georgics", _folder("verg.g_lat", "Vergil"), author="Vergil", title="Georgics"),
    Edition("vergil.eclogues", _folder("verg.ecl_lat", "Vergil"), ("poem",), author="Vergil", title="Eclogues"),
    Edition("ovid.metamorphoses", _folder("ovid.met_lat", "Ovid"), author="Ovid", title="Metamorphoses"),
    Edition("horace.odes", _folder("hor.carm_lat", "Horace"), ("book", "poem"), author="Horace", title="Odes"),
    Edition("horace.epodes", _folder("hor.epodes_lat", "Horace"), ("poem",), author="Horace", title="Epodes"),
    Edition("horace.satires", _folder("hor.sat_lat", "Horace"), ("book", "poem"), author="Horace", title="Satires"),
    Edition("horace.epistles", _folder("hor.epist_lat", "Horace"), ("book", "poem"), author="Horace", title="Epistles"),
    Edition("horace.ars", _folder("hor.ap_lat", "Horace"), (), author="Horace", title="Ars Poetica"),
    Edition("catullus.carmina", _folder("cat_lat", "Catullus"), ("poem",), author="Catullus", title="Carmina"),
    Edition("caesar.bg", _folder("caes.bg_lat", "Caesar"), ("book",), False, ("chapter", "section"), "Caesar", "De Bello Gallico"),
    Edition("cicero.catilinam", _folder("cic.oct1_lat", "Cicero"), ("speech",), False, ("section",), "Cicero", "In Catilinam"),
    Edition("cicero.philippics", _folder("cic.oct2_lat", "Cicero"), ("speech",), False, ("section",), "Cicero", "Philippics"),
    Edition("cicero.agraria", _folder("cic.oct4_lat", "Cicero"), ("speech",), False, ("section",), "Cicero", "De Lege Agraria"),
    Edition("caesar.bc", _folder("caes.bc_lat", "Caesar"), ("book", "chapter"), False, ("section",), "Caesar", "De Bello Civili"),
)
# The commentaries on them.
COMMENTARIES = (
    Commentary("servius-aen", "Servius", "vergil.aeneid", "la", _folder("serv.verg.aen_lat", "Vergil")),
    Commentary("servius-ecl", "Servius", "vergil.eclogues", "la", _folder("serv.verg.ecl_lat", "Vergil"), ("poem",)),
    Commentary("servius-geo", "Servius", "vergil.georgics", "la", _folder("serv.verg.georg_lat", "Vergil")),
    Commentary("conington-aen1", "Conington", "vergil.aeneid", "en", _folder("c.verg.aen1_eng", "Vergil")),
    Commentary("conington-aen2", "Conington", "vergil.aeneid", "en", _folder("c.verg.aen2_eng", "Vergil")),
    Commentary("shorey-horace", "Shorey", "horace.odes", "en", _folder("shore.hor_eng", "Horace"), ("book", "poem")),
    Commentary("merrill-catullus", "Merrill", "catullus.carmina", "en", _folder("merrill.cat_eng", "Catullus"), ("poem",)),
    Commentary("ag-caesar-bg", "Allen & Greenough", "caesar.bg", "en", _folder("ag.caes.bg_eng", "Caesar"), ("book", "chapter"), "lemma-prose"),
)


def parsed(raw: str) -> ElementTree.Element:
    """The document without its type declaration and foreign entities."""
    return ElementTree.fromstring(_FOREIGN_ENTITY.sub("", _DOCTYPE.sub("", raw)))


def number(value: str | None) -> int | None:
    """The number at the start of an attribute."""
    m = re.match(r"\s*(\d+)", value or "")
    return int(m[1]) if m else None


def events(root: ElementTree.Element) -> Iterator[tuple]:
    """``(at, kind, id, tag, unit, n, rend, text, above)`` of a document, ``at`` counting them.

    ``kind`` is ``open`` for an element, ``text`` for its text before the first child, ``tail`` for
    the text behind it. ``id`` numbers the elements in the order in which they open; ``above`` are
    the elements around the event from the outermost, the opening or text-holding one included.
    """
    ids, clock = itertools.count(), itertools.count()

    def row(kind: str, own: int, el: ElementTree.Element, text: str | None, above: list) -> tuple:
        text = None if text is None else unicodedata.normalize("NFC", text)
        return next(clock), kind, own, el.tag, (el.get("unit") or "").lower(), el.get("n"), (el.get("rend") or "").lower(), text, above

    def walk(el: ElementTree.Element, outer: list) -> Iterator[tuple]:
        own = next(ids)
        above = [*outer, {"id": own, "tag": el.tag, "type": (el.get("type") or "").lower(), "num": number(el.get("n"))}]
        yield row("open", own, el, None, above)
        if el.text:
            yield row("text", own, el, el.text, above)
        for child in el:
            inner = yield from walk(child, above)
            if child.tail:
                yield row("tail", inner, child, child.tail, above)
        return own

    yield from walk(root, [])


def xml_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, raw)`` of the XML files below a folder."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.xml").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read_events(files: DataFrame, names: dict[str, str], only_broken: bool = False) -> DataFrame:
    """The events of ``files(path, raw)``: ``names`` says for the end of a path which spec reads it.

    A file that is no XML gives one row of kind ``broken`` with the parser's words as text, the one
    kind of row if ``only_broken``; files that no spec names give none, and neither do null texts.
    """
    import pyarrow as pa

    chain = pa.list_(pa.struct([("id", pa.int32()), ("tag", pa.string()), ("type", pa.string()), ("num", pa.int32())]))
    kinds = {"int": pa.int32(), "string": pa.string()}
    columns = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
    types = [kinds.get(f.split()[1], chain) for f in EVENT_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for spec in [s for s, end in names.items() if raw is not None and path.endswith(end)]:
                    try:
                        root = parsed(raw)
                        rows = [] if only_broken else [(path, spec, *e) for e in events(root)]
                    except ElementTree.ParseError as x:
                        rows = [(path, spec, 0, "broken", 0, None, None, None, None, str(x), [])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

    named = reduce(or_, [F.endswith("path", F.lit(end)) for end in names.values()], F.lit(False))
    return map_batches(files.where(named).select("path", "raw"), run, EVENT_SCHEMA)


def broken_files(found: DataFrame) -> DataFrame:
    """``(path, spec, reason)`` of the files that could not be read."""
    return found.where("kind = 'broken'").select("path", "spec", F.col("text").alias("reason"))


_ANY_BLANK = r"[\s\p{Z}\x1C-\x1F\x85]+"
#: The order in which prose and notes put texts together: an element's text, the text behind it,
#: and only then what it holds.
_ELEMENT_ORDER = "CAST(id AS BIGINT) * 3 + CASE kind WHEN 'open' THEN 0 WHEN 'text' THEN 1 ELSE 2 END"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _ANY_BLANK, " "))


def _joined(order: str, piece: Column, kept: Column) -> Column:
    """The pieces of a group that are kept, put together in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct(F.col(order).alias("o"), piece.alias("t"))))), lambda x: x["t"]), "")


def _repaired(text: Column, repairs: tuple) -> Column:
    for pattern, by in repairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def _digits(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("int")


#: Types of divs found one inside the other along the chain: how many, their numbers, the last one's id.
_DIVISION = """aggregate(above, named_struct('k', 0, 'ref', CAST(array() AS array<int>), 'id', -1), (a, x) ->
  CASE WHEN a.k < size(divs) AND startswith(x.tag, 'div') AND x.type = get(divs, a.k) AND x.num IS NOT NULL THEN named_struct('k', a.k + 1, 'ref', array_append(a.ref, x.num), 'id', x.id) ELSE a END)"""


def _in_divisions(found: DataFrame, editions: list[Edition]) -> DataFrame:
    """The events inside the innermost divs of an edition's types (any case), with ``ref`` and the
    div as ``div``; without types the whole file is the one division."""
    rows = [(e.work, [d.lower() for d in e.divs], e.verse, e.milestones[0] if len(e.milestones) > 1 else None, e.milestones[-1] if e.milestones else "section") for e in editions]
    specs = found.sparkSession.createDataFrame(rows, "spec string, divs array<string>, verse boolean, path_unit string, leaf_unit string")
    e = found.where("kind <> 'broken'").join(specs, "spec").withColumn("d", F.expr(_DIVISION)).where("d.k = size(divs)")
    return e.select("*", F.col("d.ref").alias("above_ref"), F.col("d.id").alias("div")).drop("d", "divs")


def _units(pieces: DataFrame, ref: Column) -> DataFrame:
    """Rows of ``UNIT_SCHEMA`` in the order ``o`` of a file."""
    numbered = pieces.where("text <> ''").withColumn("seq", (F.row_number().over(Window.partitionBy("path", "spec").orderBy("o", "o2")) - 1).cast("int"))
    return numbered.select("path", F.col("spec").alias("work"), "seq", F.array_join(ref, ".").alias("ref"), F.col("leaf").cast("int").alias("leaf"), "text")


def verse_units(inside: DataFrame) -> DataFrame:
    """Lines of verse. The number of a line is one more than that of the line before, unless it has
    its own; where a division tags no line, the non-blank lines of its paragraphs count."""
    e = inside.where("verse")
    group = ["path", "spec", "div", "above_ref"]
    holder = lambda tag: F.try_element_at(F.filter("above", lambda a: a["tag"] == tag), F.lit(-1))
    whole = _joined("at", F.col("text"), F.col("text").isNotNull())
    lines = e.withColumn("l", holder("l")).where("l IS NOT NULL").groupBy(*group, F.col("l.id").alias("o"), F.col("l.num").alias("num")).agg(_squeezed(whole).alias("text"))
    order = Window.partitionBy("path", "spec", "div").orderBy("o")
    lines = lines.withColumn("k", F.row_number().over(order))
    lines = lines.withColumn("leaf", F.col("k") + F.coalesce(F.last(F.col("num") - F.col("k"), ignorenulls=True).over(order), F.lit(0)))
    bare = e.join(e.where("tag = 'l'").select("path", "spec", "div").distinct(), ["path", "spec", "div"], "left_anti")
    paras = bare.withColumn("p", holder("p")).where("p IS NOT NULL").groupBy(*group, F.col("p.id").alias("o")).agg(whole.alias("whole"))
    rows = paras.select(*group, "o", F.posexplode(F.filter(F.transform(F.split("whole", "\n"), strip_blanks), lambda x: x != "")).alias("o2", "text"))
    rows = rows.withColumn("leaf", F.row_number().over(Window.partitionBy("path", "spec", "div").orderBy("o", "o2")))
    keep = [*group, "o", "o2", "leaf", "text"]
    return _units(lines.withColumn("o2", F.lit(0)).select(*keep).unionByName(rows.select(*keep)), F.col("above_ref"))


def prose_units(inside: DataFrame) -> DataFrame:
    """The text between milestones. A path milestone sets the path and leaf 1, a leaf milestone the
    leaf, and ``3.2`` on one both; each holds until the next. Text before the first path milestone
    is left out, and so is the text of notes and the like itself, but not what they contain."""
    e = inside.where("NOT verse").withColumn("o", F.expr(_ELEMENT_ORDER))
    unit = F.when((F.col("kind") == "open") & (F.col("tag") == "milestone"), F.col("unit"))
    e = e.withColumn("to_path", F.coalesce(unit == F.col("path_unit"), F.lit(False))).withColumn("to_leaf", F.coalesce(unit == F.col("leaf_unit"), F.lit(False)) & ~F.col("to_path"))
    both = F.col("to_leaf") & F.col("path_unit").isNotNull() & F.contains("n", F.lit("."))
    left, right = _digits(F.substring_index("n", ".", 1)), _digits(F.regexp_extract("n", r"^[^.]*\.(.*)$", 1))
    nonzero = lambda c: F.when(c != 0, c)
    # a struct around a value tells "set to nothing" from "not set"
    set_path = F.when(F.col("to_path"), F.struct(_digits(F.col("n")).alias("v"))).when(both & nonzero(left).isNotNull(), F.struct(left.alias("v")))
    set_leaf = F.when(F.col("to_path"), F.lit(1)).when(both, F.coalesce(nonzero(right), F.lit(1))).when(F.col("to_leaf"), F.coalesce(nonzero(_digits(F.col("n"))), F.lit(1)))
    so_far = Window.partitionBy("path", "spec", "div").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = e.withColumn("p", F.last(set_path, ignorenulls=True).over(so_far)).withColumn("leaf", F.coalesce(F.last(set_leaf, ignorenulls=True).over(so_far), F.lit(1)))
    run = run.withColumn("mark", F.count(F.when(F.col("to_path") | F.col("to_leaf"), 1)).over(so_far))
    kept = F.col("text").isNotNull() & ((F.col("kind") == "tail") | ~F.col("tag").isin(*PROSE_ASIDE))
    units = run.groupBy("path", "spec", "div", "above_ref", "path_unit", "mark").agg(F.first("p").alias("p"), F.first("leaf").alias("leaf"), F.min("o").alias("o"), _squeezed(_joined("o", F.col("text"), kept)).alias("text"))
    units = units.where("path_unit IS NULL OR p.v IS NOT NULL").withColumn("o2", F.lit(0))
    return _units(units, F.when(F.col("p.v").isNull(), F.col("above_ref")).otherwise(F.array_append("above_ref", F.col("p.v"))))


def _placed(found: DataFrame, commentaries: list[Commentary], style: str) -> DataFrame:
    """The events of files of notes of one style, with the file's metadata and ``divs``. The list of
    commentaries is broadcast: a shuffle by it would put all events into a task for each of them."""
    rows = [(c.source, c.author, c.work, c.language, [d.lower() for d in c.divs]) for c in commentaries if c.style == style]
    specs = found.sparkSession.createDataFrame(rows, "spec string, author string, work string, language string, divs array<string>")
    return found.where("kind <> 'broken'").join(F.broadcast(specs), "spec").withColumn("o", F.expr(_ELEMENT_ORDER))


def _holders(kind: str, types: str) -> Column:
    """Elements around an event of which ``kind`` holds, as (id, num, j, ref): ``j`` is the place in
    the chain, ``ref`` the numbers of the nearest div of each type above it; all must be there."""
    nearest = f"transform({types}, t -> try_element_at(transform(filter(slice(above, 1, x.j), u -> startswith(u.tag, 'div') AND u.type = t AND u.num IS NOT NULL), u -> u.num), -1))"
    found = f"filter(transform(above, (a, j) -> named_struct('a', a, 'j', j)), x -> {kind})"
    return F.expr(f"filter(transform({found}, x -> named_struct('id', x.a.id, 'num', x.a.num, 'j', x.j, 'ref', {nearest})), y -> forall(y.ref, r -> r IS NOT NULL))")


_META = ["path", "spec", "author", "work", "language"]


def _notes(rows: DataFrame) -> DataFrame:
    numbered = rows.withColumn("seq", (F.row_number().over(Window.partitionBy("path", "spec").orderBy("o", "o2")) - 1).cast("int"))
    return numbered.select("path", F.col("spec").alias("source"), "author", "work", "language", "seq", F.array_join("ref", ".").alias("ref"), "line_start", "line_end", "lemma", "grammar", "text")


def line_notes(found: DataFrame, commentaries: list[Commentary]) -> DataFrame:
    """Notes on lines: elements of type commline below numbered divs. ``n`` is a line or a range,
    the lemma the first capitalised highlight; notes without text are left out."""
    e = _placed(found, commentaries, "commline").withColumn("note", F.explode(_holders("x.a.type = 'commline'", "divs")))
    own = (F.col("kind") == "open") & (F.col("id") == F.col("note.id"))
    kept = F.col("text").isNotNull() & ~F.col("tag").isin(*LINE_NOTE_ASIDE)
    caps = (F.col("kind") == "text") & (F.col("tag") == "hi") & (F.col("rend") == "caps")
    g = e.groupBy(*_META, F.col("note.id").alias("o"), F.col("note.ref").alias("ref")).agg(
        F.max(F.when(own, F.col("n"))).alias("n"), F.min_by("text", F.when(caps, F.col("at"))).alias("head"), _joined("o", F.concat("text", F.lit(" ")), kept).alias("text")
    )
    text = F.trim(_repaired(F.regexp_replace("text", _ANY_BLANK, " "), LINE_NOTE_REPAIRS))
    span = r"^\s*(\d+)\s*[-–]\s*(\d+)\s*$"
    last = F.coalesce(F.regexp_extract("n", span, 2).try_cast("int"), _digits(F.col("n")))
    lemma = F.lower(F.btrim(_squeezed(F.coalesce("head", F.lit(""))), F.lit(LINE_LEMMA_SIGNS)))
    out = g.withColumns({"text": text, "line_start": _digits(F.col("n")), "line_end": last, "lemma": lemma, "grammar": F.lit(""), "o2": F.lit(0)})
    return _notes(out.where("text <> ''"))


def word_notes(found: DataFrame, commentaries: list[Commentary]) -> DataFrame:
    """Notes on words: in the paragraphs of a numbered chapter each lemma opens a note that goes on
    to the next; numbers of references are kept in order, each once. Notes of two signs or fewer,
    and without a lemma, are left out."""
    e = _placed(found, commentaries, "lemma-prose")
    e = e.withColumn("chapter", F.explode(_holders("x.a.type = element_at(divs, -1) AND x.a.num IS NOT NULL", "slice(divs, 1, size(divs) - 1)")))
    e = e.withColumn("para", F.explode(F.expr("transform(filter(transform(above, (a, j) -> named_struct('a', a, 'j', j)), x -> x.a.tag = 'p' AND x.j > chapter.j), x -> x.a.id)")))
    key = [*_META, "chapter", "para"]
    opened = F.count(F.when((F.col("kind") == "open") & (F.col("tag") == "lemma"), 1)).over(Window.partitionBy(*key).orderBy("o"))
    e = e.withColumn("nth", opened).where("nth > 0")
    aside = F.col("tag").isin(*WORD_NOTE_ASIDE)
    named = F.col("text").isNotNull() & F.exists("above", lambda a: a["tag"] == "lemma")
    kept = F.col("text").isNotNull() & ((F.col("kind") == "tail") | ~aside)
    cited = F.when((F.col("kind") == "open") & (F.col("tag") == "bibl") & (strip_blanks(F.col("n")) != ""), F.struct("o", strip_blanks(F.col("n")).alias("n")))
    g = e.groupBy(*key, "nth").agg(
        _joined("at", F.col("text"), named).alias("lemma"), _joined("o", F.when(aside, F.col("text")).otherwise(F.concat("text", F.lit(" "))), kept).alias("text"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(cited)), lambda x: x["n"])), ", ").alias("grammar"),
    )
    text = F.btrim(_repaired(F.regexp_replace("text", _ANY_BLANK, " "), WORD_NOTE_REPAIRS), F.lit(WORD_NOTE_SIGNS))
    lemma = F.btrim(F.lower(F.btrim("lemma", F.lit(BLANKS))), F.lit(WORD_LEMMA_SIGNS))
    none = F.lit(None).cast("int")
    out = g.withColumns({"text": text, "lemma": lemma, "ref": F.array_append("chapter.ref", F.col("chapter.num")), "line_start": none, "line_end": none, "o": F.col("para"), "o2": F.col("nth")})
    return _notes(out.where("lemma <> '' AND length(text) > 2"))


def edition_units(files: DataFrame, editions: list[Edition] = list(EDITIONS)) -> tuple[DataFrame, DataFrame]:
    """(units, broken files) of ``files(path, raw)``; the events are written once for both."""
    found = materialise(read_events(files, {e.work: e.file for e in editions}))
    inside = _in_divisions(found, editions)
    return verse_units(inside).unionByName(prose_units(inside)), broken_files(found)


def commentary_notes(files: DataFrame, commentaries: list[Commentary] = list(COMMENTARIES)) -> tuple[DataFrame, DataFrame]:
    """(notes, broken files) of ``files(path, raw)``.

    The events are some ten times as large as the files, so they are put together as they are read
    and never written: each style reads the files of its own commentaries, and the broken files are
    found by one more parse when they are asked for.
    """
    names = lambda *styles: {c.source: c.file for c in commentaries if c.style in styles}
    styles = [(style, read) for style, read in (("commline", line_notes), ("lemma-prose", word_notes)) if names(style)]
    parts = [read(read_events(files, names(style)), commentaries) for style, read in styles or [("commline", line_notes)]]
    return reduce(DataFrame.unionByName, parts), broken_files(read_events(files, names("commline", "lemma-prose"), only_broken=True))


def read_editions(spark: SparkSession, folder: str, editions: list[Edition] = list(EDITIONS)) -> DataFrame:
    """Units of all files below ``folder`` that an edition names (by the end of their path)."""
    return edition_units(xml_files(spark, folder), editions)[0]


def read_commentaries(spark: SparkSession, folder: str, commentaries: list[Commentary] = list(COMMENTARIES)) -> DataFrame:
    """Notes of all files below ``folder`` that a commentary names."""
    return commentary_notes(xml_files(spark, folder), commentaries)[0]


def works_of(spark: SparkSession, editions: list[Edition] = list(EDITIONS)) -> DataFrame:
    """``(key, author, title, unit)`` of the editions."""
    return spark.createDataFrame([(e.work, e.author, e.title, "line" if e.verse else "section") for e in editions], "key string, author string, title string, unit string")
