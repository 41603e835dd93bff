"""Building and rebuilding the index and the commentary, work by work and source by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..operators.retrieval import shingle_rows, unit_offsets, work_streams
from ..sources import plain
from ..sources.sinks import replace_parts, status
from ..sources import tei


def _ids(keys: DataFrame) -> DataFrame:
    """A stable id for each key, the same in every build."""
    return keys.withColumn("id", F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)))


def index_units(units: DataFrame, works: DataFrame, folder: str, source: str, stored: bool = False) -> None:
    """Write ``works``, ``loc`` and ``shingle`` under ``folder``, replacing just these works.

    ``units(work, seq, ref, leaf, text)``, ``works(key, author, title, unit)``. Offsets count the
    words of whole texts; with ``stored`` the texts are then cut to the stored length.
    """
    w = _ids(works.select("key", "author", "title", "unit")).withColumn("source", F.lit(source))
    u = units.join(w.select(F.col("key").alias("work"), F.col("id").alias("work_id")), "work")
    loc = unit_offsets(u, "work_id", "seq", "text").select("work_id", F.col("tok_offset").cast("bigint").alias("tok_offset"), "ref", "leaf", "text")
    replace_parts((plain.stored_form(loc) if stored else loc), f"{folder}/loc", "work_id")
    replace_parts(shingle_rows(work_streams(u, "work_id", "seq", "text"), "work_id", "words"), f"{folder}/shingle", "work_id")
    replace_parts(w.join(u.select(F.col("work_id").alias("id")).distinct(), "id", "left_semi"), f"{folder}/works", "source")


def build_editions(spark: SparkSession, files: str, folder: str, editions: list[tei.Edition] = list(tei.EDITIONS), works: DataFrame | None = None, source: str = "editions") -> DataFrame:
    """Index the editions found below ``files``; works whose file is missing keep what is there.

    Returns ``(path, spec, reason)`` of the files that could not be read, whose works stay as well.
    """
    units, broken = tei.edition_units(tei.xml_files(spark, files), editions)
    index_units(materialise(units.select("work", "seq", "ref", "leaf", "text")), works if works is not None else tei.works_of(spark, editions), folder, source)
    return broken


def build_library(spark: SparkSession, files: str, folder: str, source: str = "library", authors: list[str] | None = list(plain.AUTHORS), prefixes: dict[str, str] = plain.ROOT_FILES, names: dict[str, str] = plain.SHOWN_NAMES) -> None:
    """Add a plain text library to an index that is there; without one it raises. The key of a work
    is its author folder and file name."""
    there = {r.table: r.state for r in status(spark, {n: f"{folder}/{n}" for n in ("works", "loc", "shingle")}).collect()}
    if set(there.values()) != {"available"}:
        raise FileNotFoundError(f"no index to add to: {there}")
    lib = plain.read_library(spark, files, authors=authors, prefixes=prefixes, names=names)
    lib = lib.withColumn("work", F.concat(F.lit("ll."), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("."), F.regexp_extract("path", r"([^/]+)\.txt$", 1)))
    works = lib.select(F.col("work").alias("key"), "author", "title", F.lit("line").alias("unit")).distinct()
    index_units(lib.select("work", "seq", "ref", "leaf", "text"), works, folder, source, stored=True)


def ingest(spark: SparkSession, files: str, folder: str, commentaries: list[tei.Commentary] = list(tei.COMMENTARIES)) -> DataFrame:
    """Write the notes of the commentaries found, replacing just their sources; ``(source, n)`` of
    all commentaries, 0 for those without a readable file, whose rows stay as they are."""
    notes = materialise(tei.commentary_notes(tei.xml_files(spark, files), commentaries)[0])  # used twice
    key = F.xxhash64("source", "path", "seq").bitwiseAND(F.lit((1 << 62) - 1))
    replace_parts(notes.select(key.alias("id"), "source", "author", "work", "language", "ref", "line_start", "line_end", "lemma", "grammar", "text"), f"{folder}/note", "source")
    names = spark.createDataFrame([(c.source,) for c in commentaries], "source string")
    return names.join(notes.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))
