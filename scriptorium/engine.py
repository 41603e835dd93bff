"""One object for an index on disk: state, catalogue, identification, commentary, analysis."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .operators import retrieval
from .operators.constructions import catalogue
from .operators.scansion import scan
from .plans.assemble import Analysis, Library, analyse, analyse_texts, to_documents
from .session import materialise
from .sources.sinks import status

#: Environment variable that names the folder of the tables where none is given.
FOLDER_VARIABLE = "SCRIPTORIUM_DATA"


class Engine:
    """The tables ``works``, ``loc``, ``shingle`` and ``note`` of a folder, read when used.

    A table that is missing or broken leaves the other results whole: its part is left out and named
    in ``warnings``. To know that, each such part is run and written once when it is asked for; a
    file that breaks only while it is read counts there and not in the caller's job.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, main_source: str = "editions") -> None:
        self.spark = spark
        self.folder = folder or os.environ.get(FOLDER_VARIABLE, "data")
        self.main_source = main_source
        self.warnings: list[str] = []

    def path(self, name: str) -> str:
        plain = f"{self.folder}/{name}"
        return plain if os.path.isdir(plain) or "://" in plain else f"{plain}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def status(self) -> DataFrame:
        return status(self.spark, {n: self.path(n) for n in ("works", "loc", "shingle", "note")})

    def health(self, annotator: object = None) -> dict:
        """Version, state of each table, and whether an annotator is at hand for plain texts."""
        tables = {r.table: r.state for r in self.status().collect()}  # four rows
        return {"version": __version__, "ready": annotator is not None, "tables": tables}

    def catalogue(self) -> DataFrame:
        return catalogue(self.spark)

    def _optional(self, name: str, make) -> DataFrame | None:
        try:
            return materialise(make())
        except Exception as e:  # noqa: BLE001 - an optional part must not take the rest down
            self.warnings.append(f"{name}: {type(e).__name__}")
            return None

    def identify(self, texts: DataFrame, key: str, text: str) -> DataFrame | None:
        return self._optional("identification", lambda: retrieval.identify(texts, key, text, self.table("shingle"), self.table("loc"), self.table("works"), self.main_source))

    def canonical_lines(self, requests: DataFrame) -> DataFrame | None:
        return self._optional("lines", lambda: retrieval.canonical_lines(requests, self.table("loc"), self.table("works")))

    def notes_for(self, requests: DataFrame, **options) -> DataFrame | None:
        return self._optional("commentary", lambda: retrieval.notes_for(requests, self.table("note"), **options))

    def commentary_on(self, identified: DataFrame, key: str) -> DataFrame | None:
        """Notes on identified passages (rows of :meth:`identify`), over all refs they touch."""
        from pyspark.sql import functions as F

        def make() -> DataFrame:
            lines = self.table("loc").join(self.table("works").select(F.col("id").alias("work_id"), F.col("key").alias("work")), "work_id")
            ends = lines.groupBy("work", "ref").agg(F.max("leaf").alias("top"), F.min("leaf").alias("bottom"), F.min("tok_offset").alias("at"))
            i = identified.select(F.col(key).alias("request"), "work", F.col("ref").alias("r0"), F.col("ref_end").alias("r1"), F.col("line_start").alias("a"), F.col("line_end").alias("b"))
            first = i.join(ends.select("work", F.col("ref").alias("r0"), F.col("at").alias("from")), ["work", "r0"]).join(ends.select("work", F.col("ref").alias("r1"), F.col("at").alias("to")), ["work", "r1"])
            spans = first.join(ends, "work").where(F.col("at").between(F.col("from"), F.col("to")))
            lo, hi = F.when(F.col("ref") == F.col("r0"), F.col("a")).otherwise(F.col("bottom")), F.when(F.col("ref") == F.col("r1"), F.col("b")).otherwise(F.col("top"))
            return retrieval.commentary_for(spans.select("request", "work", "ref", lo.alias("first"), hi.alias("last")), self.table("note"))

        return self._optional("commentary", make)

    def scan(self, lines: DataFrame, key: str, text: str, quantities: DataFrame | None = None) -> DataFrame:
        return scan(lines, key, text, quantities)

    def analyse(self, tokens: DataFrame, lines: DataFrame | None = None) -> Analysis:
        return analyse(tokens, lines)

    def analyse_texts(self, texts: DataFrame, key: str, text: str, annotator, known: DataFrame, quantities: DataFrame | None = None) -> DataFrame:
        """From plain texts to one result each; see :func:`scriptorium.plans.assemble.analyse_texts`."""
        library = Library(*(self.table(n) for n in ("loc", "works", "shingle", "note")), known, self.main_source)
        return analyse_texts(texts, key, text, annotator, library, quantities)

    def documents(self, tokens: DataFrame) -> DataFrame:
        return to_documents(analyse(tokens))
