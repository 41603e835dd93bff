"""Writing tables so that a rebuild of one work or source replaces just that part, and their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns without which a table of the index cannot be used.
REQUIRED = {
    "works": {"id", "key", "author", "title", "unit"},
    "loc": {"work_id", "tok_offset", "ref", "leaf", "text"},
    "shingle": {"hash", "work_id", "tok_offset"},
    "note": {"id", "source", "author", "work", "language", "ref", "line_start", "line_end", "lemma", "grammar", "text"},
    "morpheus": {"wordform", "accented"},
}


def replace_parts(df: DataFrame, path: str, part: str) -> None:
    """Overwrite those partitions (values of ``part``) that ``df`` has, keep all others.

    Running it again gives the same table; an empty ``df`` changes nothing. The shuffle before the
    write is one that adaptive execution may balance: a part with a third of all rows is split over
    several tasks and files, small parts share a task.
    """
    df.hint("rebalance", F.col(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(table, state)``: missing, available, incompatible (columns lack) or unreadable."""
    rows = []
    for name, path in paths.items():
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            rows.append((name, "missing"))
            continue
        try:
            have = set(spark.read.parquet(path).columns)
            rows.append((name, "available" if REQUIRED.get(name, set()) <= have else "incompatible"))
        except Exception:  # noqa: BLE001 - any failure to read means the same to the caller
            rows.append((name, "unreadable"))
    return spark.createDataFrame(rows, "table string, state string")


def export_json(df: DataFrame, path: str, kind: str = "scriptorium-analysis") -> None:
    """One JSON object per row: ``{format, exportedAt, analysis}``."""
    whole = F.struct(F.lit(kind).alias("format"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("exportedAt"), F.struct(*df.columns).alias("analysis"))
    df.select(F.to_json(whole).alias("value")).write.mode("overwrite").text(path)


def save_recent(saved: DataFrame, fresh: DataFrame, text: str, saved_at: str, keep: int = 20) -> DataFrame:
    """The saved readings with the fresh ones in front: each text once, the newest ``keep`` of all.

    Rows without text or time are no readings and are left out; saved columns that lack come as null.
    """
    every = fresh.unionByName(saved, allowMissingColumns=True).where(F.col(text).isNotNull() & F.col(saved_at).isNotNull())
    newest = every.groupBy(text).agg(F.max_by(F.struct(*every.columns), saved_at).alias("r")).select("r.*")
    return newest.orderBy(F.col(saved_at).desc(), text).limit(keep)
