"""New passages as a stream: the per-text operators on each micro-batch, written once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gate import language_scores

PASSAGE_SCHEMA = "doc_id bigint, text string"


def passages(spark: SparkSession, folder: str, schema: str = PASSAGE_SCHEMA) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream of passages."""
    return spark.readStream.schema(schema).parquet(folder)


def scored(stream: DataFrame) -> DataFrame:
    """Language scores of a stream of passages; stateless, so it needs no watermark."""
    return language_scores(stream, "doc_id", "text")


def write_each(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Run ``analyse`` on every micro-batch and write its rows under ``folder/batch=<id>``.

    A batch that is run again after a failure replaces its own partition, so each passage comes out
    once. The query processes what is there and stops.
    """

    def one(batch: DataFrame, number: int) -> None:
        analyse(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
