"""Session helpers: a local session for tests and one way to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session as tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scriptorium")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    The folder is the one the session names in ``spark.checkpoint.dir``, so the data survive the
    loss of executors. Where none is set, a session on one machine (tests, the bench) takes a
    temporary folder; a cluster raises, as no folder of one machine would do for it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="scriptorium-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def spread(df: DataFrame, megabytes_per_task: int = 4) -> DataFrame:
    """Give CPU-heavy work on a small input enough tasks; large inputs keep their own splits.

    A single small Parquet file is read as one split, which would leave all cores but one idle.
    The repartition is a round-robin of raw rows, added only where the scan has fewer splits than
    the cluster has cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this application import the package, wherever they run.

    The driver packs the package once per application and Spark hands it to every executor, also to
    those that join later; nothing has to be installed on the machines.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="scriptorium-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/scriptorium.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def whole_groups(batches: Iterator, keys: int) -> Iterator:
    """Arrow tables of whole groups from record batches in which the rows of a group lie together.

    A group is the rows of equal values in the first ``keys`` columns, numbers or null. One that goes
    on in the next batch waits for its end, so what is held is a batch and one group.
    """
    import numpy as np
    import pyarrow as pa

    def last_group(b: pa.RecordBatch) -> int:
        """Where the group of the last row begins."""
        same = np.ones(b.num_rows, bool)
        for k in range(keys):
            c = b.column(k)
            null = c.is_null().to_numpy(zero_copy_only=False)
            value = c.fill_null(0).to_numpy(zero_copy_only=False)
            same &= (null == null[-1]) & (value == value[-1])
        other = np.flatnonzero(~same)
        return int(other[-1]) + 1 if len(other) else 0

    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        begin = last_group(b)
        goes_on = waiting and [waiting[0].column(k)[0] for k in range(keys)] == [b.column(k)[0] for k in range(keys)]
        if waiting and not goes_on:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if begin:
            yield pa.Table.from_batches([*waiting, b.slice(0, begin)])
            waiting = []
        waiting.append(b.slice(begin))
    if waiting:
        yield pa.Table.from_batches(waiting)
