"""Cutting lineage for loops, with reliable (shared-folder) checkpoints only."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

MINIMAL_SPLIT = 4 << 20  # fixed value: default of spark.sql.files.openCostInBytes


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to, as the session names it.

    On a cluster the folder must be named by ``spark.checkpoint.dir``; only a
    local session, where driver and executors share one disk, gets its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="gradframe-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that no frame refers to any more.

    Spark removes them once the driver's garbage collector has found them unused, which a driver with little
    to do for itself seldom gets to. Long chains of written results call this in between.
    """
    gc.collect()
    spark._jvm.System.gc()


def estimate(df: DataFrame) -> int:
    """The optimizer's size estimate in bytes; no job is run for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for small inputs that need much work per row.

    Below one minimal split (``spark.sql.files.openCostInBytes``) per core a
    scan yields fewer tasks than cores. Larger inputs are split by Spark
    already and pass unchanged, so data of any real size is not shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimate(df) < cores * MINIMAL_SPLIT else df


@contextmanager
def held(df: DataFrame, heavy: bool = True) -> Iterator[DataFrame]:
    """Rows that a loop reads again and again, with ``heavy`` work on each row or not.

    They are cached where half of the executors' memory takes them, else every
    pass reads the source, with its column pruning and filters. Lost cache
    blocks are computed again.
    """
    df = spread(df) if heavy else df
    if estimate(df) > _memory(df.sparkSession) / 2:
        yield df
        return
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _memory(spark: SparkSession) -> int:
    """Storage memory of the driver and all executors at the moment."""
    each = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    total = 0
    while each.hasNext():
        total += each.next()._1()
    return total


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _filesystem(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str, keep: set[str] | None = None) -> None:
    """Remove a folder, or with ``keep`` those of its entries that are not named there."""
    at, files = _filesystem(spark, path)
    if keep is None:
        files.delete(at, True)
        return
    names = {p.rstrip("/").rsplit("/", 1)[-1] for p in keep}
    for entry in files.listStatus(at) if files.exists(at) else []:
        if entry.getPath().getName() not in names:
            files.delete(entry.getPath(), True)
