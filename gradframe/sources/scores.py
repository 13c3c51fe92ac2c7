"""Score, gradient and priority tables: readers and resumable writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradframe.plans.sizes import small
from gradframe.sources.fixedrecord import blocks_to_rows, decode, read_records

# fixed values: column names by number of columns
LAYOUTS = {
    4: ["iteration", "time", "loss", "accuracy"],
    5: ["iteration", "time", "loss", "difference", "delta"],
    6: ["iteration", "time", "loss", "accuracy", "difference", "delta"],
    7: ["iteration", "time", "data-point", "loss", "accuracy", "difference", "delta"],
}


def read_scores(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Score files without header; the number of columns names them."""
    schema = ", ".join(f"`{c}` double" for c in LAYOUTS[columns])
    return spark.read.schema(schema).option("comment", "#").csv(path)


def upgrade_scores(df: DataFrame) -> DataFrame:
    """The 7-column layout from the 6-column one, with 0 data points."""
    return df.withColumn("data-point", F.lit(0.0)).select(*LAYOUTS[7])


def write_scores(scores: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Append score rows whose ``iter`` is not yet in ``done``."""
    _pending(scores, done).write.mode("append").parquet(path)


def write_by_iter(df: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Append gradients ``(iter, id, g)`` or priorities ``(iter, id, p)``.

    One folder per record, so that a reader of one record prunes the others
    and a resumed run finds out what is there without reading data. Rows of a record are brought together
    for few files, and split again where they are many.
    """
    _pending(df, done).hint("rebalance", "iter").write.mode("append").partitionBy("iter").parquet(path)


def _pending(df: DataFrame, done: DataFrame | None) -> DataFrame:
    if done is None:
        return df
    return df.join(small(done.select("iter").distinct()), "iter", "left_anti")


def read_gradients(
    spark: SparkSession, path: str, points: int, width: int, dtype: str = "<f8"
) -> DataFrame:
    """Binary blocks of ``points x width`` numbers as ``(iter, id, g)``."""
    records = read_records(spark, path, width * int(dtype[-1]))
    return blocks_to_rows(decode(records, {"g": (dtype, width)}), points)


def read_priorities(spark: SparkSession, path: str, points: int, dtype: str = "<f4") -> DataFrame:
    """Binary blocks of ``points`` numbers as ``(iter, id, p)``."""
    records = read_records(spark, path, int(dtype[-1]))
    return blocks_to_rows(decode(records, {"p": (dtype, 0)}), points)
