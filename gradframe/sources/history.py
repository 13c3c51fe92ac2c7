"""Parameter histories: Parquet tables ``(iter, time, n, w)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gradframe.sources.fixedrecord import decode, read_records
from gradframe.sources.tables import lines, number_rows

SCHEMA = "iter int, time double, n bigint, w array<double>"


def rows(spark: SparkSession, records: Sequence[tuple]) -> DataFrame:
    """History rows from driver-side records ``(iter, time, n, w)``."""
    data = [(int(i), float(t), int(n), [float(v) for v in w]) for i, t, n, w in records]
    return spark.createDataFrame(data, SCHEMA)


def append(df: DataFrame, path: str) -> None:
    df.select("iter", "time", "n", "w").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def last(history: DataFrame) -> Row | None:
    """The record with the largest ``iter``, by one aggregate."""
    row = history.agg(F.max_by(F.struct("iter", "time", "n", "w"), "iter").alias("r")).first()
    return row["r"]


def nth(history: DataFrame, n: int) -> DataFrame:
    """The n-th record in order, from 0. Spark keeps n + 1 candidates per task."""
    rank = F.row_number().over(Window.orderBy("iter"))
    return history.withColumn("_r", rank).where(F.col("_r") <= n + 1).where(
        F.col("_r") == n + 1
    ).drop("_r")


def read_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Import histories written as lines ``iter,time,n,w...``."""
    cells = F.split("value", sep)
    return lines(spark, path).select(
        F.get(cells, F.lit(0)).cast("int").alias("iter"),
        F.get(cells, F.lit(1)).cast("double").alias("time"),
        F.get(cells, F.lit(2)).cast("bigint").alias("n"),
        F.slice(cells, 4, F.size(cells) - 3).cast("array<double>").alias("w"),
    )


def read_binary(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Import packed records: int32, float64, uint64, ``width`` float64."""
    layout = {"iter": ("<i4", 0), "time": ("<f8", 0), "n": ("<u8", 0), "w": ("<f8", width)}
    records = read_records(spark, path, 20 + 8 * width)
    return decode(records, layout).select(F.col("iter").cast("int"), "time", "n", "w")


def read_model(spark: SparkSession, path: str, shape_line: bool, sep: str = ",") -> DataFrame:
    """One model's text file as the long table ``(j, w)``.

    Lines follow each other in parameter order; a leading shape line is left out.
    """
    numbered = number_rows(lines(spark, path), "line")
    if shape_line:
        numbered = numbered.where(F.col("line") > 0)
    numbers = F.transform(F.split("value", sep), lambda c: c.try_cast("double"))
    cells = numbered.select("line", numbers.alias("c"))
    before = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        "line", F.coalesce(F.sum(F.size("c")).over(before), F.lit(0)).alias("start")
    )
    return cells.join(starts, "line").select("start", F.posexplode("c").alias("i", "w")).select(
        (F.col("start") + F.col("i")).cast("int").alias("j"), "w"
    )
