"""Exact largest-k selection for any k.

The order is Spark's: NaN above all numbers, infinities at the ends, nulls last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.plans.lineage import cut

HEAP_ROWS = 2_000  # up to here every task may send that many rows to one
HEAP_TOTAL = 4_000_000  # rows all tasks together may send to one
BINS = 1024
TINY = 5e-324  # fixed value: the smallest positive double
INFINITY = float("inf")


def heap_for(df: DataFrame) -> int:
    """Heap size that suits the number of tasks of a frame without shuffles."""
    return max(HEAP_ROWS, HEAP_TOTAL // max(1, df.rdd.getNumPartitions()))


def top_k(df: DataFrame, k: int, by: str, tie: str, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties go to the smaller ``tie``.

    Spark's ``orderBy().limit(k)`` sends k rows of every task to one, which
    suits small k only. Larger k take whole classes of values from the top (NaN, infinity,
    numbers, minus infinity, null) and narrow the one that holds the k-th row: numbers by
    counting rows in bins (one map-side aggregate per round, at most ``BINS``
    rows to the driver), equal values by the tie column in the same way. All rounds read the rows, so these are
    written first; otherwise every round would compute ``by`` anew, several times in its conditions.
    """
    if k <= heap_rows:
        return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)
    df = cut(df)
    classes = _classes(F.col(by))
    counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(classes)]).first()
    taken, need = [], k
    for i, (condition, count) in enumerate(zip(classes, counts)):
        part = df.where(condition)
        if count > need > 0:
            chosen = _largest if i == NUMBERS else _lowest
            taken.append(chosen(part, need, by, tie, heap_rows))
        elif count and need > 0:
            taken.append(part)
        need -= count
    return reduce(DataFrame.unionByName, taken) if taken else df.limit(0)


NUMBERS = 2  # place of the ordinary numbers among the classes


def _classes(value: Column) -> list[Column]:
    """Conditions that split rows, from the largest values to nulls."""
    there, nan = value.isNotNull(), F.isnan(value)
    up, down = value == F.lit(INFINITY), value == F.lit(-INFINITY)
    return [there & nan, there & ~nan & up, there & ~nan & ~up & ~down, there & down, ~there]


def _largest(df: DataFrame, k: int, by: str, tie: str, heap_rows: int) -> DataFrame:
    """The ``k`` rows with the largest of finite values; there are more than ``k``."""
    lo, hi, count = df.agg(F.min(by), F.max(by), F.count(by)).first()
    need = k
    while lo < hi and count > heap_rows:
        bins = _bins(df.where(F.col(by).between(lo, hi)), by, lo, hi)
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if row["n"] >= need:
                lo, hi, count = row["lo"], row["hi"], row["n"]
                break
            need -= row["n"]
    above = df.where(F.col(by) > hi)
    band = df.where(F.col(by).between(lo, hi))
    if count <= heap_rows:
        return above.unionByName(band.orderBy(F.col(by).desc(), F.col(tie)).limit(need))
    return above.unionByName(_lowest(band, need, by, tie, heap_rows))


def _lowest(df: DataFrame, k: int, by: str, tie: str, heap_rows: int) -> DataFrame:
    """The ``k`` rows of one value with the smallest ``tie``."""
    lo, hi, count = df.agg(F.min(tie), F.max(tie), F.count(tie)).first()
    if count <= k:
        return df
    need = k
    while lo < hi and count > heap_rows:
        bins = _bins(df.where(F.col(tie).between(lo, hi)), tie, lo, hi)
        for row in sorted(bins, key=lambda r: r["bin"]):
            if row["n"] >= need:
                lo, hi, count = row["lo"], row["hi"], row["n"]
                break
            need -= row["n"]
    below = df.where(F.col(tie) < lo)
    band = df.where(F.col(tie).between(lo, hi))
    return below.unionByName(band.orderBy(tie).limit(need))


def _bins(df: DataFrame, by: str, lo, hi):
    """Rows per bin between ``lo`` and ``hi``, which lie in different bins, so every round narrows."""
    width = max(float(hi) / BINS - float(lo) / BINS, TINY)
    value = F.col(by).cast("double")
    if float(hi) - float(lo) == INFINITY:
        place = value / F.lit(width) - F.lit(float(lo) / width)
    else:
        place = (F.col(by) - F.lit(lo)).cast("double") / F.lit(width)
    index = F.when(F.col(by) == F.lit(hi), BINS - 1).otherwise(F.least(F.floor(place), F.lit(BINS - 2)))
    return (
        df.groupBy(index.alias("bin"))
        .agg(F.count("*").alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi"))
        .collect()
    )
