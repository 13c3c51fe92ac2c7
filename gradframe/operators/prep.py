"""Preparing rows ``(id, x, y)``: scaling, order, slices, checks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.functions import vec
from gradframe.functions.batches import matrix
from gradframe.plans.sizes import small

WIDE = 64  # inputs up to which per-column aggregates are used


def ranges(df: DataFrame, column: str = "x", width: int | None = None) -> DataFrame:
    """Smallest and largest value per position as ``(j, lo, hi)``."""
    if width is None:
        width = df.select(F.size(column)).first()[0]
    if width <= WIDE:
        item = lambda j: F.get(column, F.lit(j))
        one = df.agg(
            F.array(*[F.min(item(j)) for j in range(width)]).alias("lo"),
            F.array(*[F.max(item(j)) for j in range(width)]).alias("hi"),
        )
        return one.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("j", "r")).select(
            "j", "r.lo", "r.hi"
        )

    def partial(batches):
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                X = matrix(batch.column(0))
                lo = X.min(axis=0) if lo is None else np.minimum(lo, X.min(axis=0))
                hi = X.max(axis=0) if hi is None else np.maximum(hi, X.max(axis=0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(lo), dtype=np.int32)), pa.array(lo), pa.array(hi)],
                names=["j", "lo", "hi"],
            )

    parts = df.select(column).mapInArrow(partial, "j int, lo double, hi double")
    return parts.groupBy("j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def scale(df: DataFrame, on_y: bool = False, width: int | None = None) -> DataFrame:
    """Map every position to [-1, 1] by its global range; a zero range gives -1."""
    for column in ("x", "y") if on_y else ("x",):
        bounds = sorted(ranges(df, column, width if column == "x" else None).collect())
        lo = vec.vector(r["lo"] for r in bounds)
        span = vec.vector(r["hi"] - r["lo"] if r["hi"] > r["lo"] else 1.0 for r in bounds)
        above = vec.minus(column, lo)
        df = df.withColumn(
            column, F.zip_with(above, span, lambda v, s: F.lit(2.0) * v / s - F.lit(1.0))
        )
    return df


def shuffle(df: DataFrame, seed: int) -> DataFrame:
    """Repeatable random order."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id")


def numbered_rows(df: DataFrame) -> int:
    """Row count, or ``ValueError`` where the ids are not 0 to count - 1, each once.

    Batches are taken as id ranges, so other ids would silently be left out. Repeated ids
    are found by comparing a combined hash of all ids with that of the range.
    """
    mark = F.bit_xor(F.xxhash64("id"))
    low, high, total, found = df.agg(F.min("id"), F.max("id"), F.count("*"), mark).first()
    if not total:
        return 0
    if (low, high) != (0, total - 1):
        raise ValueError(f"ids run from {low} to {high}, not from 0 to {total - 1}; number the rows first")
    if df.sparkSession.range(total).agg(mark).first()[0] != found:
        raise ValueError(f"some ids from 0 to {total - 1} are missing and others repeated; number the rows first")
    return total


def batch_slice(df: DataFrame, start: int, count: int, total: int) -> DataFrame:
    """``count`` rows from ``start`` on, wrapping at the end.

    Ids run from 0 to ``total - 1``. The slice is given as id ranges, which
    reach the scan as filters, so row groups of other slices are not read.
    """
    if count >= total:
        return df
    start %= total
    end = start + count
    i = F.col("id")
    if end <= total:
        return df.where((i >= start) & (i < end))
    return df.where((i >= start) | (i < end - total))


def check_shape(df: DataFrame, inputs: int, outputs: int | None = None) -> int:
    """Row count, or ``ValueError`` where a row does not fit the model."""
    sizes = {"x": inputs} if outputs is None else {"x": inputs, "y": outputs}
    found = df.agg(
        F.count("*").alias("n"),
        *[f(F.size(c)).alias(f"{m}_{c}") for c in sizes for m, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    for c, want in sizes.items():
        if found["n"] and (found[f"lo_{c}"], found[f"hi_{c}"]) != (want, want):
            raise ValueError(f"{c} holds {found[f'lo_{c}']}..{found[f'hi_{c}']} values, not {want}")
    return found["n"]


def holding(df: DataFrame, condition: Column, key: str = "iter") -> DataFrame:
    """All rows of the keys that have a row for which the condition holds."""
    return df.join(small(df.where(condition).select(key).distinct()), key, "left_semi")


def pick_records(df: DataFrame, wanted: Iterable[tuple[int, int]], column: str = "iter") -> DataFrame:
    """Rows whose ordinal lies in one of the inclusive ranges."""
    keep = F.lit(False)
    for lo, hi in wanted:
        keep = keep | F.col(column).between(lo, hi)
    return df.where(keep)
