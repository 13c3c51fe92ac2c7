"""Order-dependent operators that never put one key into one task.

A plain ``Window.partitionBy(key)`` moves all rows of a key into one task, so a
key holding a third of the data stops the job. The functions here range-split
the rows by ``(keys, order)`` first. A hot key is then spread over many ranges;
every range is summarised, the few summaries are combined per key, and the
result is carried back into the ranges:

    rows -> ranges -> one summary per (key, range) -> carry -> rows

Windows below run over ``(keys, range)``, which is bounded by the range size,
or over the summaries of one key, which are bounded by the number of ranges.
The order must be total within a key (add an id to break ties).

A frame that went through :func:`split` already is taken as it is, and its range
column is handed on, so that several operators in one order share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradframe.plans.lineage import cut

RANGE = "_range"
RANGE_BITS = 16  # a range is what one Python call holds, so this bounds its memory
RANGE_ROWS = 1 << RANGE_BITS


def split(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-split ``df`` and note the range of every row.

    A partition is cut further into ranges of at most ``RANGE_ROWS`` rows by the
    place of a row in it, so that a range stays small whatever the number of
    shuffle partitions is. Range numbers follow the order. The rows are
    checkpointed, since two readings of a sampled range partitioning could draw
    different bounds.
    """
    cols = [F.col(k) for k in keys] + [_col(o) for o in order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    number = F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)
    return cut(placed.withColumn(RANGE, number))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Add running sums (current row included) per key in the given order."""
    parts = df if RANGE in df.columns else split(df, keys, order)
    group = [*keys, RANGE]
    totals = parts.groupBy(*group).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *group, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums]
    )
    local = (
        Window.partitionBy(*group)
        .orderBy(*[_col(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = parts.join(carry, group)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.sum(e).over(local)).alias(n)
            for n, e in sums.items()
        ],
    )


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank",
           sums: dict[str, Column] | None = None) -> DataFrame:
    """``row_number()`` from 1 per key, optionally with running sums beside it."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint"), **(sums or {})})


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    offset: int = 1,
) -> DataFrame:
    """Value of the row ``offset`` rows earlier in the same key, else null."""
    return previous(df, keys, order, value, name, offset).withColumn(
        name, F.get(name, F.size(name) - F.lit(offset))
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    count: int,
) -> DataFrame:
    """Values of up to ``count`` preceding rows of the same key, oldest first."""
    keep = df.columns
    parts = (df if RANGE in keep else split(df, keys, order)).withColumn("_v", value)
    group = [*keys, RANGE]
    local = Window.partitionBy(*group).orderBy(*order)
    latest = Window.partitionBy(*group).orderBy(*[F.col(o).desc() for o in order])
    tails = (
        parts.withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= count)
        .select(*group, *order, "_v", "_n")
    )
    across = Window.partitionBy(*keys).orderBy(RANGE, *order).rowsBetween(-count, -1)
    carry = (
        tails.withColumn("_carry", F.collect_list("_v").over(across))
        .groupBy(*group)
        .agg(F.max_by("_carry", "_n").alias("_carry"))
    )
    near = F.collect_list("_v").over(local.rowsBetween(-count, -1))
    both = parts.join(carry, group).withColumn("_near", near)
    all_before = F.concat("_carry", "_near")
    return both.select(
        *keep,
        F.slice(
            all_before,
            F.greatest(F.size(all_before) - F.lit(count - 1), F.lit(1)),
            F.lit(count),
        ).alias(name),
    )


def fold_affine(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    folds: dict[str, tuple],
) -> DataFrame:
    """Ordered folds ``s <- min(scale*s + shift, cap)`` per key, value after each row.

    ``folds`` maps a column name to ``(start, scale, shift, cap)``; each part is
    a number or a Column of the row, ``cap`` may be None, and a Column given as
    ``start`` counts on the key's first row.

    Steps of this form compose to steps of the same form (for scale >= 0), so
    each range is folded on its own and the ranges are chained afterwards.
    """
    keep = df.columns
    parts = df if RANGE in keep else split(df, keys, order)
    for n, (start, scale, shift, cap) in folds.items():
        cap = float("inf") if cap is None else cap
        for part, value in zip("sabm", (start, scale, shift, cap)):
            parts = parts.withColumn(f"_{part}_{n}", _lit(value).cast("double"))
    group = [*keys, RANGE]
    order_cols = list(order)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_cols)
        for n in folds_named:
            steps = [pdf[f"_{part}_{n}"].to_numpy() for part in "abm"]
            for part, values in zip("abm", _compose(*steps)):
                pdf[f"_{part}_{n}"] = values
        return pdf

    folds_named = list(folds)
    local = cut(parts.groupBy(*group).applyInPandas(within, parts.schema))
    position = F.struct(*order)
    ends = local.groupBy(*group).agg(
        *[F.max_by(F.struct(*[f"_{p}_{n}" for p in "abm"]), position).alias(f"_e_{n}") for n in folds],
        *[F.min_by(f"_s_{n}", position).alias(f"_f_{n}") for n in folds],
    )
    carry = _chain(ends, keys, folds_named)
    after = lambda n: F.least(F.col(f"_a_{n}") * F.col(f"_in_{n}") + F.col(f"_b_{n}"), F.col(f"_m_{n}"))
    return local.join(carry, group).select(*keep, *[after(n).alias(n) for n in folds])


def _chain(ends: DataFrame, keys: Sequence[str], folds: list[str]) -> DataFrame:
    """State before every range: ``(keys, range, _in_<fold>...)``.

    Most keys lie in one range and begin with their start value. The others are
    at most as many as there are ranges, and so are the rows of each.
    """
    spans = ends.withColumn("_k", F.count("*").over(Window.partitionBy(*keys)))
    starts = [F.col(f"_f_{n}").alias(f"_in_{n}") for n in folds]
    group = [*keys, RANGE]
    single = spans.where(F.col("_k") == 1).select(*group, *starts)
    several = spans.where(F.col("_k") > 1).select(
        *group,
        *[F.col(f"_e_{n}")[f"_{p}_{n}"].alias(f"_{p}_{n}") for n in folds for p in "abm"],
        *starts,
    )

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RANGE)
        for n in folds:
            a, b, m = _compose(*[pdf[f"_{p}_{n}"].to_numpy() for p in "abm"])
            start = pdf[f"_in_{n}"].iloc[0]
            pdf[f"_in_{n}"] = np.append(start, np.minimum(a * start + b, m)[:-1])
        return pdf[single_columns]

    single_columns = single.columns
    return single.unionByName(several.groupBy(*keys).applyInPandas(follow, single.schema))


def _compose(a: np.ndarray, b: np.ndarray, m: np.ndarray):
    """Prefix composition of ``s -> min(a*s+b, m)`` by doubling."""
    a, b, m = a.astype(float).copy(), b.astype(float).copy(), m.astype(float).copy()
    step = 1
    while step < len(a):
        head_a, head_b, head_m = a[:-step].copy(), b[:-step].copy(), m[:-step].copy()
        with np.errstate(invalid="ignore"):
            inner = np.where(np.isinf(head_m), np.inf, a[step:] * head_m + b[step:])
        m[step:] = np.minimum(inner, m[step:])
        b[step:] = a[step:] * head_b + b[step:]
        a[step:] = a[step:] * head_a
        step *= 2
    return a, b, m


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(v)
