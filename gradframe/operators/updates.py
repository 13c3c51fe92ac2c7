"""Update logs and worker reports: folds in arrival order.

A worker or a parameter position may own most of the log, so every ordered
operator goes through the range-split scans of :mod:`gradframe.plans.ordered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.plans.ordered import RANGE, fold_affine, lagged, previous, ranked, running, split
from gradframe.plans.sizes import small

EMA = 0.8  # fixed value: weight of the newest report


def fold_updates(deltas: DataFrame, start: DataFrame, factor: float = 1.0) -> DataFrame:
    """Parameter after each delta: ``(seq, j, w)`` from ``(seq, j, d)`` and ``(j, w)``."""
    steps = running(deltas, ["j"], ["seq"], {"s": F.col("d") * F.lit(float(factor))})
    return steps.join(small(start.select("j", F.col("w").alias("_w0"))), "j").select(
        *[c for c in deltas.columns if c != "d"], (F.col("_w0") + F.col("s")).alias("w")
    )


def fold_by_iteration(deltas: DataFrame, start: DataFrame, factor: float) -> DataFrame:
    """Parameter after each iteration, all its deltas applied together.

    This is what bounded staleness reaches once early deltas wait for their
    iteration: ``(iter, j, w)``.
    """
    per = deltas.groupBy("iter", "j").agg(F.sum("d").alias("d"))
    return fold_updates(per.withColumnRenamed("iter", "seq"), start, factor).withColumnRenamed(
        "seq", "iter"
    )


def ema(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], a: float = EMA) -> DataFrame:
    """``(1-a)*old + a*new`` per key in order; the first value is taken as is.

    ``values`` maps the new column to the averaged one; all share one pass.
    """
    step = lambda v: (F.col(v), 1.0 - a, F.lit(a) * F.col(v), None)
    return fold_affine(df, keys, order, {name: step(v) for name, v in values.items()})


def online_loss(df: DataFrame, order: list[str], workers: int, value: str = "loss") -> DataFrame:
    """``L * (n-1)/n + loss`` over all reports in order."""
    fold = (0.0, (workers - 1) / workers, F.col(value), None)
    return fold_affine(df, [], order, {"online": fold})


def last_per_source(df: DataFrame, source: str, order: list[str], value: str) -> DataFrame:
    """The newest value of every source."""
    return df.groupBy(source).agg(F.max_by(value, F.struct(*order)).alias(value))


def iteration_time(df: DataFrame, worker: str, at: str, order: list[str]) -> DataFrame:
    """Time since the worker's previous arrival; null for its first."""
    before = lagged(df, [worker], order, F.col(at), "_b")
    return before.withColumn("dt", F.col(at) - F.col("_b")).drop("_b")


def report_rollup(df: DataFrame, order: list[str], batch: int) -> DataFrame:
    """Running points and loss; ``fires`` where a whole global batch is reached.

    Points beyond a full batch count towards the next one.
    """
    rows = running(df, [], order, {"points": F.col("n"), "loss_sum": F.col("loss")})
    whole = lambda c: F.floor(c / F.lit(batch))
    return rows.withColumn(
        "fires", (whole(F.col("points")) > whole(F.col("points") - F.col("n"))).cast("int")
    )


def run_statistics(df: DataFrame) -> DataFrame:
    """Per worker: points, work and wait time, and their ratio per 1000 points."""
    work = F.sum(F.col("n") * F.col("t_point"))
    wait = F.sum("t_delta")
    points = F.sum("n")
    return df.groupBy("worker").agg(
        F.count("*").alias("reports"),
        points.alias("points"),
        work.alias("work"),
        wait.alias("wait"),
        (F.try_divide(work, points) * 1000).alias("work_per_k"),
        (F.try_divide(wait, points) * 1000).alias("wait_per_k"),
        F.try_divide(work, work + wait).alias("busy"),
    )


def gathered_loss(scored: DataFrame, share: int, parts: int) -> DataFrame:
    """Sum of losses over the first ``share`` of ``parts`` residues of the ids."""
    return scored.where(F.pmod("id", F.lit(parts)) < share).agg(
        F.sum("loss").alias("loss"), F.count("*").alias("n")
    )


def rate_by_portion(
    df: DataFrame, keys: list[str], order: list[str], target: float, compat: bool = False
) -> DataFrame:
    """Interval for a fixed number of points: halve-and-add on rate, then on interval.

    ``(..., rate, interval)`` from ``points`` and ``interval`` columns; ours is
    target / rate, ``compat`` multiplies.
    """
    return _rate(df, keys, order, F.col("points") / F.col("interval"), target, 100.0, None, compat)


def rate_by_improvement(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    target: float,
    longest: float = 1.0,
    compat: bool = False,
) -> DataFrame:
    """As :func:`rate_by_portion` on the improvement per time, with a longest wait."""
    return _rate(df, keys, order, F.col("improve") / F.col("interval"), target, 0.01, longest, compat)


def _rate(df, keys, order, sample: Column, target, first, longest, compat):
    parts = split(df, keys, order)
    rated = fold_affine(parts, keys, order, {"rate": (first, 0.5, sample / 2, None)})
    goal = F.lit(float(target))
    want = F.col("rate") * goal if compat else F.try_divide(goal, F.col("rate"))
    return fold_affine(rated, keys, order, {"next_interval": (0.01, 0.5, want / 2, longest)}).drop(RANGE)


def rate_by_balance(df: DataFrame, keys: list[str], order: list[str], window: int = 2) -> DataFrame:
    """Lengthen the interval while the newest gain rate beats the windowed one.

    The window holds the improvements and intervals of the last ``window``
    rows, filled with (0, 0.01) at first. A better row adds the mean interval
    of the window, any other cuts back to it. The synchronisation time a row is
    judged by is the smoothed one of the rows before it.
    """
    row = F.struct(F.col("improve").alias("g"), F.col("interval").alias("t"), F.col("sync").alias("y"))
    rows = previous(split(df, keys, order), keys, order, row, "_w", window)
    before = F.coalesce(F.get("_w", F.size("_w") - 1)["y"], F.lit(0.01))
    missing = F.lit(window) - F.size("_w")
    gain = F.aggregate("_w", F.lit(0.0), lambda s, e: s + e["g"])
    spent = F.aggregate("_w", F.lit(0.0), lambda s, e: s + e["t"]) + missing * F.lit(0.01)
    # the folds run in Python, where a window of structs takes a hundred times the room of its numbers
    flat = rows.withColumns({"_before": before, "_gain": gain, "_spent": spent}).drop("_w")
    synced = fold_affine(flat, keys, order, {"_sync": (0.01, 0.5, F.col("_before") / 2, None)})
    mean = F.col("_spent") / F.lit(float(window))
    new = F.try_divide(F.col("improve"), F.col("interval") + F.col("sync"))
    old = F.try_divide(F.col("_gain"), F.col("_spent") + F.col("_sync") * window)
    judged = synced.withColumn("_mean", mean).withColumn("_up", new > old).drop("_before", "_gain", "_spent", "_sync")
    shift = F.when(F.col("_up"), F.col("_mean")).otherwise(F.lit(0.0))
    cap = F.when(F.col("_up"), F.lit(float("inf"))).otherwise(F.col("_mean"))
    out = fold_affine(judged, keys, order, {"next_interval": (0.01, 1.0, shift, cap)})
    return out.drop("_mean", "_up", RANGE)


def per_worker_order(df: DataFrame, worker: str, order: list[str], name: str = "iter") -> DataFrame:
    """Running number of each row within its worker, from 0."""
    return ranked(df, [worker], order, name).withColumn(name, F.col(name) - 1)
