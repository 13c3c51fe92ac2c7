"""Comparing training runs by their score rows ``(run, iter, time, loss, ...)``.

Everything per run is an aggregate or a top-n per run, both of which combine
inside the tasks first; no run is gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradframe.plans.lineage import cut
from gradframe.plans.ordered import lagged
from gradframe.plans.sizes import small


def reached(scores: DataFrame, target: float | Column, value: str = "loss", at: str = "time") -> DataFrame:
    """First ``at`` per run where ``value`` is at or below the target, else null."""
    goal = target if isinstance(target, Column) else F.lit(float(target))
    return scores.groupBy("run").agg(F.min(F.when(F.col(value) <= goal, F.col(at))).alias("reached"))


def time_to_target(
    scores: DataFrame,
    target: float,
    estimate: str | None = None,
    value: str = "loss",
    at: str = "time",
) -> DataFrame:
    """``(run, reached)``; unmet targets are extrapolated if ``estimate`` says so.

    The curve goes on from its last four samples. Two chords, each over three of them,
    tell how steep it was a sample ago and is now. ``linear`` keeps the mean of the two; ``exp``
    takes further steps of one chord's length whose drops shrink by the ratio of the chords.
    """
    met = reached(scores, target, value, at)
    if estimate is None:
        return met
    newest = Window.partitionBy("run").orderBy(F.col("iter").desc())
    tail = (
        scores.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= 4)
        .groupBy("run").agg(F.sort_array(F.collect_list(F.struct("_age", F.col(at).alias("x"), F.col(value).alias("v")))).alias("s"))
    )
    sample = lambda age: F.get("s", F.lit(age))
    span = lambda age: sample(age + 2)["x"] - sample(age)["x"]
    steep = lambda age: F.try_divide(sample(age + 2)["v"] - sample(age)["v"], span(age))
    missing = F.lit(float(target)) - sample(0)["v"]
    step = (span(0) + span(1)) / 2
    straight = F.try_divide(missing, (steep(0) + steep(1)) / 2)
    if estimate == "exp":
        ratio = F.least(F.try_divide(steep(0), steep(1)), F.lit(1.0))
        shrinking = step * _shrinking_steps(missing, steep(0) * step, ratio)
        further = F.when(ratio < 1, shrinking).otherwise(straight)
    else:
        further = straight
    guess = tail.select("run", (sample(0)["x"] + further).alias("guess"))
    return met.join(guess, "run", "left").select("run", F.coalesce("reached", "guess").alias("reached"))


def _shrinking_steps(total: Column, first: Column, ratio: Column) -> Column:
    """Number m of steps with ``first * (ratio + ratio^2 + ... + ratio^m) = total``; null if there is none.

    The sum is ``first * ratio * (1 - ratio^m) / (1 - ratio)``.
    """
    power = F.lit(1.0) - F.try_divide(total * (F.lit(1.0) - ratio), first * ratio)
    return F.try_divide(F.log(power), F.log(ratio))


def progress(
    scores: DataFrame,
    value: str = "loss",
    p0: float | None = None,
    pinf: float | None = None,
    per_run: bool = False,
) -> DataFrame:
    """``(p0 - s) / (p0 - pinf)`` over all runs or within each."""
    if per_run:
        bounds = scores.groupBy("run").agg(F.max(value).alias("_h"), F.min(value).alias("_l"))
        rows = scores.join(small(bounds), "run")
        high = F.col("_h") if p0 is None else F.lit(float(p0))
        low = F.col("_l") if pinf is None else F.lit(float(pinf))
        return rows.withColumn("progress", F.try_divide(high - F.col(value), high - low)).drop("_h", "_l")
    top, bottom = scores.agg(F.max(value), F.min(value)).first()
    h, low = top if p0 is None else p0, bottom if pinf is None else pinf
    if h is None:
        return scores.withColumn("progress", F.lit(None).cast("double"))
    return scores.withColumn("progress", F.try_divide(F.lit(h) - F.col(value), F.lit(h - low)))


def strip_overhead(scores: DataFrame, portion: float, fixed: float = 0.0) -> DataFrame:
    """Take measured overhead out of the times, in proportion to the iteration."""
    ends = scores.groupBy("run").agg(F.max("iter").alias("_n"))
    share = F.when(F.col("_n") != 0, F.col("iter") * F.lit(float(portion)) / F.col("_n")).otherwise(
        F.lit(0.0)
    )
    return (
        scores.join(small(ends), "run")
        .withColumn("time", F.col("time") - (share + F.lit(float(fixed))))
        .drop("_n")
    )


def densify(scores: DataFrame, per_gap: int, value: str = "loss") -> DataFrame:
    """Linear fill: ``per_gap`` points from each row to the next of its run."""
    pair = F.struct(F.col("time").alias("t"), F.col(value).alias("v"))
    rows = lagged(scores, ["run"], ["iter"], pair, "b").where(F.col("b").isNotNull())
    step = F.explode(F.sequence(F.lit(0), F.lit(per_gap - 1))).alias("i")
    rows = rows.select("run", "iter", "time", value, "b", step)
    f = F.col("i") / F.lit(float(per_gap))
    return rows.select(
        "run",
        (F.col("iter") - 1).alias("iter"),
        "i",
        (F.col("b.t") + (F.col("time") - F.col("b.t")) * f).alias("time"),
        (F.col("b.v") + (F.col(value) - F.col("b.v")) * f).alias(value),
    )


def first_columns(scores: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """The first ``n`` rows by iteration, some columns only."""
    return scores.orderBy("iter", "run").limit(n).select(*columns)


def relative_to(times: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Times divided by those of the reference run of the same group."""
    base = reference.select(*keys, F.col("reached").alias("_ref"))
    return times.join(small(base), keys).select(
        *times.columns, F.try_divide("reached", "_ref").alias("relative")
    )


def scaling(times: DataFrame, reference: int) -> DataFrame:
    """Speed-up ``t_ref / t * n_ref`` per group against its run with ``reference`` workers.

    The times are written once, since they and the reference among them are read.
    """
    times = cut(times)
    base = times.where(F.col("workers") == reference).select("grp", F.col("reached").alias("_ref"))
    return times.join(small(base), "grp").select(
        "grp", "workers", "reached", (F.try_divide("_ref", "reached") * reference).alias("speedup")
    )


def scaling_line(table: DataFrame) -> DataFrame:
    """Least-squares line of the speed-up over the workers, per group."""
    return table.groupBy("grp").agg(
        F.regr_slope("speedup", "workers").alias("slope"),
        F.regr_intercept("speedup", "workers").alias("intercept"),
    )
