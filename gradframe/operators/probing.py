"""Choosing a global batch size from short probes."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradframe.functions.batches import matrix
from gradframe.functions.models import Model
from gradframe.operators.gradients import is_narrow, loop_columns, reduce_gradient
from gradframe.operators.prep import batch_slice
from gradframe.operators.scoring import scores_of
from gradframe.plans.blockjoin import meet
from gradframe.plans.lineage import held
from gradframe.plans.sizes import small


def halved(largest: int, smallest: int) -> list[int]:
    """``largest``, a half, a quarter, ... while above ``smallest``."""
    out = []
    while largest > smallest:
        out.append(largest)
        largest //= 2
    return out


def probe_batch_sizes(
    df: DataFrame, model: Model, w0: np.ndarray, rate: float, sizes: list[int], points: int
) -> DataFrame:
    """Train ``points`` rows with every size from one start: ``(k, loss, gain, time, rate)``.

    Losses are means over all rows, before and after.
    """
    spark = df.sparkSession
    out = []
    with held(loop_columns(df, model), not is_narrow(model)) as rows:
        total = rows.count()
        n, before, _ = reduce_gradient(rows, model, w0)
        for k in sizes:
            began, w = time.monotonic(), np.array(w0, float)
            for step in range(math.ceil(points / k)):
                m, _, g = reduce_gradient(batch_slice(rows, step * k, k, total), model, w)
                w = w - rate * g / max(m, 1)
            took = time.monotonic() - began
            _, after, _ = reduce_gradient(rows, model, w)
            gain = (before - after) / n
            out.append((int(k), after / n, gain, took, gain / took))
    return spark.createDataFrame(out, "k bigint, loss double, gain double, time double, rate double")


def batch_losses(df: DataFrame, model: Model, history: DataFrame, size: int) -> DataFrame:
    """``(k, version, batch, n, loss)``: loss sums of every batch of ``size`` rows by id under every record.

    One pass: blocks of rows meet blocks of records, and only sums per record and batch are shuffled.
    """
    source = "xs" if "xs" in df.columns else "x"
    names = ["version", "batch", "n", "loss"]

    def visit(pairs):
        for rows, records in pairs:
            batch, place = np.unique(np.asarray(rows.column("id")) // size, return_inverse=True)
            Y, n = matrix(rows.column("y")), np.bincount(place, minlength=len(batch))
            for i, w in zip(records.column("iter").to_pylist(), matrix(records.column("w"))):
                loss = np.bincount(place, model.loss(scores_of(model, rows.column(source), w), Y), len(batch))
                columns = [np.full(len(batch), i, np.int32), batch, n, loss]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    parts = meet(df.select("id", source, "y"), history.select("iter", "w"), visit, "version int, batch bigint, n bigint, loss double")
    sums = parts.groupBy("version", "batch").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    return sums.select(F.lit(size).cast("bigint").alias("k"), *names)


def gain_estimates(losses: DataFrame) -> DataFrame:
    """Loss drop per point of every batch size, measured four ways.

    ``losses`` has ``(k, version, batch, n, loss)``: the loss sum of batch
    ``batch`` (number i) under parameter version ``version``. Version i is the
    one batch i was trained with, so the four ways compare

    * ``drift``: last batch against first batch, each under its own version;
    * ``start``: every batch under version 0 against under its own;
    * ``next``: every batch under its own version against the following one;
    * ``end``: every batch under its own version against the last one.
    """
    last = losses.groupBy("k").agg(
        F.max("version").alias("_v"), F.max("batch").alias("_b"), F.min("batch").alias("_b0")
    )
    rows = losses.join(small(last), "k")
    own, v, b = F.col("version") == F.col("batch"), F.col("version"), F.col("batch")
    pick = lambda c: F.sum(F.when(c, F.col("loss")).otherwise(F.lit(0.0)))
    per_point = lambda c: pick(c) / F.sum(F.when(c, F.col("n")))
    n = F.sum(F.when(own, F.col("n")))
    return rows.groupBy("k").agg(
        (per_point(own & (b == F.col("_b0"))) - per_point(own & (b == F.col("_b")))).alias("drift"),
        ((pick(v == 0) - pick(own)) / n).alias("start"),
        ((pick(own) - pick(v == b + 1)) / n).alias("next"),
        ((pick(own) - pick(v == F.col("_v"))) / n).alias("end"),
    )


def timings(reports: DataFrame, harmonic: bool = True) -> DataFrame:
    """Mean time per point and per delta over the workers, as one row."""
    per = reports.groupBy("worker").agg(
        F.avg("t_point").alias("p"), F.avg("t_delta").alias("d")
    )
    point = F.count("*") / F.sum(1 / F.col("p")) if harmonic else F.avg("p")
    return per.agg(point.alias("f1"), F.avg("d").alias("f2"))


def best_batch_size(probes: DataFrame, f1: float, f2: float, cuts: int = 0) -> DataFrame:
    """``argmax_k gain_k / (f1 + f2/k)`` over ``(k, gain)``; ties to the smaller k.

    With ``cuts`` the gain is interpolated linearly in that many steps on both
    sides of the best probe. Probe tables are short: one row per size.
    """
    rate = lambda k, g: g / (F.lit(float(f1)) + F.lit(float(f2)) / k)
    pick = lambda d: d.agg(
        F.max_by(F.struct("k", "gain"), F.struct(rate(F.col("k"), F.col("gain")), -F.col("k"))).alias("b")
    ).select(
        F.col("b.k").alias("k"), rate(F.col("b.k"), F.col("b.gain")).alias("rate")
    )
    best = pick(probes)
    if not cuts:
        return best
    centre = best.first()["k"]
    around = probes.agg(
        F.max(F.when(F.col("k") < centre, F.struct("k", "gain"))).alias("lo"),
        F.max(F.when(F.col("k") == centre, F.struct("k", "gain"))).alias("mid"),
        F.min(F.when(F.col("k") > centre, F.struct("k", "gain"))).alias("hi"),
    )
    step = F.explode(F.sequence(F.lit(0), F.lit(cuts))).alias("i")
    sides = around.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("mid").alias("b")),
                                            F.struct(F.col("mid").alias("a"), F.col("hi").alias("b")))).alias("s"))
    sides = sides.where(F.col("s.a").isNotNull() & F.col("s.b").isNotNull()).select("s.a", "s.b", step)
    f = F.col("i") / F.lit(float(cuts))
    points = sides.select(
        F.floor(F.col("a.k") + (F.col("b.k") - F.col("a.k")) * f).alias("k"),
        (F.col("a.gain") + (F.col("b.gain") - F.col("a.gain")) * f).alias("gain"),
    )
    return pick(points)
