"""Online training on a stream: every micro-batch is one update.

The parameter versions are a Parquet table. A stream notes beside its checkpoint the version
it began with, so batch ``b`` writes version ``first + b + 1``; a replayed batch finds
its version there and changes nothing.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradframe.functions.models import Model
from gradframe.operators.gradients import reduce_gradient
from gradframe.plans.lineage import cut
from gradframe.sources import history


def stream_train(
    stream: DataFrame,
    model: Model,
    w0: np.ndarray,
    rate: float,
    path: str,
    checkpoint: str,
    gap: int = 0,
    factor: float = 1.0,
    average: bool = True,
    interval: str | None = None,
    go_on: bool = False,
) -> StreamingQuery:
    """Start training on a stream of ``(x, y)`` rows; versions go to ``path``.

    The gradient of a batch is taken at the version ``gap`` batches old (the
    newest for 0) and applied to the newest, times ``factor``. ``interval`` sets
    a processing-time trigger, which makes the batch whatever arrived in that
    time; without it the rows at hand are worked off and the query ends.

    A new checkpoint over a table that another stream has written is refused, since its rows
    would be learned a second time; ``go_on`` says that they are other rows.
    """
    spark = stream.sparkSession
    if not _has_versions(spark, path):
        history.append(history.rows(spark, [(0, 0.0, 0, w0)]), path)
    recent = _newest(spark, path, gap)
    first = _first_version(spark, f"{checkpoint}/first-version", max(recent), go_on)
    began = time.monotonic()

    def update(batch: DataFrame, number: int) -> None:
        newest = max(recent)
        if newest > first + number:
            return
        points, w = recent[newest]
        _, read_at = recent[max(newest - gap, min(recent))]
        n, _, g = reduce_gradient(batch, model, read_at)
        if average:
            g = g / max(n, 1)
        points, w = points + n, w - factor * rate * g
        history.append(
            history.rows(spark, [(newest + 1, time.monotonic() - began, points, w)]), path
        )
        recent[newest + 1] = (points, w)
        for old in [v for v in recent if v < newest + 1 - gap]:
            del recent[old]

    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _newest(spark: SparkSession, path: str, gap: int) -> dict[int, tuple[int, np.ndarray]]:
    """The last ``gap + 1`` versions; a running stream keeps them in memory."""
    versions = history.read(spark, path)
    last = versions.agg(F.max("iter")).first()[0]
    rows = versions.where(F.col("iter") >= last - gap).collect()
    return {r["iter"]: (r["n"], np.array(r["w"])) for r in rows}


def _first_version(spark: SparkSession, note: str, newest: int, go_on: bool) -> int:
    """The version a stream with this checkpoint began with, noted at its first start.

    A folder without a row was left by a start that was cut short, and counts as no note.
    """
    try:
        noted = spark.read.schema("version bigint").parquet(note).first()
    except AnalysisException:
        noted = None
    if noted is not None:
        return noted["version"]
    if newest and not go_on:
        raise ValueError("the version table belongs to a stream with another checkpoint")
    spark.range(newest, newest + 1).select(F.col("id").alias("version")).coalesce(1).write.mode("overwrite").parquet(note)
    return newest


def stream_train_boxes(
    stream: DataFrame,
    model: Model,
    w0: np.ndarray,
    rate: float,
    path: str,
    checkpoint: str,
    at: str,
    length: str,
    late: str,
    start: str = "0 seconds",
    parts: int | None = None,
    average: bool = True,
) -> StreamingQuery:
    """Start training on a stream of ``(at, x, y)`` rows, one step for every box of event time.

    A box of the given ``length`` (counted from ``start``) is closed once rows arrive that are ``late`` beyond its end; its
    rows then give one gradient at the newest version, and the version's ``time`` is the box's end in
    seconds. Boxes are closed in their order, and one that has no rows gives no version. Rows
    that arrive after their box was closed are left out; boxes still open at the end of the stream wait for the next start. A
    box closed a second time after a failure finds its version there and changes nothing.

    A box's rows wait in the state in ``parts`` pieces by hash, so none holds a whole box.
    """
    spark = stream.sparkSession
    if not _has_versions(spark, path):
        history.append(history.rows(spark, [(0, float("-inf"), 0, w0)]), path)
    newest = history.last(history.read(spark, path))
    state = {"iter": newest["iter"], "time": newest["time"], "n": newest["n"], "w": np.array(newest["w"])}
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    box = F.window(at, length, startTime=start).alias("box")
    piece = F.pmod(F.xxhash64(F.col(at), "x", "y"), F.lit(parts)).alias("piece")
    closed = stream.withWatermark(at, late).groupBy(box, piece).agg(F.collect_list(F.struct("x", "y")).alias("rows"))

    def update(batch: DataFrame, number: int) -> None:
        rows = cut(batch.select(F.unix_micros("box.end").alias("end"), F.inline("rows")))
        ends = sorted(r["end"] for r in rows.select("end").distinct().collect())
        for end in ends:
            if end / 1e6 <= state["time"]:
                continue
            n, _, g = reduce_gradient(rows.where(F.col("end") == end), model, state["w"])
            w = state["w"] - rate * (g / max(n, 1) if average else g)
            state.update(iter=state["iter"] + 1, time=end / 1e6, n=state["n"] + n, w=w)
            history.append(history.rows(spark, [(state["iter"], state["time"], state["n"], w)]), path)

    writer = closed.writeStream.outputMode("append").foreachBatch(update).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _has_versions(spark: SparkSession, path: str) -> bool:
    try:
        return not history.read(spark, path).isEmpty()
    except AnalysisException:
        return False


def batch_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Points per version and time since the one before, for rate smoothing."""
    versions = history.read(spark, path).select("iter", "time", "n")
    before = versions.select((F.col("iter") + 1).alias("iter"), F.col("time").alias("t0"), F.col("n").alias("n0"))
    return versions.join(before, "iter").select(
        "iter", (F.col("n") - F.col("n0")).alias("points"), (F.col("time") - F.col("t0")).alias("interval")
    )
