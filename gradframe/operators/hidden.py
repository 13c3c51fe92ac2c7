"""Expectation-maximisation of models whose rows have a hidden state, in batches.

A model says what a row's state is under a parameter, what a state adds to the sufficient
statistics, and which parameter the statistics give. The states are a table in segments by id: a step reads
those of its batch, writes them anew, and moves the statistics by the difference of the
two. Statistics and parameter are all that the driver holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradframe.functions.batches import lists, matrix
from gradframe.operators.gradients import sum_batches
from gradframe.operators.prep import batch_slice, numbered_rows
from gradframe.operators.progress import Keeping, Recorder
from gradframe.plans.lineage import checkpoint_dir, cut, held
from gradframe.plans.segments import Segments, spans
from gradframe.plans.sizes import small
from gradframe.sources import snapshots
from gradframe.sources.snapshots import Snapshot

FIELDS = "iter int, n bigint, loss double, w array<double>"


class Hidden(Protocol):
    """What training needs from a model with hidden states."""

    statistics: int  # length of the vector of sufficient statistics

    def expect(self, X: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State (a vector) and loss of every row under a parameter."""

    def collect(self, X: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Statistics of rows with their states, summed."""

    def maximise(self, total: np.ndarray) -> np.ndarray:
        """The parameter that fits summed statistics best."""


@dataclass(frozen=True)
class Mixture:
    """Round normal clouds of one common width; a state holds a row's shares in them.

    Parameters per cloud are its weight and its centre; the last number is the variance. The
    loss is the negative log-likelihood. A cloud without rows has weight 0 and no share.
    """

    k: int
    dim: int

    @property
    def statistics(self) -> int:
        return self.k * (self.dim + 1) + 1

    def expect(self, X, w):
        clouds, variance = w[:-1].reshape(self.k, self.dim + 1), w[-1]
        with np.errstate(divide="ignore"):
            log = np.log(clouds[:, 0])
        far = np.stack([((X - centre) ** 2).sum(axis=1) for centre in clouds[:, 1:]], axis=1)
        log = log - far / (2 * variance) - self.dim / 2 * np.log(2 * np.pi * variance)
        top = log.max(axis=1, keepdims=True)
        shares = np.exp(log - top)
        whole = shares.sum(axis=1, keepdims=True)
        return shares / whole, -(top + np.log(whole))[:, 0]

    def collect(self, X, states):
        sums = np.hstack([states.sum(axis=0)[:, None], states.T @ X])
        return np.append(sums.ravel(), (states * (X**2).sum(axis=1)[:, None]).sum())

    def maximise(self, total):
        sums, squares = total[:-1].reshape(self.k, self.dim + 1), total[-1]
        n = sums[:, :1]
        centres = np.divide(sums[:, 1:], n, out=np.zeros_like(sums[:, 1:]), where=n > 0)
        variance = (squares - (n[:, 0] * (centres**2).sum(axis=1)).sum()) / max(n.sum() * self.dim, 1)
        return np.append(np.hstack([n / max(n.sum(), 1), centres]).ravel(), variance)


def train_hidden(
    df: DataFrame,
    model: Hidden,
    initial: Callable[[np.ndarray, np.ndarray], np.ndarray],
    batch: int | None,
    steps: int,
    keeping: Keeping | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train on ``(id, x)``, ids 0 to N-1; ``initial(ids, X)`` gives the rows' first states.

    Each step takes the next ``batch`` rows by id, wrapping at the end. Returns the history
    ``(iter, n, loss, w)``, loss being the mean within the batch before the step, and the states ``(id, z)``.
    """
    spark = df.sparkSession
    archive = keeping.archive if keeping is not None else None
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/states-{uuid.uuid4().hex}"
    table = Segments(spark, f"{snapshots.folder(archive)}/states" if archive else scratch)
    recorder = Recorder(spark, keeping, lambda found: spark.createDataFrame(found, FIELDS))
    recorder.committed = table.drop
    parts = lambda b: (np.asarray(b.column("id")), matrix(b.column("x")))

    def first(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), lists(initial(*parts(b)))], names=["id", "z"])

    def counted(b):
        ids, X = parts(b)
        return model.collect(X, initial(ids, X))

    def move(w):
        names = ["id", "z", "v"]

        def run(batches):
            change = np.zeros(model.statistics + 2)
            for b in batches:
                if b.num_rows:
                    _, X = parts(b)
                    states, loss = model.expect(X, w)
                    moved = model.collect(X, states) - model.collect(X, matrix(b.column("z")))
                    change += np.append(moved, [loss.sum(), len(X)])
                    yield pa.RecordBatch.from_arrays([b.column("id"), lists(states), pa.nulls(b.num_rows, pa.list_(pa.float64()))], names=names)
            if change[-1]:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), lists(change[None, :])], names=names)

        return run

    def vector(summed: DataFrame, width: int) -> np.ndarray:
        got, out = summed.toPandas(), np.zeros(width)
        out[got["j"].to_numpy()] = got["v"].to_numpy()
        return out

    with held(df.select("id", "x")) as rows:
        count = numbered_rows(rows)
        size = count if batch is None else min(batch, count)
        before = recorder.restored()
        if before is not None:
            total, at, points, begun = before.vectors["total"], int(before.numbers["at"]), int(before.numbers["points"]), before.iter
            table.at(before.tables["states"])
        else:
            table.replace([(0, count)], rows.mapInArrow(first, "id bigint, z array<double>"))
            total, at, points, begun = vector(sum_batches(rows, counted), model.statistics), 0, 0, 0
            recorder.records.append((0, 0, None, model.maximise(total).tolist()))

        def state() -> Snapshot:
            return Snapshot(step, {"at": at, "points": points}, {"total": total}, {"states": table.version()})

        for step in range(begun + 1, begun + steps + 1):
            ranges = spans(at, size, count)
            met = batch_slice(rows, at, size, count).join(small(table.read(ranges), size), "id")
            both = cut(met.select("id", "x", "z").mapInArrow(move(model.maximise(total)), "id bigint, z array<double>, v array<double>"))
            sums = both.where(F.col("id").isNull()).select(F.posexplode("v").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"))
            out = vector(sums, model.statistics + 2)
            table.replace(ranges, both.where(F.col("id").isNotNull()).select("id", "z"))
            total = total + out[:-2]
            at, points = (at + size) % count, points + int(out[-1])
            record = (step, int(out[-1]), float(out[-2] / out[-1]), model.maximise(total).tolist())
            if recorder.note(step, points, lambda _: record, state, step == begun + steps):
                break
    states = cut(table.read())
    if not archive:
        table.clear()
    return recorder.result(), states
