"""Whole parameter histories against a dataset.

Records and rows are both read by the tasks: blocks of rows meet blocks of records
(:mod:`gradframe.plans.blockjoin`), and what comes out are sums or values per record. The driver
sees neither the history nor anything else that grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradframe.functions import vec
from gradframe.functions.batches import lists, matrix
from gradframe.functions.models import Model
from gradframe.operators.gradients import batch_grad_rows, batch_grad_sum, batch_measures
from gradframe.operators.prep import pick_records
from gradframe.operators.scoring import scores_of
from gradframe.plans.blockjoin import meet
from gradframe.plans.lineage import spread
from gradframe.plans.ordered import lagged
from gradframe.plans.sizes import small

HELD_VALUES = 1 << 22  # numbers of sums that a task holds before it hands them on


def _inputs(df: DataFrame) -> list[str]:
    return [c for c in ("x", "xs", "y") if c in df.columns]


def pending(history: DataFrame, done: DataFrame | None) -> DataFrame:
    """Records that were not handled by an earlier run."""
    if done is None:
        return history
    return history.join(small(done.select("iter").distinct()), "iter", "left_anti")


def _summed(pairs: Iterator, of: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Add up ``of(rows, w) -> vector`` per record over all pairs of a task."""
    sums: dict[int, np.ndarray] = {}

    def ready() -> pa.RecordBatch:
        values = np.array(list(sums.values()))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), lists(values)], names=names)

    for rows, records in pairs:
        for i, w in zip(records.column("iter").to_pylist(), matrix(records.column("w"))):
            part = of(rows, w)
            sums[i] = sums[i] + part if i in sums else part
            if len(sums) * len(part) > HELD_VALUES:
                yield ready()
                sums.clear()
    if sums:
        yield ready()


def _loss_sums(rows: DataFrame, model: Model, history: DataFrame) -> DataFrame:
    """``(iter, loss, accuracy)``: sums per task, then per record."""
    source = "xs" if "xs" in rows.columns else "x"

    def of(b, w):
        Y = matrix(b.column("y"))
        P = scores_of(model, b.column(source), w)
        return np.array([model.loss(P, Y).sum(), ((P >= 0.5) == Y).sum(), len(Y)], float)

    parts = meet(rows, history.select("iter", "w"), lambda pairs: _summed(pairs, of, ["iter", "s"]), "iter int, s array<double>")
    total = lambda j: F.sum(F.get("s", F.lit(j)))
    return parts.groupBy("iter").agg(
        (total(0) / total(2)).alias("loss"), (total(1) / (total(2) * F.lit(model.outputs))).alias("accuracy")
    )


def improvements(history: DataFrame) -> DataFrame:
    """Distance of every record to the one before, on the executors: ``(iter, delta)``."""
    before = lagged(history.select("iter", "w"), [], ["iter"], F.col("w"), "b")
    return before.select(
        "iter",
        F.when(F.col("b").isNull(), F.sqrt(vec.sq("w"))).otherwise(vec.dist("w", "b")).alias("delta"),
    )


def evaluate(
    df: DataFrame,
    model: Model,
    history: DataFrame,
    reference: np.ndarray | None = None,
    accuracy: bool = True,
    done: DataFrame | None = None,
) -> DataFrame:
    """``(iter, time, n, loss, accuracy, difference, delta)`` per record.

    Each record's ``delta`` is its distance to the one before, whether that was ``done`` or not.
    """
    gap = F.lit(0.0) if reference is None else vec.dist("w", vec.vector(float(v) for v in reference))
    facts = pending(history, done).select("iter", "time", "n", gap.alias("difference"))
    scored = _loss_sums(spread(df.select(*_inputs(df))), model, pending(history, done))
    out = facts.join(scored, "iter").join(improvements(history), "iter")
    names = ["iter", "time", "n", "loss", *(["accuracy"] if accuracy else []), "difference", "delta"]
    return out.select(*names)


def losses(df: DataFrame, model: Model, history: DataFrame) -> DataFrame:
    """``(iter, loss)`` of every record against every row."""
    return _loss_sums(spread(df.select(*_inputs(df))), model, history).select("iter", "loss")


def _per_record(df: DataFrame, history: DataFrame, field: T.StructField, make: Callable) -> DataFrame:
    """``(iter, id, value)``: ``make(batch, records, r) -> Arrow array`` for every record."""
    schema = T.StructType(
        [T.StructField("iter", T.IntegerType()), T.StructField("id", T.LongType()), field]
    )
    names = ["iter", "id", field.name]

    def visit(pairs):
        for b, records in pairs:
            for r, i in enumerate(records.column("iter").to_pylist()):
                number = pa.array(np.full(b.num_rows, i, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([number, b.column("id"), make(b, records, r)], names=names)

    return meet(spread(df.select("id", *_inputs(df))), history, visit, schema)


def _vector_of(records: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return records.column(name)[r].values.to_numpy(zero_copy_only=False)


def gradient_history(
    df: DataFrame, model: Model, history: DataFrame, lines: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Gradients of all rows under the chosen records: ``(iter, id, g)``."""
    chosen = pick_records(history, lines) if lines else history
    field = T.StructField("g", T.ArrayType(T.DoubleType()))
    make = lambda b, records, r: lists(batch_grad_rows(model, b, _vector_of(records, "w", r))[0])
    return _per_record(df, chosen.select("iter", "w"), field, make)


def mean_gradients(df: DataFrame, model: Model, history: DataFrame) -> DataFrame:
    """Mean gradient under every record as ``(iter, m)``, in one scan."""
    of = lambda b, w: np.append(batch_grad_sum(model, b, w)[0], b.num_rows)
    rows = spread(df.select(*_inputs(df)))
    parts = meet(rows, history.select("iter", "w"), lambda pairs: _summed(pairs, of, ["iter", "s"]), "iter int, s array<double>")
    sums = parts.select("iter", F.posexplode("s").alias("j", "v")).groupBy("iter", "j").agg(F.sum("v").alias("v"))
    # one vector per record, as in the history itself
    whole = sums.groupBy("iter").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("a"))
    value = F.transform("a", lambda e: e["v"])
    n = F.element_at(value, -1)
    return whole.select("iter", F.transform(F.slice(value, 1, model.width), lambda v: v / n).alias("m"))


def priority_history(
    df: DataFrame,
    model: Model,
    history: DataFrame,
    how: str = "length",
    lines: list[tuple[int, int]] | None = None,
    done: DataFrame | None = None,
) -> DataFrame:
    """Priorities of all rows under the chosen records: ``(iter, id, p)``.

    The projection recomputes gradients in a second scan instead of storing
    them: they are wider than the data.
    """
    chosen = pending(pick_records(history, lines) if lines else history, done).select("iter", "w")
    projected = how == "projection"
    if projected:
        chosen = chosen.join(mean_gradients(df, model, chosen), "iter")

    def make(b, records, r):
        direction = _vector_of(records, "m", r) if projected else None
        return pa.array(batch_measures(model, b, _vector_of(records, "w", r), direction)[0])

    return _per_record(df, chosen, T.StructField("p", T.DoubleType()), make)
