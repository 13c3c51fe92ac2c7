"""Per-row gradients and their sums.

Sums are formed inside the tasks; what is shuffled is one vector per task, and
what reaches the driver is one vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradframe.functions import vec
from gradframe.functions.batches import lists, matrix, sequences
from gradframe.functions.models import LR, Model
from gradframe.functions.network import SeqNet
from gradframe.operators.scoring import NARROW, logit


def _source(model: Model) -> str:
    return "xs" if isinstance(model, SeqNet) else "x"


def batch_grad_rows(model: Model, batch: pa.RecordBatch, w: np.ndarray):
    """Gradients and losses of the rows of one Arrow batch."""
    Y = matrix(batch.column("y"))
    if not isinstance(model, SeqNet):
        return model.grad_rows(matrix(batch.column("x")), Y, w)
    G, loss = np.empty((len(Y), model.width)), np.empty(len(Y))
    for rows, X in sequences(batch.column("xs")):
        G[rows], loss[rows] = model.grad_rows(X, Y[rows], w)
    return G, loss


def batch_measures(model: Model, batch: pa.RecordBatch, w: np.ndarray, direction: np.ndarray | None = None):
    """Squared lengths or projections of the rows' gradients, their sum and the sum of losses."""
    Y = matrix(batch.column("y"))
    if not isinstance(model, SeqNet):
        return model.measures(matrix(batch.column("x")), Y, w, direction)
    p, total, lost = np.empty(len(Y)), np.zeros(model.width), 0.0
    for rows, X in sequences(batch.column("xs")):
        p[rows], g, loss = model.measures(X, Y[rows], w, direction)
        total, lost = total + g, lost + loss
    return p, total, lost


def batch_grad_sum(model: Model, batch: pa.RecordBatch, w: np.ndarray):
    return batch_measures(model, batch, w)[1:]


def gradients(
    df: DataFrame, model: Model, w: np.ndarray, keep: list[str] | None = None
) -> DataFrame:
    """Add ``g ARRAY<DOUBLE>`` and ``loss`` per row."""
    keep = df.columns if keep is None else keep
    if is_narrow(model):
        y = F.get("y", F.lit(0))
        out = df.withColumn("_p", vec.sigmoid(logit("x", w, model.inputs)))
        out = out.withColumn("loss", vec.log_loss("_p", y)).withColumn("_e", F.col("_p") - y)
        g = F.array(
            *[F.get("x", F.lit(j)) * F.col("_e") for j in range(model.inputs)], F.col("_e")
        )
        return out.select(*keep, g.alias("g"), "loss")
    fields = [df.schema[c] for c in keep] + [
        T.StructField("g", T.ArrayType(T.DoubleType())),
        T.StructField("loss", T.DoubleType()),
    ]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                G, loss = batch_grad_rows(model, batch, w)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], lists(G), pa.array(loss)], names=names
                )

    needed = dict.fromkeys([*keep, _source(model), "y"])
    return df.select(*needed).mapInArrow(run, T.StructType(fields))


def sum_batches(df: DataFrame, of_batch: Callable) -> DataFrame:
    """Add up ``of_batch(record batch) -> vector`` over all rows as ``(j, v)``."""

    def partial(batches):
        acc = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(batch)
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.RecordBatch.from_arrays([lists(acc[None, :])], names=["v"])

    parts = df.mapInArrow(partial, "v array<double>")
    return (
        parts.select(F.posexplode("v").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"))
    )


def vector_sum(df: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """Element-wise sum of an array column as ``(j, v)``.

    Up to a moderate width the sums are plain aggregates, one per position;
    beyond it arrays are added up per task before anything is exploded.
    """
    if width is not None and width <= 256:
        one = df.agg(F.array(*[F.sum(F.get(column, F.lit(j))) for j in range(width)]).alias("v"))
        return one.select(F.posexplode("v").alias("j", "v"))
    return sum_batches(df.select(column), lambda b: matrix(b.column(0)).sum(axis=0))


def grad_sum(df: DataFrame, model: Model, w: np.ndarray) -> DataFrame:
    """``(n, loss, j, g)``: row count, loss sum and gradient sum per position."""
    if is_narrow(model):
        one = _narrow_sums(df, model, w)
        return one.select("n", "loss", F.posexplode("g").alias("j", "g"))
    parts = _partial_sums(df, model, w).select("n", "loss", F.posexplode("g").alias("j", "g"))
    return parts.groupBy("j").agg(
        F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("g").alias("g")
    )


def is_narrow(model: Model) -> bool:
    return isinstance(model, LR) and model.inputs <= NARROW


def loop_columns(df: DataFrame, model: Model) -> DataFrame:
    """What a training loop reads: for narrow models one plain column per input.

    Plain columns are cached compactly and leave arrays out of the compiled code.
    """
    if not is_narrow(model):
        return df.select(*[c for c in ("id", "x", "xs", "y") if c in df.columns])
    return df.select(
        *[c for c in ("id",) if c in df.columns],
        *[F.get("x", F.lit(j)).alias(f"_x{j}") for j in range(model.inputs)],
        F.get("y", F.lit(0)).alias("_y"),
    )


def _narrow_sums(df: DataFrame, model: LR, w: np.ndarray) -> DataFrame:
    flat = df if "_y" in df.columns else loop_columns(df, model)
    names = [f"_x{j}" for j in range(model.inputs)]
    z = F.lit(float(w[-1]))
    for name, v in zip(names, w):
        z = z + F.col(name) * F.lit(float(v))
    rows = flat.select(*names, "_y", vec.sigmoid(z).alias("_p"))
    rows = rows.withColumn("_e", F.col("_p") - F.col("_y"))
    return rows.agg(
        F.count("*").alias("n"),
        F.sum(vec.log_loss("_p", "_y")).alias("loss"),
        F.array(*[F.sum(F.col(name) * F.col("_e")) for name in names], F.sum("_e")).alias("g"),
    )


def _partial_sums(df: DataFrame, model: Model, w: np.ndarray) -> DataFrame:
    """One row ``(n, loss, g)`` per task."""

    def partial(batches):
        n, loss, g = 0, 0.0, np.zeros(model.width)
        for batch in batches:
            if batch.num_rows:
                part, lost = batch_grad_sum(model, batch, w)
                n, loss, g = n + batch.num_rows, loss + lost, g + part
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([loss]), lists(g[None, :])], names=["n", "loss", "g"]
            )

    return df.select(_source(model), "y").mapInArrow(partial, "n bigint, loss double, g array<double>")


def reduce_gradient(df: DataFrame, model: Model, w: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Run the pass: ``(n, sum of losses, sum of gradients)``."""
    if is_narrow(model):
        row = _narrow_sums(df, model, w).first()
        if not row["n"]:
            return 0, 0.0, np.zeros(model.width)
        return row["n"], row["loss"], np.array(row["g"])
    got = grad_sum(df, model, w).toPandas()
    g = np.zeros(model.width)
    if not len(got):
        return 0, 0.0, g
    g[got["j"].to_numpy()] = got["g"].to_numpy()
    return int(got["n"].iloc[0]), float(got["loss"].iloc[0]), g


def block_means(graded: DataFrame, block: int, width: int) -> DataFrame:
    """Mean gradient per block of consecutive ids as ``(block, j, g, n)``."""
    means = graded.groupBy(F.floor(F.col("id") / block).alias("block")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(F.get("g", F.lit(j))) for j in range(width)]).alias("g")
    )
    return means.select("block", "n", F.posexplode("g").alias("j", "g"))


def apply_wide(params: DataFrame, grad: DataFrame, factor: float) -> DataFrame:
    """``w + factor * g`` on tables ``(j, w)`` and ``(j, g)``.

    For models too wide for one driver-side vector; positions without a
    gradient stay as they are.
    """
    step = F.lit(float(factor)) * F.coalesce(F.col("g"), F.lit(0.0))
    return params.join(grad.select("j", "g"), "j", "left").select("j", (F.col("w") + step).alias("w"))
