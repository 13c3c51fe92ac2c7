"""Scoring rows against one parameter vector: one pass, no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradframe.functions import vec
from gradframe.functions.batches import lists, matrix, sequences
from gradframe.functions.models import LR, KMeans, Model
from gradframe.functions.network import SeqNet

NARROW = 16  # inputs up to which a score is written out as one expression


def logit(x: str | Column, w: np.ndarray, width: int) -> Column:
    """``w . x + b`` written out term by term, so that it is compiled.

    A row of another length is an error here as it is on the way over Arrow batches.
    """
    x = F.col(x) if isinstance(x, str) else x
    z = F.lit(float(w[width]))
    for j in range(width):
        z = z + F.get(x, F.lit(j)) * F.lit(float(w[j]))
    return F.when(F.size(x) == width, z).otherwise(F.raise_error(F.lit("rows differ in length")).cast("double"))


def score(df: DataFrame, model: Model, w: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Add ``p ARRAY<DOUBLE>`` and, where ``y`` is there, ``loss``.

    Sequence models read ``xs`` instead of ``x``. ``keep`` names the columns to
    carry along; leaving wide inputs out saves moving them.
    """
    keep = df.columns if keep is None else keep
    with_loss = "y" in df.columns
    if isinstance(model, LR) and model.inputs <= NARROW:
        p = vec.sigmoid(logit("x", w, model.inputs))
        out = df.withColumn("p", F.array(p))
        if with_loss:
            out = out.withColumn("loss", vec.log_loss(F.get("p", F.lit(0)), F.get("y", F.lit(0))))
        return out.select(*keep, "p", *(["loss"] if with_loss else []))
    source = "xs" if isinstance(model, SeqNet) else "x"
    needed = list(dict.fromkeys([*keep, source, *(["y"] if with_loss else [])]))
    fields = [df.schema[c] for c in keep] + [T.StructField("p", T.ArrayType(T.DoubleType()))]
    if with_loss:
        fields.append(T.StructField("loss", T.DoubleType()))
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            P = scores_of(model, batch.column(source), w)
            columns = [batch.column(c) for c in keep] + [lists(P)]
            if with_loss:
                columns.append(pa.array(model.loss(P, matrix(batch.column("y")))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*needed).mapInArrow(run, T.StructType(fields))


def scores_of(model: Model, column: pa.Array, w: np.ndarray) -> np.ndarray:
    """Outputs for one Arrow batch; sequences are grouped by their length."""
    if not isinstance(model, SeqNet):
        return model.score(matrix(column), w)
    P = np.empty((len(column), model.outputs))
    for rows, X in sequences(column):
        P[rows] = model.score(X, w)
    return P


def nearest(df: DataFrame, model: KMeans, w: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Add the nearest centre ``z`` and its distance ``dist``."""
    keep = df.columns if keep is None else keep
    fields = [df.schema[c] for c in keep] + [
        T.StructField("z", T.IntegerType()),
        T.StructField("dist", T.DoubleType()),
    ]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z, far = model.nearest(matrix(batch.column("x")), w)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(z.astype(np.int32)), pa.array(far)],
                    names=names,
                )

    return df.select(*dict.fromkeys([*keep, "x"])).mapInArrow(run, T.StructType(fields))


def mean_loss(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    """Matched outputs over all outputs."""
    hits = F.aggregate(
        F.zip_with("p", "y", lambda p, y: (vec.classify(p) == y).cast("int")),
        F.lit(0),
        lambda s, h: s + h,
    )
    return scored.agg((F.sum(hits) / F.sum(F.size("y"))).alias("accuracy"))
