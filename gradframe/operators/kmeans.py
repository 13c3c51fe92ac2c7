"""K-means: full (Lloyd) steps and incremental EM over batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.functions.batches import lists, matrix
from gradframe.functions.models import KMeans
from gradframe.operators.gradients import sum_batches
from gradframe.operators.prep import batch_slice, numbered_rows
from gradframe.operators.progress import Keeping, Recorder
from gradframe.plans.lineage import checkpoint_dir, cut, held
from gradframe.plans.segments import Segments, spans
from gradframe.plans.sizes import small
from gradframe.sources import snapshots
from gradframe.sources.snapshots import Snapshot


def _rows_and_counts(X: np.ndarray, z: np.ndarray, sign: float, k: int) -> np.ndarray:
    """``k x (dim + 1)`` block of signed coordinate sums and counts."""
    member = np.zeros((k, len(z)))
    member[z, np.arange(len(z))] = sign
    return member @ np.hstack([X, np.ones((len(X), 1))])


def _collect(summed: DataFrame, width: int) -> np.ndarray:
    got = summed.toPandas()
    out = np.zeros(width)
    out[got["j"].to_numpy()] = got["v"].to_numpy()
    return out


def centres_by(df: DataFrame, width: int, group: str = "z") -> DataFrame:
    """Centroid sums and counts as ``(z, j, s, n)``.

    A cluster may hold most rows: sums are formed per task before the shuffle,
    so its size does not matter.
    """
    sums = df.groupBy(F.col(group).alias("z")).agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(j))) for j in range(width)]).alias("s")
    )
    return sums.select("z", "n", F.posexplode("s").alias("j", "s"))


def lloyd(df: DataFrame, k: int, dim: int, w0: np.ndarray, steps: int) -> DataFrame:
    """Assign all rows, re-mean: ``(iter, loss, w)``, loss being the mean distance."""
    spark, model = df.sparkSession, KMeans(k, dim)
    w, log = np.array(w0, float), []
    with held(df.select("x")) as rows:
        for step in range(steps):
            def of_batch(batch, w=w):
                X = matrix(batch.column("x"))
                z, far = model.nearest(X, w)
                return np.append(_rows_and_counts(X, z, 1.0, k).ravel(), [far.sum(), len(X)])

            out = _collect(sum_batches(rows, of_batch), model.width + 2)
            w = out[:-2]
            log.append((step + 1, float(out[-2] / out[-1]), [float(v) for v in w]))
    return spark.createDataFrame(log, "iter int, loss double, w array<double>")


FIELDS = "iter int, n bigint, moved bigint, loss double, w array<double>"


def train_em(
    df: DataFrame,
    k: int,
    dim: int,
    initial: Callable[[np.ndarray], np.ndarray],
    batch: int | None,
    steps: int,
    keeping: Keeping | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Incremental EM on ``(id, x)``, ids 0 to N-1.

    ``initial(ids)`` gives the first cluster of rows. Each step moves one batch:
    a row whose cluster changes leaves the old centre and joins the new one.
    Returns the history ``(iter, n, moved, loss, w)``, loss being the mean
    distance within the batch, and the final state ``(id, z)``; ``keeping`` archives and resumes.

    The clusters are a table in segments by id. A step reads those of its batch and
    writes them anew; the driver holds one parameter, whatever the number of batches is.
    """
    spark, model = df.sparkSession, KMeans(k, dim)
    archive = keeping.archive if keeping is not None else None
    folder = snapshots.folder(archive) if archive else checkpoint_dir(spark).rstrip("/")
    table = Segments(spark, f"{folder}/clusters" if archive else f"{folder}/clusters-{uuid.uuid4().hex}")
    recorder = Recorder(spark, keeping, lambda found: spark.createDataFrame(found, FIELDS))
    recorder.committed = table.drop

    def first(batches):
        for b in batches:
            if b.num_rows:
                z = initial(np.asarray(b.column("id")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(z.astype(np.int32))], names=["id", "z"])

    def counted(b):
        ids, X = np.asarray(b.column("id")), matrix(b.column("x"))
        return _rows_and_counts(X, initial(ids), 1.0, k).ravel()

    def move(w):
        def run(batches):
            acc = np.zeros(model.width + 3)
            for b in batches:
                if b.num_rows:
                    X, old = matrix(b.column("x")), np.asarray(b.column("z"))
                    new, far = model.nearest(X, w)
                    moved = old != new
                    change = _rows_and_counts(X[moved], new[moved], 1.0, k)
                    change += _rows_and_counts(X[moved], old[moved], -1.0, k)
                    acc += np.append(change.ravel(), [moved.sum(), far.sum(), len(X)])
                    none = pa.nulls(b.num_rows, pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(new.astype(np.int32)), none], names=names)
            if acc[-1]:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), lists(acc[None, :])], names=names)

        names = ["id", "z", "v"]
        return run

    with held(df.select("id", "x")) as rows:
        total = numbered_rows(rows)
        size = total if batch is None else min(batch, total)
        before = recorder.restored()
        if before is not None:
            w, at, points, begun = before.vectors["w"], int(before.numbers["at"]), int(before.numbers["points"]), before.iter
            table.at(before.tables["clusters"])
        else:
            table.replace([(0, total)], rows.select("id").mapInArrow(first, "id bigint, z int"))
            w, at, points, begun = _collect(sum_batches(rows, counted), model.width), 0, 0, 0
            recorder.records.append((0, 0, 0, None, [float(v) for v in w]))

        def state() -> Snapshot:
            return Snapshot(step, {"at": at, "points": points}, {"w": w}, {"clusters": table.version()})

        for step in range(begun + 1, begun + steps + 1):
            ranges = spans(at, size, total)
            met = batch_slice(rows, at, size, total).join(small(table.read(ranges), size), "id")
            both = cut(met.select("id", "x", "z").mapInArrow(move(w), "id bigint, z int, v array<double>"))
            sums = both.where(F.col("id").isNull()).select(F.posexplode("v").alias("j", "v"))
            out = _collect(sums.groupBy("j").agg(F.sum("v").alias("v")), model.width + 3)
            table.replace(ranges, both.where(F.col("id").isNotNull()).select("id", "z"))
            w = w + out[:-3]
            at, points = (at + size) % total, points + int(out[-1])
            record = (step, int(out[-1]), int(out[-3]), float(out[-2] / out[-1]), [float(v) for v in w])
            if recorder.note(step, points, lambda _: record, state, step == begun + steps):
                break
    states = cut(table.read())
    if not archive:
        table.clear()
    return recorder.result(), states


def moves(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """Change of sums and counts as ``(z, j, s, n)`` from rows changing cluster.

    The last position, ``j = dim``, of every cluster is its count.
    """
    changed = df.where(old != new)
    signed = F.array(
        F.struct(old.alias("z"), F.lit(-1.0).alias("sign")),
        F.struct(new.alias("z"), F.lit(1.0).alias("sign")),
    )
    each = changed.select(F.explode(signed).alias("m"), "x").select(F.col("m.z").cast("int").alias("z"), F.col("m.sign").alias("sign"), "x")

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                z, sign, X = np.asarray(b.column("z")), np.asarray(b.column("sign")), matrix(b.column("x"))
                signed_rows = np.hstack([X, np.ones((len(X), 1))]) * sign[:, None]
                for c in np.unique(z):
                    sums[int(c)] = sums.get(int(c), 0.0) + signed_rows[z == c].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), lists(np.array(list(sums.values())))], names=["z", "s"])

    parts = each.mapInArrow(partial, "z int, s array<double>")
    return parts.select("z", F.posexplode("s").alias("j", "s")).groupBy("z", "j").agg(F.sum("s").alias("s"))


def objective(df: DataFrame, model: KMeans, w: np.ndarray) -> DataFrame:
    """Sum and mean of the distances to the nearest centre."""
    from gradframe.operators.scoring import nearest

    return nearest(df, model, w, keep=[]).agg(
        F.sum("dist").alias("total"), F.avg("dist").alias("mean")
    )
