"""Row priorities by gradient, their decay models, and training on the top rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradframe.functions import vec
from gradframe.functions.batches import lists
from gradframe.functions.models import LR, Model
from gradframe.operators.gradients import (
    batch_grad_rows,
    batch_grad_sum,
    batch_measures,
    gradients,
    is_narrow,
    reduce_gradient,
    vector_sum,
)
from gradframe.operators.prep import batch_slice, numbered_rows
from gradframe.operators.progress import Keeping, Recorder
from gradframe.operators.scoring import NARROW
from gradframe.plans.lineage import checkpoint_dir, cut, held
from gradframe.plans.segments import Segments, spans
from gradframe.plans.sizes import BROADCAST_ROWS, small
from gradframe.plans.topk import heap_for, top_k
from gradframe.sources import history, snapshots
from gradframe.sources.scores import write_by_iter
from gradframe.sources.snapshots import Snapshot

SMOOTHING = 0.8  # fixed value: weight of the newest slope in the decay models
LOOK_BACK = 40  # renewals that still show in a decay model's slopes
SHORT_RUN = 64  # rows of a block in a batch, below which their gradients are formed together
GRADIENT_NUMBERS = 1 << 20  # of the gradients formed at a time
VERSION_STEP = 32  # fixed value: points per version in the version-by-points variation

LENGTH, PROJECTION = "length", "projection"


def priorities(
    df: DataFrame,
    model: Model,
    w: np.ndarray,
    how: str = LENGTH,
    direction: np.ndarray | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``(id, p)``: squared gradient length, or projection on the mean gradient.

    A projection without a given ``direction`` first runs the pass that yields
    the mean gradient. Gradients stay inside the tasks; only ``p`` comes out.
    """
    if how == PROJECTION and direction is None:
        n, _, g = reduce_gradient(df, model, w)
        direction = g / max(n, 1)
    if how == LENGTH:
        direction = None
    keep = ["id"] if keep is None else keep
    if isinstance(model, LR) and model.inputs <= NARROW:
        graded = gradients(df, model, w, keep=keep)
        g = lambda j: F.get("g", F.lit(j))
        terms = [g(j) * (g(j) if direction is None else F.lit(float(direction[j])))
                 for j in range(model.width)]
        return graded.select(*keep, sum(terms[1:], terms[0]).alias("p"))
    fields = [df.schema[c] for c in keep] + [T.StructField("p", T.DoubleType())]
    names = [f.name for f in fields]

    def run(batches):
        for b in batches:
            if b.num_rows:
                p, _, _ = batch_measures(model, b, w, direction)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in keep], pa.array(p)], names=names
                )

    needed = dict.fromkeys([*keep, *[c for c in ("x", "xs", "y") if c in df.columns]])
    return df.select(*needed).mapInArrow(run, T.StructType(fields))


# --- decay models: Columns over a state row -----------------------------------
#
# ``s(name)`` is the state column of that name; by default a column of the table.


@dataclass(frozen=True)
class Keep:
    """The last value stays as it is."""

    columns = ("p",)

    def initial(self, p: Column, version: Column) -> list[Column]:
        return [p]

    def at(self, now: Column, s: Callable = F.col) -> Column:
        return s("p")

    def updated(self, p: Column, now: Column, s: Callable = F.col) -> list[Column]:
        return [p]


def _log_ratio(p: Column, old: Column) -> Column:
    ratio = F.try_divide(p, old)
    return F.when(ratio > 0, F.log(ratio)).otherwise(F.lit(0.0))


def _smoothed(new: Column, old: Column) -> Column:
    return F.lit(SMOOTHING) * new + F.lit(1 - SMOOTHING) * old


@dataclass(frozen=True)
class ExpLinear:
    """``p * exp(a * dv)`` with the smoothed slope of the log-priority."""

    columns = ("p", "ver", "a")

    def initial(self, p, version):
        return [p, version, F.lit(0.0)]

    def at(self, now, s=F.col):
        return vec.decay_linear(s("p"), s("a"), s("ver"), now)

    def updated(self, p, now, s=F.col):
        gap = now - s("ver")
        slope = F.try_divide(_log_ratio(p, s("p")), gap)
        fresh = (p, now, _smoothed(slope, s("a")))
        return [F.when(gap == 0, s(c)).otherwise(f) for c, f in zip(self.columns, fresh)]


@dataclass(frozen=True)
class ExpQuadratic:
    """Log-priority as a quadratic ``a v^2 + b v + c`` in the version.

    Over one gap it rises at the mean rate ``a * (sum of both versions) + b``. So two gaps one
    after the other give ``a`` as a divided difference of their rates, and ``b`` as what is left of
    the newer rate. ``rate`` and ``sum`` are those of the gap before; a point that has had
    only one gap goes on at its rate.
    """

    columns = ("p", "ver", "a", "b", "rate", "sum")

    def initial(self, p, version):
        return [p, version, F.lit(0.0), F.lit(-1.0), F.lit(None), F.lit(None)]

    def at(self, now, s=F.col):
        return vec.decay_quadratic(s("p"), s("a"), s("b"), s("ver"), now)

    def updated(self, p, now, s=F.col):
        rate = F.try_divide(_log_ratio(p, s("p")), now - s("ver"))
        both = (now + s("ver")).cast("double")
        bend = F.try_divide(rate - s("rate"), both - s("sum"))
        once = s("rate").isNull()
        a = F.when(once, F.lit(0.0)).otherwise(_smoothed(bend, s("a")))
        b = F.when(once, rate).otherwise(_smoothed(rate - bend * both, s("b")))
        fresh = (p, now, a, b, rate, both)
        return [F.when(now == s("ver"), s(c)).otherwise(f) for c, f in zip(self.columns, fresh)]


DECAYS = {"keep": Keep(), "linear": ExpLinear(), "quadratic": ExpQuadratic()}


def named(decay, columns: list[Column]) -> list[Column]:
    kinds = {"ver": "bigint"}
    return [c.cast(kinds.get(n, "double")).alias(n) for n, c in zip(decay.columns, columns)]


def renew(state: DataFrame, fresh: DataFrame, decay, now: int, rows: int | None = None) -> DataFrame:
    """Merge new priorities ``(id, p)`` into the state table, by id."""
    version = F.lit(now).cast("bigint")
    new = small(fresh.select("id", F.col("p").alias("_p")), rows)
    joined = state.join(new, "id", "left")
    updated = decay.updated(F.col("_p"), version)
    merged = [
        F.when(F.col("_p").isNull(), F.col(c)).otherwise(u) for c, u in zip(decay.columns, updated)
    ]
    return joined.select("id", *named(decay, merged))


def fold_decay(series: DataFrame, decay, key: str = "id") -> DataFrame:
    """State after a whole series ``(key, ver, p)`` of each point, by version.

    Of several priorities of a version the least counts. A renewal leaves ``1 - SMOOTHING`` of the older slopes,
    so those before the ``LOOK_BACK`` newest renewals are below what doubles can show; only the newest are brought
    together, and tasks drop all others before the shuffle. A point with most of all rows stays as small as any.
    """
    once = series.groupBy(key, F.col("ver").cast("bigint").alias("v")).agg(F.min("p").alias("q"))
    newest = Window.partitionBy(key).orderBy(F.col("v").desc())
    recent = once.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= LOOK_BACK)
    arrays = recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("v", "q"))).alias("_s"))
    first = F.element_at("_s", 1)
    start = F.struct(*named(decay, decay.initial(first["q"], first["v"])))

    def step(acc, e):
        return F.struct(*named(decay, decay.updated(e["q"], e["v"], lambda n: acc[n])))

    later = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0)))
    return arrays.select(key, F.aggregate(later, start, step).alias("_r")).select(
        key, *[F.col("_r")[n].alias(n) for n in decay.columns]
    )


# --- prioritised training -----------------------------------------------------


def fresh_priorities(rows: DataFrame, model: Model, w: np.ndarray, direction: np.ndarray | None):
    """Priorities of ``rows`` and the sum of their gradients, from one pass."""

    def run(batches):
        acc = None
        for b in batches:
            if b.num_rows:
                p, part, _ = batch_measures(model, b, w, direction)
                acc = part if acc is None else acc + part
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(p), pa.nulls(b.num_rows, pa.list_(pa.float64()))],
                    names=["id", "p", "g"],
                )
        if acc is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), lists(acc[None, :])],
                names=["id", "p", "g"],
            )

    needed = [c for c in ("id", "x", "xs", "y") if c in rows.columns]
    both = cut(rows.select(*needed).mapInArrow(run, "id bigint, p double, g array<double>"))
    total = _vector(both.where(F.col("id").isNull()), model.width)
    return both.where(F.col("id").isNotNull()).select("id", "p"), total


def _vector(df: DataFrame, width: int) -> np.ndarray:
    out = np.zeros(width)
    got = vector_sum(df, "g", width).toPandas().dropna()
    out[got["j"].to_numpy()] = got["v"].to_numpy()
    return out


def top_gradient(rows: DataFrame, ids: DataFrame, k: int, model: Model, w: np.ndarray):
    """Gradient sum over the rows whose id was selected."""
    chosen = rows.join(small(ids.select("id"), k, BROADCAST_ROWS), "id", "left_semi")
    return reduce_gradient(chosen, model, w)


def _records(spark: SparkSession, keeping: Keeping | None) -> Recorder:
    return Recorder(spark, keeping, lambda found: history.rows(spark, found))


def _table(spark: SparkSession, keeping: Keeping | None, name: str = "priorities") -> Segments:
    """Where the loop's state table lies: beside the archive, else in a scratch folder."""
    if keeping is not None and keeping.archive:
        return Segments(spark, f"{snapshots.folder(keeping.archive)}/{name}")
    return Segments(spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def _finished(table: Segments, keeping: Keeping | None) -> DataFrame:
    """All rows of a state table, written once more; a scratch table is removed."""
    rows = cut(table.read())
    if keeping is None or not keeping.archive:
        table.clear()
    return rows


def _top(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, k, "p", "id", heap_for(scored))


def _patched(table: Segments, ranges, ids: DataFrame, fresh: DataFrame, decay, now: int, k: int) -> None:
    """Renew the priorities of scattered rows that lie in the ranges."""
    old = table.read(ranges).join(small(ids.select("id"), k), "id", "left_semi")
    table.patch(renew(old, fresh, decay, now, k), k)


def train_prioritised(
    df: DataFrame,
    model: Model,
    w0: np.ndarray,
    rate: float,
    top: float,
    renew_share: float,
    init: str = LENGTH,
    how: str = LENGTH,
    decay: str = "keep",
    variation: str = "",
    steps: int = 1,
    average: bool = True,
    compat: bool = False,
    log: str | None = None,
    keeping: Keeping | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train on the ``top`` share of rows by (decayed) priority; ids 0 to N-1.

    Per step: renew the priorities of the next ``renew_share`` of the rows, move
    the mean gradient, select the top rows, apply their gradient. Variations:
    ``r`` adds the renewed rows' gradient, ``l`` renews the top rows too, ``a``
    moves the mean gradient by the top rows, ``p`` counts versions by points.
    Returns the history ``(iter, time, n, w)`` and the state table; ``log``
    appends all priorities of every step to a table; ``keeping`` archives and resumes.

    The state is one narrow row per point, held in segments by id: a step reads and writes the
    renewed range (and with ``l`` the top rows), never the rest. The selection scans the
    state once, without a join.
    """
    spark, model_decay = df.sparkSession, DECAYS[decay]
    with held(df.select(*[c for c in ("id", "x", "xs", "y") if c in df.columns])) as rows:
        total = numbered_rows(rows)
        k, renewed = int(total * top), int(total * renew_share)
        move = (renewed + k) // VERSION_STEP if set("pd") & set(variation) else 1
        recorder, table = _records(spark, keeping), _table(spark, keeping)
        recorder.committed = table.drop
        before = recorder.restored()
        if before is not None:
            w, mean, begun = before.vectors["w"], before.vectors["mean"], before.iter
            version, at, points = (int(before.numbers[c]) for c in ("version", "at", "points"))
            table.at(before.tables["state"])
        else:
            w, mean, begun, version, at, points = np.array(w0, float), np.zeros(model.width), 0, move, 0, 0
            if PROJECTION in (init, how):
                n, _, g = reduce_gradient(rows, model, w)
                mean = g / n
            first = priorities(rows, model, w, init, mean)
            state = model_decay.initial(F.col("p"), F.lit(0))
            table.replace([(0, total)], first.select("id", *named(model_decay, state)))
            recorder.records.append((0, 0.0, 0, w))
        direction = lambda: mean if how == PROJECTION else None

        def moved(g, count):
            f = count / total
            if compat:
                return (1 - f) * mean * f + f * g
            return (1 - f) * mean + f * g / max(count, 1)

        def state() -> Snapshot:
            numbers = {"version": version, "at": at, "points": points}
            return Snapshot(step, numbers, {"w": w, "mean": mean}, {"state": table.version()})

        for step in range(begun + 1, begun + steps + 1):
            g1 = np.zeros(model.width)
            if renewed:
                ranges = spans(at, renewed, total)
                fresh, g1 = fresh_priorities(batch_slice(rows, at, renewed, total), model, w, direction())
                table.replace(ranges, renew(table.read(ranges), fresh, model_decay, version, renewed))
                mean = moved(g1, renewed)
                at = (at + renewed) % total
            scored = table.read().select("id", model_decay.at(F.lit(version)).alias("p"))
            ids = _top(scored, k)
            if "l" in variation:
                ids = cut(ids)
                chosen = rows.join(small(ids.select("id"), k), "id", "left_semi")
                fresh, g2 = fresh_priorities(chosen, model, w, direction())
                _patched(table, None, ids, fresh, model_decay, version, k)
            else:
                _, _, g2 = top_gradient(rows, ids, k, model, w)
            if "a" in variation:
                mean = moved(g2, k)
            version += move
            if average:
                delta = g2 / max(k, 1) + (g1 / max(renewed, 1) if "r" in variation else 0.0)
            else:
                delta = g2 + (g1 if "r" in variation else 0.0)
            w = w - rate * delta
            points += k
            if log:
                logged = table.read().select(
                    F.lit(step).alias("iter"), "id", model_decay.at(F.lit(version)).alias("p")
                )
                write_by_iter(logged, log)
            record = (step, float(step), points, w)
            if recorder.note(step, points, lambda _: record, state, step == begun + steps):
                break
        return recorder.result(), _finished(table, keeping)


# --- variants with other reference directions ---------------------------------


def train_block(
    df: DataFrame,
    model: Model,
    w0: np.ndarray,
    rate: float,
    top: float,
    block: int,
    renew_share: float,
    use_renewed: bool = False,
    batch: int | None = None,
    steps: int = 1,
    keeping: Keeping | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projection on the sum of block mean gradients, top rows within the batch.

    Blocks are runs of ``block`` consecutive ids. Their means are a table, of which a step rewrites
    the renewed blocks; only their sum, moved by what changed, comes to the driver. Returns history,
    ``(id, p)`` and ``(block, g)``.
    """
    spark = df.sparkSession
    with held(df.select("id", "x", "y")) as rows:
        total = numbered_rows(rows)
        block = min(block or total, total)
        size, renewed = min(batch or total, total), int(total * renew_share)
        recorder, table = _records(spark, keeping), _table(spark, keeping)
        means = _table(spark, keeping, "blocks")
        recorder.committed = lambda: (table.drop(), means.drop())
        before = recorder.restored()
        if before is not None:
            w, direction, begun = before.vectors["w"], before.vectors["direction"], before.iter
            at, start, points = (int(before.numbers[c]) for c in ("at", "start", "points"))
            table.at(before.tables["state"])
            means.at(before.tables["blocks"])
        else:
            w, begun, at, start, points = np.array(w0, float), 0, 0, 0, 0
            first = F.transform("g", lambda v: v / F.col("n")).alias("g")
            means.replace([(0, -(-total // block))], _block_sums(rows, model, w, block).select(F.col("block").alias("id"), first))
            direction = _vector(means.read(), model.width)
            table.replace([(0, total)], priorities(rows, model, w, PROJECTION, direction))
            recorder.records.append((0, 0.0, 0, w))

        def state() -> Snapshot:
            numbers = {"at": at, "start": start, "points": points}
            tables = {"state": table.version(), "blocks": means.version()}
            return Snapshot(step, numbers, {"w": w, "direction": direction}, tables)

        for step in range(begun + 1, begun + steps + 1):
            g = np.zeros(model.width)
            if renewed:
                part, ranges = batch_slice(rows, at, renewed, total), spans(at, renewed, total)
                fresh, g1 = fresh_priorities(part, model, w, direction)
                touched = _merged_spans([(lo // block, (hi - 1) // block + 1) for lo, hi in ranges])
                sums = _block_sums(part, model, w, block).select(F.col("block").alias("id"), "n", F.col("g").alias("_g"))
                share = F.col("n") / F.lit(float(block))
                mixed = F.zip_with(
                    "g", "_g", lambda old, s: old * (F.lit(1.0) - share) + s / F.col("n") * share
                )
                old = means.read(touched)
                changed = cut(old.join(sums, "id", "left").select(
                    "id", F.when(F.col("n").isNull(), F.col("g")).otherwise(mixed).alias("g")
                ))
                direction = direction + _vector(changed, model.width) - _vector(old, model.width)
                means.replace(touched, changed)
                table.replace(ranges, renew(table.read(ranges), fresh, DECAYS["keep"], step, renewed))
                at = (at + renewed) % total
                g = g1 if use_renewed else g
            k = round(top * size)
            inside = spans(start, size, total)
            ids = cut(_top(table.read(inside), k))
            chosen = rows.join(small(ids.select("id"), k), "id", "left_semi")
            fresh, g2 = fresh_priorities(chosen, model, w, direction)
            _patched(table, inside, ids, fresh, DECAYS["keep"], step, k)
            w = w - rate * (g + g2) / max(k, 1)
            start, points = (start + size) % total, points + k
            record = (step, float(step), points, w)
            if recorder.note(step, points, lambda _: record, state, step == begun + steps):
                break
        blocks = _finished(means, keeping).withColumnRenamed("id", "block")
        return recorder.result(), _finished(table, keeping), blocks


def _merged_spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _block_sums(rows: DataFrame, model: Model, w: np.ndarray, block: int) -> DataFrame:
    """Gradient sums per block as ``(block, n, g)``, added up inside the tasks first.

    Rows of a block may lie anywhere. Narrow models are compiled aggregates. Of others a batch adds up each run of rows of
    one block; where runs are short, a call a run would cost more than its rows, and it forms the gradients of some rows at a time.
    """
    of = F.expr(f"id div {block}")
    if is_narrow(model):
        graded = gradients(rows, model, w, keep=["id"])
        sums = [F.sum(F.get("g", F.lit(j))) for j in range(model.width)]
        return graded.groupBy(of.alias("block")).agg(F.count("*").alias("n"), F.array(*sums).alias("g"))
    at_once = max(1, GRADIENT_NUMBERS // model.width)

    def run(batches):
        for b in batches:
            if b.num_rows:
                own = np.asarray(b.column("id")) // block
                order = np.argsort(own, kind="stable")
                key, first, n = np.unique(own[order], return_index=True, return_counts=True)
                b, sums = b.take(pa.array(order)), np.zeros((len(key), model.width))
                if SHORT_RUN * len(key) <= b.num_rows:
                    for i, (a, m) in enumerate(zip(first, n)):
                        sums[i] = batch_grad_sum(model, b.slice(a, m), w)[0]
                else:
                    place = np.repeat(np.arange(len(key)), n)
                    for a in range(0, b.num_rows, at_once):
                        G = batch_grad_rows(model, b.slice(a, at_once), w)[0]
                        found, begin = np.unique(place[a : a + at_once], return_index=True)
                        sums[found] += np.add.reduceat(G, begin, axis=0)
                # the count goes along as one more number, so that one pass gives both
                yield pa.RecordBatch.from_arrays([pa.array(key), lists(np.column_stack([n, sums]))], names=["block", "v"])

    parts = rows.select("id", "x", "y").mapInArrow(run, "block bigint, v array<double>")
    sums = (
        parts.select("block", F.posexplode("v").alias("j", "v"))
        .groupBy("block", "j")
        .agg(F.sum("v").alias("v"))
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("a"))
    )
    g = F.transform(F.slice("a", 2, model.width), lambda e: e["v"])
    return sums.select("block", F.get("a", F.lit(0))["v"].cast("bigint").alias("n"), g.alias("g"))


def train_decayed_mean(
    df: DataFrame,
    model: Model,
    w0: np.ndarray,
    rate: float,
    top: float,
    decay: float,
    renew_share: float,
    use_renewed: bool = False,
    batch: int | None = None,
    steps: int = 1,
    keeping: Keeping | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Projection on a mean gradient that forgets: ``m <- decay*m + (1-decay)*g``.

    ``g`` is the mean gradient of the renewed rows, then of the top rows.
    """
    spark = df.sparkSession
    with held(df.select("id", "x", "y")) as rows:
        total = numbered_rows(rows)
        size, renewed = min(batch or total, total), int(total * renew_share)
        recorder, table = _records(spark, keeping), _table(spark, keeping)
        recorder.committed = table.drop
        before = recorder.restored()
        if before is not None:
            w, mean, begun = before.vectors["w"], before.vectors["mean"], before.iter
            at, start, points = (int(before.numbers[c]) for c in ("at", "start", "points"))
            table.at(before.tables["state"])
        else:
            w, begun, at, start, points = np.array(w0, float), 0, 0, 0, 0
            n, _, g = reduce_gradient(rows, model, w)
            mean = g / n
            table.replace([(0, total)], priorities(rows, model, w, PROJECTION, mean))
            recorder.records.append((0, 0.0, 0, w))

        def state() -> Snapshot:
            numbers = {"at": at, "start": start, "points": points}
            return Snapshot(step, numbers, {"w": w, "mean": mean}, {"state": table.version()})

        for step in range(begun + 1, begun + steps + 1):
            g = np.zeros(model.width)
            if renewed:
                part, ranges = batch_slice(rows, at, renewed, total), spans(at, renewed, total)
                fresh, g1 = fresh_priorities(part, model, w, mean)
                mean = decay * mean + (1 - decay) * g1 / renewed
                table.replace(ranges, renew(table.read(ranges), fresh, DECAYS["keep"], step, renewed))
                at = (at + renewed) % total
                g = g1 if use_renewed else g
            k = round(top * size)
            inside = spans(start, size, total)
            ids = cut(_top(table.read(inside), k))
            chosen = rows.join(small(ids.select("id"), k), "id", "left_semi")
            fresh, g2 = fresh_priorities(chosen, model, w, mean)
            _patched(table, inside, ids, fresh, DECAYS["keep"], step, k)
            mean = decay * mean + (1 - decay) * g2 / max(k, 1)
            w = w - rate * (g + g2) / max(k, 1)
            start, points = (start + size) % total, points + k
            record = (step, float(step), points, w)
            if recorder.note(step, points, lambda _: record, state, step == begun + steps):
                break
        return recorder.result(), _finished(table, keeping)


def train_exact(
    df: DataFrame,
    model: Model,
    w0: np.ndarray,
    rate: float,
    top: float,
    how: str = LENGTH,
    batch: int | None = None,
    steps: int = 1,
) -> DataFrame:
    """Exact priorities every step, gradient of the top rows of the batch."""
    spark = df.sparkSession
    with held(df.select("id", "x", "y")) as rows:
        total = numbered_rows(rows)
        size = min(batch or total, total)
        k = int(top * size)
        w, records, start = np.array(w0, float), [(0, 0.0, 0, np.array(w0, float))], 0
        for step in range(1, steps + 1):
            direction = None
            if how == PROJECTION:
                n, _, g = reduce_gradient(rows, model, w)
                direction = g / n
            part = batch_slice(rows, start, size, total)
            scored = priorities(part, model, w, how, direction)
            ids = top_k(scored, k, "p", "id")
            n, _, g = top_gradient(part, ids, k, model, w)
            w = w - rate * g / max(k, 1)
            start = (start + size) % total
            records.append((step, float(step), step * k, w))
    return history.rows(spark, records)


def top_pairs(graded: DataFrame, sums: np.ndarray, k: int) -> DataFrame:
    """The ``k`` (point, position) pairs with the largest ``|g_ij * sum_j|``."""
    weights = vec.vector(np.abs(sums))
    pairs = graded.select(
        "id", F.posexplode(F.arrays_zip("g", weights.alias("s"))).alias("j", "e")
    ).select(
        "id",
        "j",
        F.col("e.g").alias("g"),
        F.abs(F.col("e.g") * F.col("e.s")).alias("size"),
        (F.col("id") * F.lit(len(sums)) + F.col("j")).alias("pair"),
    )
    return top_k(pairs, k, "size", "pair").drop("pair")


def pair_sums(pairs: DataFrame) -> DataFrame:
    """Component sum and count per position over chosen pairs."""
    return pairs.groupBy("j").agg(F.sum("g").alias("g"), F.count("*").alias("n"))


def train_dimensions(
    df: DataFrame,
    model: Model,
    w0: np.ndarray,
    rate: float,
    top: float,
    batch: int | None = None,
    steps: int = 1,
    average: bool = True,
) -> DataFrame:
    """As :func:`train_exact`, but over (point, position) pairs."""
    spark = df.sparkSession
    with held(df.select("id", "x", "y")) as rows:
        total = numbered_rows(rows)
        size = min(batch or total, total)
        k = int(top * size * model.width)
        w, records, start = np.array(w0, float), [(0, 0.0, 0, np.array(w0, float))], 0
        for step in range(1, steps + 1):
            part = batch_slice(rows, start, size, total)
            _, _, g = reduce_gradient(rows, model, w)
            graded = gradients(part, model, w, keep=["id"]).select("id", "g")
            got = pair_sums(top_pairs(graded, g, k)).toPandas()
            delta = np.zeros(model.width)
            delta[got["j"].to_numpy()] = got["g"].to_numpy() / got["n"].to_numpy()
            w = w - rate * delta / (max(k, 1) if average else 1)
            start = (start + size) % total
            records.append((step, float(step), step * size, w))
    return history.rows(spark, records)
