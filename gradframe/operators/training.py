"""Training by iterated Spark jobs.

Each step is one pass over the batch: gradients are summed on the executors
and the driver applies one vector. The parameter lives on the driver, so the
plan of a step never grows with the number of steps, and a lost executor only
costs the tasks it held.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from gradframe.functions.models import Model
from gradframe.operators.gradients import is_narrow, loop_columns, reduce_gradient
from gradframe.operators.prep import batch_slice, numbered_rows
from gradframe.operators.progress import Keeping, Recorder, Stop
from gradframe.plans.lineage import held
from gradframe.sources import history
from gradframe.sources.snapshots import Snapshot

# fixed values: constants of the published update rules
MOMENTUM = 0.9
ADAM_BETA1, ADAM_BETA2, ADAM_EPSILON = 0.9, 0.999, 1e-8


def start_constant(width: int, value: float = 0.0) -> np.ndarray:
    return np.full(width, float(value))


def start_normal(width: int, mean: float = 0.01, std: float = 0.01, seed: int = 1) -> np.ndarray:
    """Normal start values; zeros are drawn again."""
    rng = np.random.default_rng(seed)
    w = rng.normal(mean, std, width)
    while not w.all():
        w[w == 0] = rng.normal(mean, std, int((w == 0).sum()))
    return w


@dataclass
class GradientDescent:
    rate: float

    def step(self, w, g):
        return w - self.rate * g

    def saved(self) -> Snapshot:
        """What the next step depends on besides the parameter and the rate."""
        return Snapshot(0)

    def load(self, state: Snapshot) -> None:
        """Go on from a saved state."""


@dataclass
class Momentum(GradientDescent):
    keep: float = MOMENTUM
    change: np.ndarray | None = field(default=None, repr=False)

    def step(self, w, g):
        before = 0.0 if self.change is None else self.keep * self.change
        self.change = before - self.rate * g
        return w + self.change

    def saved(self):
        return Snapshot(0, {}, {} if self.change is None else {"change": self.change})

    def load(self, state):
        self.change = state.vectors.get("change")


@dataclass
class Adam(GradientDescent):
    beta1: float = ADAM_BETA1
    beta2: float = ADAM_BETA2
    epsilon: float = ADAM_EPSILON
    t: int = 0
    m: np.ndarray | float = field(default=0.0, repr=False)
    v: np.ndarray | float = field(default=0.0, repr=False)

    def step(self, w, g):
        self.t += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        m = self.m / (1 - self.beta1**self.t)
        v = self.v / (1 - self.beta2**self.t)
        return w - self.rate * m / (np.sqrt(v) + self.epsilon)

    def saved(self):
        return Snapshot(0, {"t": self.t}, {"m": self.m, "v": self.v} if self.t else {})

    def load(self, state):
        self.t = int(state.numbers["t"])
        self.m, self.v = (state.vectors.get(c, 0.0) for c in "mv")


OPTIMIZERS: dict[str, Callable] = {"gd": GradientDescent, "momentum": Momentum, "adam": Adam}


def train(
    df: DataFrame,
    model: Model,
    w0: np.ndarray,
    rate: float,
    batch: int | None = None,
    steps: int = 1,
    optimizer: str = "gd",
    average: bool = True,
    stop: Stop | None = None,
    archive: str | None = None,
    every: int = 1,
    seconds: float | None = None,
    resume: bool = False,
    gap: int = 0,
) -> DataFrame:
    """Train on ``(id, x, y)`` and return the history ``(iter, time, n, w)``.

    ``batch`` rows are used per step, in id order and wrapping at the end; ids
    then run from 0. Without it every step reads all rows and no id is needed.
    Records are kept every ``every`` steps or ``seconds``; with ``archive``
    they are appended to that table with the optimizer's state instead of being held, and ``resume`` goes
    on from its last record as if the run had not ended, with the same ``batch``, ``optimizer`` and ``gap``.

    With ``gap`` gradients are stale: each is taken at the version that many steps old (the first one,
    while there are not as many) and applied to the newest.
    """
    spark = df.sparkSession
    recorder = Recorder(spark, Keeping(archive, every, seconds, resume, stop), lambda r: history.rows(spark, r))
    w, step, points = np.array(w0, float), 0, 0
    rule = OPTIMIZERS[optimizer](rate)
    recent = [w]  # the last versions, at most gap + 1, oldest first
    before = recorder.restored()
    if before is not None:
        _same(before, optimizer, batch, gap)
        w, step, points = before.vectors["w"], before.iter, int(before.numbers["points"])
        recent = [before.vectors[f"recent{k}"] for k in range(int(before.numbers["recent"]))]
        rule.load(before)
    else:
        recorder.records.append((0, 0.0, 0, w))

    def state() -> Snapshot:
        own = rule.saved()
        numbers = {**own.numbers, "points": points, "batch": batch or 0, "rule": list(OPTIMIZERS).index(optimizer)}
        lagged = {f"recent{k}": v for k, v in enumerate(recent)}
        return Snapshot(step, {**numbers, "gap": gap, "recent": len(recent)}, {**own.vectors, **lagged, "w": w})

    end = step + steps
    with held(loop_columns(df, model), not is_narrow(model)) as rows:
        total = numbered_rows(rows) if batch is not None else None
        while step < end:
            part = rows
            if batch is not None:
                part = batch_slice(rows, (step * batch) % total, batch, total)
            n, _, g = reduce_gradient(part, model, recent[0])
            w = rule.step(w, g / n if average and n else g)
            recent = [*recent, w][-gap - 1 :]
            step, points = step + 1, points + n
            if recorder.note(step, points, lambda clock: (step, clock, points, w), state, step == end):
                break
    return recorder.result()


def _same(before: Snapshot, optimizer: str, batch: int | None, gap: int) -> None:
    """Going on with another rule, other batches or another gap would not be the run that was saved."""
    found = list(OPTIMIZERS)[int(before.numbers["rule"])], int(before.numbers["batch"]) or None, int(before.numbers["gap"])
    if found != (optimizer, batch, gap):
        raise ValueError(f"the archive was written with optimizer, batch and gap {found}, not {(optimizer, batch, gap)}")


def train_logged(df: DataFrame, model: Model, w0: np.ndarray, rate: float, steps: int) -> DataFrame:
    """Full-batch training with cost and step size: ``(iter, cost, delta, w)``."""
    spark, w, log = df.sparkSession, np.array(w0, float), []
    with held(loop_columns(df, model), not is_narrow(model)) as rows:
        for step in range(steps):
            n, loss, g = reduce_gradient(rows, model, w)
            after = w - rate * g / n
            change = float(np.abs(after - w).sum())
            log.append((step, loss / n, change, [float(v) for v in after]))
            w = after
    return spark.createDataFrame(log, "iter int, cost double, delta double, w array<double>")
