"""Records of a training loop: when they are kept, when a run ends, and how a later run goes on."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gradframe.sources import snapshots
from gradframe.sources.snapshots import Snapshot

FLUSH = 64  # records held before they are appended to the archive


@dataclass(frozen=True)
class Stop:
    """Limits that end a run once exceeded; None for no limit."""

    points: int | None = None
    deltas: int | None = None
    steps: int | None = None
    seconds: float | None = None

    def reached(self, points: int, deltas: int, steps: int, seconds: float) -> bool:
        pairs = (
            (points, self.points),
            (deltas, self.deltas),
            (steps, self.steps),
            (seconds, self.seconds),
        )
        return any(limit is not None and value > limit for value, limit in pairs)


@dataclass(frozen=True)
class Keeping:
    """Which records of a loop are kept, and where.

    Records are kept every ``every`` steps or ``seconds``, and the last one always. With ``archive`` they
    are appended to that table together with the loop's state, and ``resume`` goes on from it.
    """

    archive: str | None = None
    every: int = 1
    seconds: float | None = None
    resume: bool = False
    stop: Stop | None = None


class Recorder:
    """Held records of one run; ``frame`` turns them into rows, which have an ``iter``."""

    def __init__(self, spark: SparkSession, keeping: Keeping | None, frame: Callable[[list], DataFrame]):
        self.spark, self.keeping, self.frame = spark, keeping or Keeping(), frame
        self.records: list[tuple] = []
        self.before = 0.0
        self.began = time.monotonic()
        self.kept_at = 0.0
        self.committed: Callable[[], object] = lambda: None  # called once the archive has a newer state

    @property
    def archive(self) -> str | None:
        return self.keeping.archive

    @property
    def clock(self) -> float:
        """Seconds spent in this run and in those it goes on from."""
        return self.before + time.monotonic() - self.began

    def restored(self) -> Snapshot | None:
        """The state to go on from, if any."""
        if not (self.archive and self.keeping.resume):
            return None
        found = snapshots.last(self.spark, self.archive)
        if found is not None:
            self.before = self.kept_at = found.numbers.get("clock", 0.0)
        return found

    def note(
        self, step: int, points: int, record: Callable[[float], tuple], state: Callable[[], Snapshot], final: bool
    ) -> bool:
        """Keep the step's record if it is due; True where the run ends here."""
        k, clock = self.keeping, self.clock
        over = k.stop is not None and k.stop.reached(points, step, step, clock)
        due = clock - self.kept_at >= k.seconds if k.seconds is not None else step % k.every == 0
        if due or over or final:
            self.records.append(record(clock))
            self.kept_at = clock
            if k.archive and (over or final or len(self.records) >= FLUSH):
                found = state()
                found.numbers["clock"] = clock
                snapshots.save(self.spark, k.archive, found)
                self._append()
                self.committed()
        return over

    def _append(self) -> None:
        self.frame(self.records).write.mode("append").parquet(self.archive)
        self.records = []

    def result(self) -> DataFrame:
        """All records, those of earlier runs in the archive too."""
        if not self.archive:
            return self.frame(self.records)
        if self.records:
            self._append()
        return self.spark.read.schema(self.frame([]).schema).parquet(self.archive)
