"""A table of one row per id, ids 0 to N-1, of which a change rewrites only what it touches.

The table is a list of segments: id ranges with the Parquet folder that holds the newest rows of
the range. Replacing a range writes its rows into a new folder and notes it; the folders of other
ranges stay as they are, and reading some ranges reads only their folders, with id filters
that reach the scan. Scattered rows go to a patch, one table that wins over the segments.

Folders are never changed once written, so the list of segments is a version of the table: a
snapshot of the list is a snapshot of the rows. Runs of small neighbouring segments are merged, smallest first, so
the number of segments is bounded and a row is rewritten about as often as the logarithm
of the number of changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradframe.plans.lineage import remove
from gradframe.plans.sizes import small

LIMIT = 32  # segments, beyond which neighbours are merged
MERGED = 8  # neighbours that are merged at a time
FILE_BITS = 20  # ids of one file, as a power of two

Span = tuple[int, int]


def spans(start: int, count: int, total: int) -> list[Span]:
    """The id ranges of ``count`` rows from ``start`` on, wrapping at the end."""
    if count >= total:
        return [(0, total)]
    start %= total
    end = start + count
    return [(start, end)] if end <= total else [(0, end - total), (start, total)]


def _inside(ranges: Sequence[Span]):
    i = F.col("id")
    return reduce(lambda a, b: a | b, [(i >= lo) & (i < hi) for lo, hi in ranges], F.lit(False))


class Segments:
    """``id`` and other columns, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | None = None):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.live: list[tuple[int, int, str]] = []
        self.patched: str | None = None
        self.patched_rows = 0
        self.stale: list[Span] = []  # ranges replaced after the patch was written
        self.written = 0  # rows written so far

    def _write(self, df: DataFrame, rows: int) -> str:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        blocks = max(1, -(-rows >> FILE_BITS))
        placed = df.repartition(blocks, F.shiftright("id", FILE_BITS)).sortWithinPartitions("id")
        placed.write.parquet(path)
        self.schema = self.schema or placed.schema
        self.written += rows
        return path

    def _load(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def replace(self, ranges: Sequence[Span], df: DataFrame) -> None:
        """``df`` holds the new rows of the ranges, and no others."""
        ranges = [(lo, hi) for lo, hi in ranges if lo < hi]
        if not ranges:
            return
        path = self._write(df, sum(hi - lo for lo, hi in ranges))
        self._place(ranges, path)
        if self.patched:
            self.stale += ranges
        while len(self.live) > LIMIT:
            self._merge()

    def _place(self, ranges: Sequence[Span], path: str) -> None:
        for lo, hi in ranges:
            rest = [(a, min(b, lo), p) for a, b, p in self.live if a < lo]
            rest += [(max(a, hi), b, p) for a, b, p in self.live if b > hi]
            self.live = sorted([*rest, (lo, hi, path)])

    def _merge(self) -> None:
        """Write the ``MERGED`` neighbours that hold the fewest rows as one segment."""
        first = range(len(self.live) - MERGED + 1)
        at = min(first, key=lambda i: sum(hi - lo for lo, hi, _ in self.live[i : i + MERGED]))
        run = self.live[at : at + MERGED]
        lo, hi = run[0][0], run[-1][1]
        path = self._write(self._segments([(lo, hi)]), hi - lo)
        self._place([(lo, hi)], path)

    def _segments(self, ranges: Sequence[Span] | None) -> DataFrame:
        by_path: dict[str, list[Span]] = {}
        for a, b, path in self.live:
            for lo, hi in ranges if ranges is not None else [(a, b)]:
                if max(a, lo) < min(b, hi):
                    by_path.setdefault(path, []).append((max(a, lo), min(b, hi)))
        parts = [self._load(path).where(_inside(held)) for path, held in by_path.items()]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, parts)

    def _patch(self, ranges: Sequence[Span] | None) -> DataFrame:
        rows = self._load(self.patched).where(~_inside(self.stale))
        return rows if ranges is None else rows.where(_inside(ranges))

    def read(self, ranges: Sequence[Span] | None = None) -> DataFrame:
        """The rows of the ranges, or all."""
        rows = self._segments(ranges)
        if not self.patched:
            return rows
        patch = self._patch(ranges)
        return rows.join(small(patch.select("id"), self.patched_rows), "id", "left_anti").unionByName(patch)

    def patch(self, df: DataFrame, rows: int) -> None:
        """Up to ``rows`` scattered rows take the place of those with their ids."""
        if self.patched:
            old = self._patch(None).join(small(df.select("id"), rows), "id", "left_anti")
            df, rows = df.unionByName(old), rows + self.patched_rows
        self.patched, self.stale = self._write(df, rows), []
        self.patched_rows = self._load(self.patched).count()

    def paths(self) -> set[str]:
        return {p for _, _, p in self.live} | ({self.patched} if self.patched else set())

    def version(self) -> dict:
        """What names the present rows; see :meth:`at`."""
        return {
            "live": list(self.live), "patched": self.patched, "patched_rows": self.patched_rows, "stale": list(self.stale)
        }

    def at(self, version: dict) -> Segments:
        """Go back to a version whose folders are still there."""
        self.live = [tuple(s) for s in version["live"]]
        self.patched, self.patched_rows = version["patched"], version["patched_rows"]
        self.stale = [tuple(s) for s in version["stale"]]
        if self.schema is None:
            self.schema = self.spark.read.parquet(self.live[0][2]).schema
        return self

    def drop(self, keep: set[str] = frozenset()) -> None:
        """Remove all folders but those of the present version and of ``keep``."""
        remove(self.spark, self.folder, self.paths() | set(keep))

    def clear(self) -> None:
        """Remove the table."""
        self.live, self.patched = [], None
        remove(self.spark, self.folder)
