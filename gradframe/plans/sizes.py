"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its row count is known and within bounds.

    ``rows`` is the count where the caller knows it; otherwise the rows are counted, by
    partial counts in the tasks. Larger tables are left to a shuffled join.
    """
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= limit else df
