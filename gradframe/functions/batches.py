"""Arrow list columns to arrays and back, without copying rows one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> np.ndarray:
    """``rows x width`` from equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=float)
    rows = len(column)
    if rows and len(values) % rows:
        raise ValueError("rows differ in length")
    return values.reshape(rows, -1)


def lists(values: np.ndarray) -> pa.ListArray:
    """Equally long lists from ``rows x width``."""
    values = np.ascontiguousarray(values, dtype=float)
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(
        rows + 1, dtype=np.int32
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()))


def sequences(column: pa.Array):
    """Groups of equally long sequences as ``(row numbers, rows x steps x unit)``."""
    steps = np.asarray(column.value_lengths())
    for length in np.unique(steps):
        rows = np.flatnonzero(steps == length)
        inner = column.take(pa.array(rows)).flatten()
        yield rows, matrix(inner).reshape(len(rows), length, -1)
