"""Every row against every record of another table, in blocks.

Records are packed where they lie into blocks of some megabytes (one binary value each). Every block of rows
meets every block of records in a task, which holds one pair at a time. Records up to a checked size are broadcast, and
rows are read where they lie, in the batches that Spark hands on; with larger tables rows are packed too, and both are
dealt to stripes: a stripe gets its share of the row blocks and all record blocks. Neither the plan
nor the driver's memory depends on the number of records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradframe.plans.lineage import cut
from gradframe.plans.sizes import BROADCAST_BYTES

BLOCK_BYTES = 4 << 20
PACKED = "n bigint, size bigint, data binary"


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of ``BLOCK_BYTES`` or a single row."""
    rows = max(1, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _sliced(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_batch(part)
            data = sink.getvalue().to_pybytes()
            columns = [pa.array([part.num_rows]), pa.array([len(data)]), pa.array([data])]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "size", "data"])


def _unpacked(value: pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(value) as stream:
        return stream.read_next_batch()


def packed(df: DataFrame) -> DataFrame:
    """Blocks of rows, ``n, size, data``; no rows move."""
    return df.mapInArrow(_pack, PACKED)


def meet(rows: DataFrame, records: DataFrame, visit: Callable, schema) -> DataFrame:
    """Run ``visit(pairs)`` in every task over its pairs of a batch of ``rows`` and one of ``records``.

    ``visit`` gets an iterator and gives Arrow batches of ``schema``. Each row meets each record in just one pair.
    """
    right = cut(packed(records).select(F.col("data").alias("records"), F.col("size").alias("record_bytes")))
    size = right.agg(F.sum("record_bytes")).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = rows.sparkSession.sparkContext.broadcast([bytes(r["records"]) for r in right.collect()])

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from visit(
                (part, _unpacked(pa.py_buffer(block))) for batch in batches for part in _sliced(batch) for block in known.value
            )

        return rows.mapInArrow(beside, schema)
    left = packed(rows).select("data", F.monotonically_increasing_id().alias("number"))
    stripes = 4 * rows.sparkSession.sparkContext.defaultParallelism
    left = left.withColumn("stripe", F.pmod(F.xxhash64("number"), F.lit(stripes)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stripes - 1).cast("bigint")))
    right = right.select("records", every.alias("stripe"))
    pairs = left.join(right, "stripe").select("data", "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from visit((_unpacked(a.as_buffer()), _unpacked(b.as_buffer())) for batch in batches for a, b in zip(*batch.columns))

    return pairs.mapInArrow(run, schema)
