"""Fixed-width binary records as a Spark source, split by byte ranges.

``spark.read.format("fixedrecord").option("recordBytes", n)`` reads rows
``(file, row, record)``; ``row`` numbers the records across all files in the
order of their names, which follows from the file sizes alone. ``headerBytes``
skips a header in each file, ``splitBytes`` sets how much one task reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gradframe.functions.batches import matrix

BATCH_ROWS = 4096


class _Span(InputPartition):
    def __init__(self, file, first, count, row):
        self.file, self.first, self.count, self.row = file, first, count, row


class FixedRecordSource(DataSource):
    @classmethod
    def name(cls):
        return "fixedrecord"

    def schema(self):
        return "file string, row bigint, record binary"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.size = int(options["recordBytes"])
        self.head = int(options.get("headerBytes", 0))
        self.split = max(1, int(options.get("splitBytes", 128 << 20)) // self.size)

    def partitions(self):
        spans, before = [], 0
        for path in self.paths:
            where, name = fs.FileSystem.from_uri(path)
            info = where.get_file_info(name)
            files = [info]
            if info.type == fs.FileType.Directory:
                listed = where.get_file_info(fs.FileSelector(name, recursive=True))
                files = sorted((f for f in listed if f.is_file), key=lambda f: f.path)
            scheme = path[: path.index("://") + 3] if "://" in path else ""
            for file in files:
                if not file.is_file:
                    raise FileNotFoundError(path)
                records = (file.size - self.head) // self.size
                for first in range(0, records, self.split):
                    count = min(self.split, records - first)
                    spans.append(_Span(scheme + file.path, first, count, before + first))
                before += records
        return spans

    def read(self, span):
        where, name = fs.FileSystem.from_uri(span.file)
        with where.open_input_file(name) as f:
            f.seek(self.head + span.first * self.size)
            at, left = span.row, span.count
            while left:
                n = min(left, BATCH_ROWS)
                data = pa.py_buffer(f.read(n * self.size))
                offsets = pa.py_buffer(np.arange(0, (n + 1) * self.size, self.size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([span.file] * n, pa.string()),
                        pa.array(np.arange(at, at + n), pa.int64()),
                        pa.Array.from_buffers(pa.binary(), n, [None, offsets, data]),
                    ],
                    names=["file", "row", "record"],
                )
                at, left = at + n, left - n


def read_records(
    spark: SparkSession, path: str, record_bytes: int, header_bytes: int = 0, split_bytes: int = 128 << 20
) -> DataFrame:
    spark.dataSource.register(FixedRecordSource)
    return (
        spark.read.format("fixedrecord")
        .option("recordBytes", record_bytes)
        .option("headerBytes", header_bytes)
        .option("splitBytes", split_bytes)
        .load(path)
    )


def decode(df: DataFrame, fields: dict[str, tuple[str, int]]) -> DataFrame:
    """Unpack ``record`` by a packed layout ``{name: (numpy type, length)}``.

    Length 0 gives a scalar, any other length an ``ARRAY<DOUBLE>``.
    """
    layout = _layout(fields)
    kinds = {
        n: "array<double>" if k else ("double" if "f" in t else "bigint")
        for n, (t, k) in fields.items()
    }
    schema = "file string, row bigint, " + ", ".join(f"{n} {kinds[n]}" for n in fields)

    def unpack(batches):
        for batch in batches:
            rows = np.frombuffer(_values(batch.column("record")), layout)
            columns = [batch.column("file"), batch.column("row")]
            for name, (_, length) in fields.items():
                values = rows[name]
                if length:
                    flat = pa.array(np.ascontiguousarray(values, float).ravel())
                    at = pa.array(np.arange(0, (len(rows) + 1) * length, length, dtype=np.int32))
                    columns.append(pa.ListArray.from_arrays(at, flat))
                else:
                    kind = pa.float64() if kinds[name] == "double" else pa.int64()
                    columns.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(columns, names=["file", "row", *fields])

    return df.mapInArrow(unpack, schema)


def _values(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of all records one after the other, without an object for each."""
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.empty(0, np.uint8)


def blocks_to_rows(df: DataFrame, per_record: int) -> DataFrame:
    """Number consecutive records as ``(iter, id)`` blocks of ``per_record``."""
    return df.select(
        F.floor(F.col("row") / per_record).cast("int").alias("iter"),
        F.pmod("row", F.lit(per_record)).alias("id"),
        *[c for c in df.columns if c not in ("file", "row")],
    )


def write_records(
    df: DataFrame, path: str, fields: dict[str, tuple[str, int]], header: bytes = b""
) -> int:
    """Write packed records, one file per partition in partition order.

    Each task writes a draft and moves it to the file of its partition, so a
    task that is run again leaves one whole file. Returns the number of records.
    """
    layout = _layout(fields)
    where, name = fs.FileSystem.from_uri(path)
    where.create_dir(name, recursive=True)

    def write(batches):
        target, folder = fs.FileSystem.from_uri(path)
        task, count = TaskContext.get(), 0
        name = f"{folder}/part-{task.partitionId():06d}.bin"
        draft = f"{folder}.{task.taskAttemptId()}"
        with target.open_output_stream(draft) as out:
            out.write(header)
            for batch in batches:
                rows = np.empty(batch.num_rows, layout)
                for field, (_, length) in fields.items():
                    column = batch.column(field)
                    rows[field] = matrix(column) if length else np.asarray(column)
                out.write(rows.tobytes())
                count += batch.num_rows
        target.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    return df.select(*fields).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def _layout(fields: dict[str, tuple[str, int]]) -> np.dtype:
    return np.dtype([(n, t) if k == 0 else (n, t, (k,)) for n, (t, k) in fields.items()])
