"""State of a training loop beside its archive, so that a later run goes on exactly.

An archive is a table of records with an ``iter``. Its state lies below ``_state``, which readers
of the table do not see: a table with one row per saved state, and the folders of
:class:`~gradframe.plans.segments.Segments`. The state is written first and the records are appended after it;
that append is what commits both. A state whose records are missing was left by a
run that was cut short, and is not looked at.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gradframe.plans.lineage import exists

SCHEMA = "iter int, stamp bigint, numbers map<string, double>, vectors map<string, array<double>>, tables map<string, string>"


@dataclass
class Snapshot:
    """Numbers, vectors, and versions of segment tables by name."""

    iter: int
    numbers: dict[str, float] = field(default_factory=dict)
    vectors: dict[str, np.ndarray] = field(default_factory=dict)
    tables: dict[str, dict] = field(default_factory=dict)


def folder(archive: str) -> str:
    return f"{archive.rstrip('/')}/_state"


def save(spark: SparkSession, archive: str, state: Snapshot) -> None:
    row = (
        state.iter, time.time_ns(), {k: float(v) for k, v in state.numbers.items()},
        {k: [float(x) for x in v] for k, v in state.vectors.items()},
        {k: json.dumps(v) for k, v in state.tables.items()},
    )
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder(archive)}/saved")


def last(spark: SparkSession, archive: str) -> Snapshot | None:
    """The state of the archive's last record; None where there is no record."""
    if not exists(spark, archive):
        return None
    newest = spark.read.schema("iter int").parquet(archive).agg(F.max("iter")).first()[0]
    if newest is None:
        return None
    path = f"{folder(archive)}/saved"
    rows = spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)
    found = rows.where(F.col("iter") == newest).agg(F.max_by(F.struct(*rows.columns), "stamp").alias("r")).first()["r"]
    if found is None:
        raise ValueError(f"the archive {archive} holds no state for its last record, {newest}")
    return Snapshot(
        newest, dict(found["numbers"]), {k: np.array(v, float) for k, v in found["vectors"].items()},
        {k: json.loads(v) for k, v in found["tables"].items()},
    )
