"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]) or pd.api.types.is_object_dtype(df[c]) or str(df[c].dtype) == "Int64":
            try:
                df[c] = df[c].astype(float).round(6) + 0.0
            except (TypeError, ValueError):
                df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(spark, sf: str, name: str) -> str:
    """Empty when both agree, else what differs."""
    got = entry.queries()[name](spark, sf).toPandas()
    text = entry.oracle_sql().get(name)
    if text is None:
        return "" if len(got) else "no rows"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(text).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL gives {len(want)}"
    got, want = _normal(got), _normal(want)
    notes = []
    for c in got.columns:
        if got[c].dtype != want[c].dtype:
            notes.append(f"{c}: type {got[c].dtype} != {want[c].dtype}")
            continue
        if got[c].dtype == float:
            a, b = got[c].to_numpy(), want[c].to_numpy()
            bad = ~((a == b) | (np.isnan(a) & np.isnan(b)))
        else:
            bad = (got[c] != want[c]).to_numpy() & ~(got[c].isna() & want[c].isna()).to_numpy()
        if bad.any():
            i = int(np.flatnonzero(bad)[0])
            notes.append(f"{c}: {bad.sum()} of {len(got)} differ, e.g. {got[c][i]!r} != {want[c][i]!r}")
    return "; ".join(notes)


def main(sf: str, names: list[str]) -> None:
    from gradframe.session import session

    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or sorted(entry.queries()):
        began = time.monotonic()
        try:
            found = compare(spark, sf, name)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[-1500:]}"
        print(f"{'ok  ' if not found else 'FAIL'} {time.monotonic() - began:6.1f}s {name} {found}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
