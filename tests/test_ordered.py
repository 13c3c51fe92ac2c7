"""Range-split scans against plain pandas, with one key holding half the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from gradframe.operators import updates
from gradframe.plans import ordered
from gradframe.plans.topk import top_k


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 3000
    key = np.where(rng.uniform(size=n) < 0.5, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n), "v": rng.normal(size=n)})
    pdf = pdf.astype({"k": "int64", "t": "int64"})
    return spark.createDataFrame(pdf).repartition(5), pdf.sort_values(["k", "t"], ignore_index=True)


@pytest.fixture(autouse=True)
def short_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_BITS", 5)


def back(df, *columns):
    return df.toPandas().sort_values(["k", "t"], ignore_index=True)[list(columns)]


def test_ranges_are_short_and_ordered(rows):
    parts = ordered.split(rows[0], ["k"], ["t"]).toPandas()
    assert parts.groupby("_range").size().max() <= 32
    ends = parts.sort_values(["k", "t"])["_range"].to_numpy()
    assert (np.diff(ends) >= 0).all()


def test_running(rows):
    df, pdf = rows
    got = back(ordered.running(df, ["k"], ["t"], {"s": F.col("v")}), "s")
    assert np.allclose(got["s"], pdf.groupby("k")["v"].cumsum())
    total = ordered.running(df, [], ["t"], {"s": F.col("v")}).toPandas().sort_values("t")
    assert np.allclose(total["s"], pdf.sort_values("t")["v"].cumsum())


def test_ranked_descending(rows):
    df, pdf = rows
    got = back(ordered.ranked(df, ["k"], [F.col("v").desc(), F.col("t")]), "rank")
    assert (got["rank"] == pdf.groupby("k")["v"].rank(ascending=False, method="first")).all()


@pytest.mark.parametrize("offset", [1, 3])
def test_lagged(rows, offset):
    df, pdf = rows
    got = back(ordered.lagged(df, ["k"], ["t"], F.col("v"), "b", offset), "b")["b"]
    want = pdf.groupby("k")["v"].shift(offset)
    assert np.allclose(got, want, equal_nan=True)


def test_previous_keeps_the_nearest_rows(rows):
    df, pdf = rows
    got = back(ordered.previous(df, ["k"], ["t"], F.col("t"), "w", 4), "k", "t", "w")
    for k, part in got.groupby("k"):
        times = part["t"].tolist()
        for i, w in enumerate(part["w"]):
            assert list(w) == times[max(0, i - 4) : i]


def test_fold(rows):
    df, pdf = rows
    folds = {
        "ema": (F.col("v"), 0.2, F.col("v") * 0.8, None),
        "capped": (0.5, 1.0, F.abs("v"), F.lit(1.0) + F.col("v") * F.col("v")),
    }
    got = back(ordered.fold_affine(df, ["k"], ["t"], folds), "ema", "capped")
    ema, capped = [], []
    for _, part in pdf.groupby("k"):
        e, c = part["v"].iloc[0], 0.5
        for v in part["v"]:
            e, c = 0.2 * e + 0.8 * v, min(c + abs(v), 1 + v * v)
            ema.append(e)
            capped.append(c)
    assert np.allclose(got["ema"], ema) and np.allclose(got["capped"], capped)


@pytest.mark.parametrize("k", [1, 40, 700, 2999, 5000])
def test_top_k_by_selection(spark, k):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": rng.permutation(3000).astype("int64")})
    pdf["p"] = np.where(pdf["id"] % 3 == 0, 0.25, np.round(rng.exponential(size=3000), 2))
    df = spark.createDataFrame(pdf)
    got = set(top_k(df, k, "p", "id", heap_rows=20).toPandas()["id"])
    want = pdf.sort_values(["p", "id"], ascending=[False, True]).head(k)["id"]
    assert got == set(want) and len(got) == min(k, 3000)


def test_balance_estimator_hands_only_plain_numbers_to_python(spark, monkeypatch):
    """A window of structs in a range's frame takes a hundred times the room of its numbers."""
    seen = []
    fold = updates.fold_affine
    monkeypatch.setattr(updates, "fold_affine", lambda df, *a: seen.append(df.schema) or fold(df, *a))
    rows = spark.range(40).selectExpr("id % 2 as k", "id as t", "id / 9D as improve", "0.5D + id % 7 as interval", "0.1D as sync")
    got = back(updates.rate_by_balance(rows, ["k"], ["t"], 2), "next_interval")
    assert len(seen) == 2 and not any(isinstance(f.dataType, ArrayType) for s in seen for f in s)
    want = []
    for k in range(2):
        y, s, past = 0.01, 0.01, [(0.0, 0.01)] * 2
        for t in range(k, 40, 2):
            g, i = t / 9, 0.5 + t % 7
            spent = past[-1][1] + past[-2][1]
            up = g / (i + 0.1) > (past[-1][0] + past[-2][0]) / (spent + 2 * y)
            s = s + spent / 2 if up else min(spent / 2, s)
            y = (y + 0.1) / 2
            past.append((g, i))
            want.append(s)
    assert np.allclose(got["next_interval"], want)


def test_a_range_fits_a_python_worker():
    assert ordered.RANGE_ROWS <= 1 << 17
