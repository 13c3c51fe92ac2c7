"""Exact selection and checks that hold at every size."""

import math

import pytest
from pyspark.sql import functions as F

from gradframe.functions import vec
from gradframe.functions.models import LR
from gradframe.operators import datagen, prep, training
from gradframe.operators.scoring import score
from gradframe.plans.topk import top_k

CASES = {
    "nan": [float("nan"), 1.0, 2.0] * 20,
    "infinities": [math.inf, -math.inf, 3.0, None] * 20,
    "far apart": [1.7e308, -1.7e308, 0.0, 5e-324, -0.5] * 12,
    "equal": [4.0] * 60,
    "close": [1.0 + k * 2.3e-16 for k in range(60)],
    "nulls": [None] * 40 + [1.0] * 20,
}


@pytest.mark.parametrize("values", CASES.values(), ids=CASES)
@pytest.mark.parametrize("k", [0, 7, 33, 59, 60, 80])
def test_heap_and_bins_agree(spark, values, k):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, p double")
    want = sorted(r.id for r in top_k(df, k, "p", "id").collect())
    got = sorted(r.id for r in top_k(df, k, "p", "id", heap_rows=-1 if k == 0 else 0).collect())
    assert got == want


def test_rows_of_other_length_are_errors(spark):
    for width in (2, 20):
        rows = spark.createDataFrame(
            [(0, [1.0] * width, [1.0]), (1, [1.0] * (width - 1), [0.0])], "id bigint, x array<double>, y array<double>"
        )
        with pytest.raises(Exception, match="differ in length|shape|size"):
            score(rows.coalesce(1), LR(width), [0.1] * (width + 1)).collect()


def test_batches_need_numbered_rows(spark):
    rows = spark.createDataFrame([(i + 100, [1.0], [1.0]) for i in range(12)], "id bigint, x array<double>, y array<double>")
    with pytest.raises(ValueError, match="ids run from 100"):
        training.train(rows, LR(1), training.start_normal(2), rate=0.1, steps=3, batch=4)
    assert prep.numbered_rows(rows.withColumn("id", F.col("id") - 100)) == 12


def test_uniform_does_not_repeat(spark):
    ids = spark.createDataFrame([(5 + k * datagen.M1,) for k in range(50)], "id bigint")
    drawn = [r.u for r in ids.select(datagen.uniform("id", 0, 1).alias("u")).collect()]
    assert len(set(drawn)) == 50 and all(0 < u < 1 for u in drawn)


def test_softplus_of_large_values(spark):
    got = spark.range(1).select(vec.softplus(F.lit(1000.0)).alias("a"), vec.softplus(F.lit(-1000.0)).alias("b")).first()
    assert (got.a, got.b) == (1000.0, 0.0)


def test_a_long_selection_computes_its_values_once(spark):
    """Rounds that compute the values anew take as many times their work."""
    done = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            done.add(batch.num_rows)
            yield batch

    rows = spark.range(2000).selectExpr("id", "cast(id * 7 % 1999 as double) as p").mapInArrow(run, "id bigint, p double")
    got = top_k(rows, 900, "p", "id", heap_rows=10).collect()
    assert done.value == 2000
    want = sorted(((i * 7 % 1999, i) for i in range(2000)), key=lambda r: (-r[0], r[1]))[:900]
    assert sorted(r["id"] for r in got) == sorted(i for _, i in want)
