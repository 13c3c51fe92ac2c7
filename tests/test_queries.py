"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from gradframe.catalog import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, name) == ""


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["iter", "time", "n", "loss"]
    assert df.count() == 20


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
