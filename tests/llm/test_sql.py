"""Queries against their SQL on the smallest tables."""

import pytest

from gradframe.llm.queries import ORACLES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", name) == ""
