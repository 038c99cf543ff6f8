"""Every query with an oracle gives the oracle's rows; the others give rows of a stable shape."""

import os

import pytest

from lattiq.plans.registry import ORACLE_SQL, QUERIES
from tests.parity import difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
