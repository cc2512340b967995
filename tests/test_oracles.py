"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from eventloom.plans.registry import ORACLES, QUERIES
from tests.compare import connect, differ

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    # A query without rows would prove nothing.
    assert not differ(spark, con, SF, QUERIES[name], ORACLES[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "peak" in df.columns
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
