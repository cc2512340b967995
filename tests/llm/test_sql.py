"""The corpus queries that have SQL, held against it."""

from __future__ import annotations

import os

import pytest

from ..compare import connect, differ

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_queries_equal_their_sql(spark):
    from eventloom.llm import queries

    con = connect(SF)
    assert len(queries.ORACLES) == 9
    for name, sql in queries.ORACLES.items():
        assert not differ(spark, con, SF, queries.QUERIES[name], sql), name
