"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from quotelens.queries import all_oracles, all_queries
from quotelens.queries.registry import TABLE_NAMES

SF_DIR = "/root/testdata/sf0.001"
# The corpus operators are tested in tests/llm.
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_driver_sees_every_query():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    theirs = expected.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall()
    ours = [tuple(r) for r in df.collect()]
    assert ours, "an empty result proves nothing"
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_entry_is_the_mart(spark):
    assert len(entry_point.entry(spark).columns) == 85
