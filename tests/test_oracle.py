"""Every query of the library's own operators equals its DuckDB oracle at sf0.01.

The optional training-data queries have their tests, with SQL or brute force, beside them."""

import pytest

import __spark_entry__ as entry
from conftest import SF01
from tools.oracle_check import compare, duckdb_con

QUERIES = entry._own_queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    res = compare(spark, name, QUERIES[name], ORACLE[name], SF01, con)
    assert res["ok"], res["problems"]
    assert res["rows"] > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["year_month", "total_order_qty"]
    assert df.count() > 0
