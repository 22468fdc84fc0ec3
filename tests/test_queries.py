"""Every registered query: equal to its SQL on DuckDB, or at least a non-empty, stable result."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
ORACLE = entry_point.oracle_sql()
MAY_BE_EMPTY = {"adwin", "adwin_chunked", "stream_adwin"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert df.collect() or name in MAY_BE_EMPTY
