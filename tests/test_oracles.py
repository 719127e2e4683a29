"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows, "no rows"
    else:
        assert compare(df, rows, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
