"""Every registered query runs; those with SQL return the rows that DuckDB returns."""

import os

import duckdb
import pytest

from cellmesh.plans import catalog

from .conftest import SF

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    expected = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert normal(rows, df.columns) == normal(expected.fetchall(), expected.columns)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
