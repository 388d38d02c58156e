"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
import catalog
from tests.conftest import DATA, TABLES, table_of

QUERIES, SQL = catalog.QUERIES, catalog.SQL
# Model training; run by the checker and by hand, too slow for every test run.
SLOW = {"h05_h09_trained_paths", "b09_balance_groups", "v01_linear_cells", "v02_a17_cross_validation"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = table_of(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    want = table_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
