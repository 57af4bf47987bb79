"""Every registered query against its DuckDB statement on the small test tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got_cols, got = rows_of(df.columns, df.collect())
    res = con.execute(SQL[name])
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    assert got_cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.collect() is not None


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and abs(sum(r.pct for r in rows) - 100) < 0.01
