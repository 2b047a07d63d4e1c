"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from tools.compare import connect, duckdb_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    assert rows, "a registered query returns rows"
    if name in ORACLE:
        want_names, want = duckdb_rows(con, ORACLE[name])
        assert names == want_names
        assert rows == want


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
