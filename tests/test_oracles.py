"""Every registered query with SQL against DuckDB on the smallest tables, with a numeric tolerance."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def sort_key(row):
    return tuple((v is None, "" if isinstance(v, float) else str(v)) for v in row), tuple(
        v for v in row if isinstance(v, float)
    )


def assert_same(actual, expected):
    assert sorted(actual.column_names) == sorted(expected.column_names)
    names = sorted(actual.column_names)
    ours = sorted((tuple(r[n] for n in names) for r in actual.to_pylist()), key=sort_key)
    theirs = sorted((tuple(r[n] for n in names) for r in expected.to_pylist()), key=sort_key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5), (a, b)
            else:
                assert x == y, (a, b)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    actual = entry_module.queries()[name](spark, SF).toArrow()
    expected = con.execute(entry_module.oracle_sql()[name]).to_arrow_table()
    assert_same(actual, expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
