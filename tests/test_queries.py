"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from sluiceway.session import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no shared tables here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(float(v)) if isinstance(v, float) else repr(v)
    return sorted(columns), sorted(tuple(show(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    frame = entry.queries()[name](spark, SF_DIR)
    cursor = database.execute(entry.oracle_sql()[name])
    expected = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == expected


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["source", "reason", "documents"]
