"""Every registered query against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

if not os.path.isdir(FOLDER):
    pytest.skip("no tables", allow_module_level=True)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    wanted = tables.execute(entry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == columns
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in wanted.fetchall())
    assert ours == theirs
