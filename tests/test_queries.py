"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from tracklake import catalog

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, bytes | bytearray):
        return repr(bytes(x))
    return repr([plain(y) for y in x]) if isinstance(x, list | tuple) else repr(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    expected = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in expected.fetchall())
