"""Every query that has SQL gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

from labelforge.plans import oracle, queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(oracle.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(cols, want.fetchall())


def test_every_query_has_sql():
    assert set(oracle.SQL) == set(queries.QUERIES)
