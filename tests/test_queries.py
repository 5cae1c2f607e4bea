"""Every query with an SQL counterpart agrees with DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = {k: v for k, v in entry.oracle_sql().items()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_every_query_has_a_stable_schema(spark, small):
    for name, query in entry.queries().items():
        if not name.startswith("p") or not name[1:2].isdigit():
            assert query(spark, small).columns, name


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
