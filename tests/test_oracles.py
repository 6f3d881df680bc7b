"""Every query with SQL against DuckDB on the small tables."""

import datetime
import decimal

import duckdb
import pytest

from quiltframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple(round(float(x), 6) if isinstance(x, (float, decimal.Decimal)) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=str)
    want = sorted((plain(r) for r in con.execute(f"select {','.join(chr(34) + c + chr(34) for c in columns)} from ({queries.ORACLES[name]})").fetchall()), key=str)
    assert got == want
    assert not any(isinstance(x, datetime.date) for r in got for x in r)
