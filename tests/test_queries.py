"""The registered queries of the reference's operators against DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from driftledger.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)


def test_every_query_is_listed():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
