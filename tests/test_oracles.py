"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows_and_the_same_again(spark, name):
    """Queries without SQL have rows, also when run again; their own tests hold them against brute force."""

    def rows(df):
        return sorted(tuple(str(plain(r[c])) for c in sorted(df.columns)) for r in df.collect())

    first = rows(QUERIES[name](spark, SF))
    assert first and first == rows(QUERIES[name](spark, SF))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
