"""Every query with an SQL twin returns the twin's rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(ORACLE[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(norm, r)) for r in got.fetchall())
    assert sorted(tuple(norm(r[df.columns.index(c)]) for c in columns) for r in df.collect()) == want
