"""The driver contract: every query of this library runs, and its SQL gives the same rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tallyring import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, sf, db, name):
    df = contract.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in own.oracle_sql():
        answer = db.execute(own.oracle_sql()[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() >= 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
