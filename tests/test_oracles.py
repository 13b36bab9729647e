"""Every engine query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from claimweave.plans import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(queries.ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in relation.fetchall())
    assert mine == theirs


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
