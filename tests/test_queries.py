"""Every registered query of the library against its SQL on the smallest tables; the rest must give rows."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from metrika.plans import analysis, exchange, objects, registry, shapes  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(SMALL):
        c.sql(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.SQL:
        assert rows
        return
    rel = con.sql(registry.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(norm, r)) for r in rows) == Counter(tuple(norm(r[k]) for k in order) for r in rel.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["strain", "dose", "n", "mean", "sd"] and df.count() == 33


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
