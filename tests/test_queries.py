"""Each query against its DuckDB form on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from charloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(same(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    got = table(df.columns, df.collect())
    assert got
    if name in registry.ORACLES:
        found = con.execute(registry.ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == table(columns, found.fetchall())


def test_entry(spark):
    assert os.path.isdir("/root/testdata/sf0.001")
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
