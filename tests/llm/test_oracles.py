"""Queries of the training-data operators against their DuckDB forms."""

import duckdb
import pytest

from charloom.llm import oracles, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracle(spark, sf, name):
    base = f"{sf.rsplit('/', 1)[0]}/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    df = queries.queries()[name](spark, base)
    found = con.execute(oracles.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.MODULES] == list(range(1, 14))
