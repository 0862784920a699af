"""Ordered near deduplication and reranking by several queries against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from charloom.operators import chunking, profile


def cosine(u, v):
    if not u or not v or len(u) != len(v):
        return 0.0
    n = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
    return sum(x * y for x, y in zip(u, v)) / n if n else 0.0


def plain_dedup(rows, threshold):
    kept = []
    for doc, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if not any(d == doc and cosine(v, w) >= threshold for d, _, w in kept):
            kept.append((doc, i, v))
    return sorted((str(d), i) for d, i, _ in kept)


def test_dedup_near(spark, monkeypatch):
    monkeypatch.setattr(chunking, "FOLD", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5))
    rows = []
    for doc in ["a", "b", None, "c"]:
        for i in range(60):
            v = [float(x) for x in centres[rng.integers(6)] + 0.3 * rng.normal(size=5)]
            rows.append((doc, i, [v, v, v, v[:3], [0.0] * 5, None, []][rng.integers(7)]))
    df = spark.createDataFrame([(d, i, v, "x") for d, i, v in rows], "doc string, chunk_index int, embedding array<double>, text string").repartition(5)
    for threshold in (0.8, 0.95):
        got = chunking.dedup_near(df, ["doc"], threshold=threshold)
        assert got.columns == df.columns
        assert sorted((str(r.doc), r.chunk_index) for r in got.collect()) == plain_dedup(rows, threshold)


def test_dedup_near_long_document():
    """A document of 20,000 chunks, none alike: only the kept vectors are held."""
    rng = np.random.default_rng(1)
    kept, n = chunking._Kept(0.95), 0
    for _ in range(0, 20_000, chunking.FOLD):
        n += kept.take(list(rng.normal(size=(chunking.FOLD, 16)))).sum()
    assert kept.n == n > 19_000 and kept.rows.nbytes < 10_000_000


def test_embedder_fails_in_a_task(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b")], "doc int, chunk_index int, text string")

    @F.udf("array<double>")
    def fails(text):
        raise ValueError("no model")

    assert chunking.dedup(rows, ["doc"], lambda c: c.withColumn("embedding", fails("text"))).count() == 2
    # trouble that isn't the embedder's is raised
    with pytest.raises(Exception, match="(?i)divide"):
        chunking.dedup(rows, ["doc"], lambda c: c.withColumn("embedding", F.array(F.lit(1.0) / (F.col("chunk_index") * 0.0)))).count()


def plain_rerank(entries, queries, top_n, score):
    per, taken = max(1, top_n // len(queries)), []
    for q in queries:
        left = sorted((e for e in entries if e not in taken), key=lambda e: -score(q, e[1]))
        taken += [e for e in left[:per]][: top_n - len(taken)]
    taken += [e for e in entries if e not in taken][: top_n - len(taken)]
    return taken[:top_n]


@pytest.mark.parametrize("top_n", [1, 2, 3, 4, 7, 12, 100])
def test_rerank_queries(spark, top_n):
    rnd = random.Random(top_n)
    rows = [(n, f"{n}{i:02d}", "".join(rnd.choices("abcd", k=6)), i // 3, i) for n in ("A", "B", "C") for i in range({"A": 25, "B": 2, "C": 9}[n])]
    df = spark.createDataFrame(rows, "character_name string, uuid string, text string, chunk_index int, char_start int").repartition(4)
    score = lambda q, t: sum(c in q for c in t)
    queries = ["a", "bc", "d"]
    rate = F.udf(lambda q, t: float(score(q, t)), "double")
    got = profile.rerank_queries(df, F.array(*map(F.lit, queries)), 3, top_n, lambda r: r.withColumn("score", rate("query", "text")))
    for n in "ABC":
        own = [(u, t) for m, u, t, _, _ in rows if m == n]
        assert [r.uuid for r in got.where(F.col("character_name") == n).orderBy("place").collect()] == [u for u, _ in plain_rerank(own, queries, top_n, score)]


def test_rerank_without_scores(spark):
    df = spark.createDataFrame([("A", f"{i}", "t", 0, i) for i in range(9)], "character_name string, uuid string, text string, chunk_index int, char_start int")
    first = [str(i) for i in range(4)]

    @F.udf("double")
    def fails(query, text):
        raise ValueError("no model")

    for score in (None, lambda r: r.withColumn("score", fails("query", "text"))):
        assert [r.uuid for r in profile.rerank_views(df, 4, score).orderBy("place").collect()] == first
    asked = [r.q for r in df.limit(1).select(F.explode(profile.views(F.col("character_name"))).alias("q")).collect()]
    assert asked == ["A", *profile.VIEWS]
