"""Embedders and rerankers: local models where their library is there, else hash vectors and no reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from charloom.functions.similarity import hash_embedding


def hash_embedder(dim: int = 256) -> Callable[[DataFrame], DataFrame]:
    """Adds `embedding`; equal texts have equal vectors, other texts tell nothing, so it is no ground for near duplicates."""
    return lambda rows: rows.withColumn("embedding", hash_embedding(F.col("text"), dim))


def build_embedder(model: str = "BAAI/bge-m3") -> Callable[[DataFrame], DataFrame] | None:
    """Adds `embedding` by a local sentence model, loaded once a task; None where its library is missing."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        return None

    @F.pandas_udf(ArrayType(DoubleType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model)
        for part in parts:
            yield pd.Series([[float(x) for x in v] for v in loaded.encode(part.tolist(), normalize_embeddings=True)])

    return lambda rows: rows.withColumn("embedding", encode(F.col("text")))


def build_reranker(model: str = "BAAI/bge-reranker-base") -> Callable[[list[dict], str], list[dict]] | None:
    """Orders entries by a cross-encoder's score for a query; None where its library is missing."""
    try:
        from sentence_transformers import CrossEncoder
    except ImportError:
        return None
    loaded = CrossEncoder(model)

    def rerank(entries: list[dict], query: str) -> list[dict]:
        scores = loaded.predict([(query, e["text"]) for e in entries])
        return [e for _, e in sorted(zip(scores, entries), key=lambda x: -x[0])]

    return rerank


def build_scorer(model: str = "BAAI/bge-reranker-base") -> Callable[[DataFrame], DataFrame] | None:
    """Adds `score` of `text` for `query` by a local cross-encoder, loaded once a task; None where its library is missing."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        return None

    @F.pandas_udf(DoubleType())
    def rate(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from sentence_transformers import CrossEncoder

        loaded = CrossEncoder(model)
        for query, text in parts:
            yield pd.Series([float(x) for x in loaded.predict(list(zip(query, text)))])

    return lambda rows: rows.withColumn("score", rate("query", "text"))
