"""Paragraphs, chunk packing and deduplication of chunks.

`docs` is any DataFrame with the key columns given and a `text`; chunk rows carry the keys along. The packing of a document is a
fold over its paragraphs in order, done row by row in Arrow batches; identities and counts stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from charloom.functions import ids
from charloom.functions.shared import save

SPLIT = r"\n\s*\n"


def paragraphs(text: Column, pattern: str = "(?U)" + SPLIT) -> Column:
    """Non-empty paragraphs as (body, char_start, char_end), found one after the other in the text."""
    bodies = F.filter(F.split(text, pattern), lambda p: p != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<body:string,char_start:int,char_end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = F.call_function("locate", p, text, acc["at"] + 1) - 1
        e = s + F.length(p)
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(p.alias("body"), s.alias("char_start"), e.alias("char_end")))).alias("out"))

    return F.aggregate(bodies, start, step)["out"]


def _spans(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for m in pattern.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


#: Fixed value: how the usual encodings cut a text into pieces before their merges.
PIECES = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""


class TokenCount:
    """Counts a text's tokens by a public rank file; loaded once in each process that counts. Special tokens are plain text."""

    def __init__(self, path: str, pattern: str = PIECES):
        self.path, self.pattern, self._encoding = path, pattern, None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}

    def __call__(self, text: str) -> int:
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._encoding.encode_ordinary(text))


def pack(text: str, target: int, overlap: int, max_chunks: int = 0, pattern: re.Pattern = re.compile(SPLIT), count: Callable[[str], int] = len) -> list[dict]:
    """Greedy packing. A chunk is closed before a paragraph that would push it over the target, unless that paragraph alone is
    over it, or after a lone paragraph that reaches it. The next chunk begins with the last paragraphs within the overlap, with
    the very last one at any rate, so the final chunk repeats a tail that is already out."""
    if not text.strip():
        return []
    out: list[dict] = []
    held: list[tuple[int, int, int]] = []  # (start, end, tokens)

    def close() -> None:
        nonlocal held
        if held:
            out.append({"text": "\n\n".join(text[a:b] for a, b, _ in held), "chunk_index": len(out), "char_start": held[0][0], "char_end": held[-1][1], "token_count": sum(t for _, _, t in held)})
            k, kept = len(held) - 1, held[-1][2]
            while k > 0 and kept + held[k - 1][2] <= overlap:
                k -= 1
                kept += held[k][2]
            held = held[k:]

    for a, b in _spans(text, pattern):
        t = count(text[a:b])
        total = sum(x for _, _, x in held)
        if held and total + t > target >= t:
            close()
            if max_chunks and len(out) >= max_chunks:
                return out
            total = sum(x for _, _, x in held)
        held.append((a, b, t))
        if len(held) == 1 and t >= target:
            close()
            if max_chunks and len(out) >= max_chunks:
                return out
    close()
    return out[:max_chunks] if max_chunks else out


CHUNK = StructType([StructField("text", StringType()), StructField("chunk_index", IntegerType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("token_count", IntegerType())])


def chunk(docs: DataFrame, target: int = 1800, overlap: int = 200, max_chunks: int = 0, pattern: str = SPLIT, count: Callable[[str], int] = len) -> DataFrame:
    """A row per chunk: the documents' other columns, the chunk, its uuid, and the number of chunks of its document."""
    keys = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in keys] + [StructField("chunks", ArrayType(CHUNK))])
    fields, at = to_arrow_schema(schema), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern)
        for batch in batches:
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            packed = [pack(t or "", target, overlap, max_chunks, compiled, count) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, type=fields.field("chunks").type)], schema=fields)

    packed = docs.mapInArrow(run, schema)
    return packed.select(*keys, F.size("chunks").alias("total_chunks"), F.inline("chunks")).withColumn("uuid", ids.chunk_uuid(F.col("chunk_index"), F.col("text")))


def dedup_exact(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The first chunk of each text within its document."""
    first = Window.partitionBy(*keys, F.sha2("text", 256)).orderBy("chunk_index")
    return chunks.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


#: Chunks that are compared with the kept ones at a time.
FOLD = 256


class _Kept:
    """The vectors of one document's kept chunks, in order, and which of the next ones stay."""

    def __init__(self, threshold: float):
        self.threshold, self.n = threshold, 0
        self.rows, self.norms = np.zeros((0, 0)), np.zeros(0)
        self.sizes = np.zeros(0, int)

    def take(self, vectors: list) -> np.ndarray:
        sizes = np.array([len(v) if v is not None else 0 for v in vectors])
        width = max(int(sizes.max(initial=0)), self.rows.shape[1])
        new = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            new[i, : sizes[i]] = v if v is not None else ()
        norms = np.sqrt(np.einsum("ij,ij->i", new, new))
        if width > self.rows.shape[1]:
            self.rows = np.pad(self.rows, ((0, 0), (0, width - self.rows.shape[1])))
        stays = ~self._near(new, norms, sizes, self.rows[: self.n], self.norms[: self.n], self.sizes[: self.n]).any(axis=1)
        within = self._near(new, norms, sizes, new, norms, sizes)
        for i in np.nonzero(stays)[0]:
            stays[i] = not (within[i, :i] & stays[:i]).any()
        kept = np.nonzero(stays)[0]
        if self.n + len(kept) > len(self.rows):
            room = max(FOLD, len(self.rows), len(kept))
            self.rows, self.norms, self.sizes = np.pad(self.rows, ((0, room), (0, 0))), np.pad(self.norms, (0, room)), np.pad(self.sizes, (0, room))
        at = slice(self.n, self.n + len(kept))
        self.rows[at], self.norms[at], self.sizes[at] = new[kept], norms[kept], sizes[kept]
        self.n += len(kept)
        return stays

    def _near(self, a, na, sa, b, nb, sb) -> np.ndarray:
        """Whether the cosine reaches the threshold; it is 0 for null, empty, zero or unequally long vectors."""
        norms = na[:, None] * nb[None, :]
        fits = (norms > 0) & (sa[:, None] == sb[None, :])
        return np.where(fits, (a @ b.T) / np.where(norms > 0, norms, 1), 0.0) >= self.threshold


def dedup_near(chunks: DataFrame, keys: list[str], vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """In order, drops a chunk whose vector is within the threshold of one that was kept. A document's chunks go through one task in
    order, a block at a time, and are compared with the kept ones only; the task holds the kept vectors of one document."""
    names = chunks.columns
    ordered = chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, kept = None, None
        for batch in batches:
            own = list(zip(*(batch.column(names.index(k)).to_pylist() for k in keys)))
            at = 0
            while at < len(own):
                end = at + 1
                while end < len(own) and end - at < FOLD and own[end] == own[at]:
                    end += 1
                if kept is None or own[at] != document:
                    document, kept = own[at], _Kept(threshold)
                part = batch.slice(at, end - at)
                stays = kept.take(part.column(names.index(vector)).to_pylist())
                if stays.any():
                    yield part.filter(pa.array(stays))
                at = end

    return ordered.mapInArrow(run, chunks.schema)


def dedup(chunks: DataFrame, keys: list[str], embed: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.95) -> DataFrame:
    """Near deduplication by the embedder's vectors; without one, or where it fails, exact deduplication. Only what the embedder
    itself raises counts as its failure, in the call or in a task; a cluster's trouble is raised as it is."""
    if embed is None:
        return dedup_exact(chunks, keys)
    try:
        with_vectors = embed(chunks)
    except Exception:
        return dedup_exact(chunks, keys)
    try:
        with_vectors = save(with_vectors, "embedded")
    except PythonException:
        return dedup_exact(chunks, keys)
    return dedup_near(with_vectors, keys, "embedding", threshold).select(*chunks.columns)


def identify(docs: DataFrame) -> DataFrame:
    """Adds content_hash, corpus_uuid and size_chars."""
    return docs.withColumn("content_hash", ids.content_hash(F.col("text"))).withColumn("corpus_uuid", ids.uuid5(F.col("content_hash"))).withColumn("size_chars", F.length("text"))
