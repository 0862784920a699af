"""Byte-level BPE encoding and decoding with a public rank file.

Two forms of the same fold:

* `encode_words` keeps to Spark's higher-order functions: it folds the ranked merges over the byte arrays of distinct words,
  with the ranks as a literal map (in buckets, since Spark looks a map's keys up one after the other).
* `encode_documents` applies the fold per task to the distinct pieces of its documents, with the rank map broadcast (it is
  bounded by the vocabulary file) and the results kept in a bounded memo. README gives the figures for which documents take
  this form.

A null text is empty and has no tokens. Rows are encoded one by one, so repeated rows and ties need no rule. Texts of any
length are taken whole; a piece of thousands of characters is merged through a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MEMO = 200_000
BUCKETS = 8192


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank, leftmost first, is merged until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        low, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (low is None or r < low):
                low, at = r, i
        if low is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, after, before = [i + 1 for i in range(n)], [*range(1, n), -1], [-1, *range(n - 1)]
    alive, heap = [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or end[j] != to:
            continue
        alive[j], end[i], after[i] = False, to, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Text to the bytes of its ids (little-endian, unsigned, 32 bits each).

    Between two characters that are not white space, a single blank always begins a new match of the pattern, so a text whose
    blanks all stand so is cut there first and the cuts' ids are kept; any other text is cut by the pattern alone.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+")).findall
        self.odd = re.compile(r" \s|\s ").search
        self.words: dict[str, bytes] = {}
        self.cuts: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        found = self.words.get(w)
        if found is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            found = b"".join([i.to_bytes(4, "little") for i in merge(w.encode("utf-8", "surrogatepass"), self.ranks)])
            if len(w) < 64:
                self.words[w] = found
        return found

    def _cut(self, c: str) -> bytes:
        word = self.word
        found = b"".join([word(w) for w in self.find(c)])
        if len(c) < 64:
            if len(self.cuts) >= MEMO:
                self.cuts.clear()
            self.cuts[c] = found
        return found

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[-1].isspace() or text[0].isspace() or self.odd(text):
            word = self.word
            return b"".join([word(w) for w in self.find(text)])
        first, *rest = text.split(" ")
        get, cut = self.cuts.get, self._cut
        return b"".join([get(first) or cut(first), *[get(c) or cut(c) for c in [" " + c for c in rest]]])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary): the ids of each whole text as little-endian unsigned 32-bit integers."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def work():
        encode = Encoder(ranks.value, pattern)
        return lambda doc_id, text: ((doc_id, encode(text)),)

    return map_rows(texts(docs), work, "doc_id long, ids binary", every=500)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the pieces of the ids, one after the other."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def work():
        import numpy as np

        pieces = [b""] * (max(ranks.value.values()) + 1)
        for piece, i in ranks.value.items():
            pieces[i] = piece
        take = pieces.__getitem__
        return lambda doc_id, ids: ((doc_id, ids, b"".join(map(take, np.frombuffer(ids, "<u4").tolist()))),)

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id long, ids binary, decoded binary", every=500)


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """An array of maps from a hex string to its rank; the map of a key is the one at its crc32. Folded to a literal once."""
    import zlib

    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), F.lit("array<map<string,int>>"))


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """(word, ids array<int>) for a table of distinct words, by higher-order functions alone: a word is an array of hex strings,
    and each step of the fold joins the leftmost pair of the lowest rank."""
    literal = words.sparkSession.range(1).select(rank_literal(ranks).alias("r"))
    held = words.select(F.col(word).alias("word"), F.lower(F.hex(F.encode(F.col(word), "UTF-8"))).alias("h")).crossJoin(F.broadcast(literal))

    def rank(key: Column) -> Column:
        return F.element_at(F.get("r", F.expr("0") + F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(BUCKETS)).cast("int")), key)

    def step(parts: Column, _: Column) -> Column:
        n = F.size(parts)
        best = F.array_min(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.coalesce(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))), F.lit(1 << 30)).alias("rank"), i.alias("i"))))
        return F.when(n < 2, parts).otherwise(
            F.transform(F.array(best), lambda b: F.when(b["rank"] == (1 << 30), parts).otherwise(
                F.concat(F.slice(parts, 1, b["i"]), F.array(F.concat(F.get(parts, b["i"]), F.get(parts, b["i"] + 1))), F.slice(parts, b["i"] + 3, F.greatest(n - b["i"] - 2, F.lit(0)))))
            )[0]
        )

    single = F.transform(F.sequence(F.lit(0), F.expr("length(h) div 2").cast("int") - 1), lambda i: F.substr("h", i * 2 + 1, F.lit(2)))
    start = F.when(F.length("h") == 0, F.expr("cast(array() as array<string>)")).otherwise(single)
    merged = F.when(F.length("h") == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(start), F.lit(1))), start, step))
    return held.select("word", F.transform(merged, rank).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return digests(decode_documents(encode_documents(table(spark, sf_dir, "documents"), path, P.PATTERN), path))
