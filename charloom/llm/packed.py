"""Inverted lists of word windows, moved between tasks as packed blocks.

A window is a 64-bit hash over the hashes of its words. The lists are dealt into buckets by the hash's high bits; what a task
sends to a bucket is one block: its documents, how many postings each has there, and per posting seven bytes of the hash and,
where asked for, the position. The number of buckets follows the input, so a bucket's share stays the same at any size.
"""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, trim

#: Words whose windows a task gathers before it sends a block to each bucket, and that a bucket gets in all.
CHUNK_WORDS = 500_000
BUCKET_WORDS = 1_000_000
MEMO = 100_000
NULL_ID = -(1 << 63)
ROWS = "kind int, key int, block binary"
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def buckets_for(docs: DataFrame, least: int = 64) -> int:
    """Buckets for all words of docs, from the length of its texts."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).collect()[0]["n"] or 0
    return max(least, math.ceil(chars / 6 / BUCKET_WORDS))


def groups_for(buckets: int) -> int:
    """Groups of documents, by doc_id modulo a number that even steps between the ids share no small factor with."""
    n = 4 * buckets + 1
    while any(n % k == 0 for k in (3, 5, 7)):
        n += 2
    return n


class WordHashes:
    """64-bit hashes of words, the same in every process."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.digest, self.memo = xxh3_64_intdigest, {}

    def __call__(self, words: list[bytes]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        get, out = memo.get, []
        try:
            return [memo[w] for w in words]
        except KeyError:
            pass
        for w in words:
            h = get(w)
            if h is None:
                h = memo[w] = self.digest(w) >> 1
            out.append(h)
        return out


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n] * M3
    for k in range(1, width):
        h = (h + words[k : n + k]) * M3
    return mix(h)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each length, one after the other."""
    return np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(starts_of(lengths)[:-1], lengths)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def squeeze(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


def pack(*arrays) -> bytes:
    """Arrays or bytes behind a header of their lengths."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return struct.pack(f"<{len(raw) + 1}I", len(raw), *map(len, raw)) + b"".join(raw)


def unpack(block: bytes) -> list[bytes]:
    n, = struct.unpack_from("<I", block)
    sizes, at, out = struct.unpack_from(f"<{n}I", block, 4), 4 + 4 * n, []
    for s in sizes:
        out.append(block[at : at + s])
        at += s
    return out


def pack_positions(owner: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Positions, ascending per owner, as steps of a byte; larger steps go to a list of their own."""
    step = np.diff(pos, prepend=0)
    first = np.ones(len(pos), bool)
    first[1:] = owner[1:] != owner[:-1]
    step[first] = pos[first]
    far = np.flatnonzero(step > 254)
    small = np.minimum(step, 255).astype(np.uint8)
    return small.tobytes(), far.astype(np.uint32).tobytes(), step[far].astype(np.uint32).tobytes()


def unpack_positions(counts: np.ndarray, small: bytes, far: bytes, steps: bytes) -> np.ndarray:
    step = np.frombuffer(small, np.uint8).astype(np.int64)
    step[np.frombuffer(far, np.uint32)] = np.frombuffer(steps, np.uint32)
    total = np.cumsum(step)
    starts = starts_of(counts)[:-1][counts > 0]
    base = total[starts] - step[starts]
    return total - np.repeat(base, counts[counts > 0])


def deal(key: np.ndarray, n: int):
    """(key, indexes in their order) for each key that occurs."""
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(n + 1))
    for k in range(n):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k] : bounds[k + 1]]


def counted(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, postings of each) for an array in which equal owners are side by side."""
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    return owner[cut], np.diff(np.concatenate([cut, [len(owner)]]))


def chunked(batches, tokens, take):
    """Gathers (doc_id, words) of the batches' rows until CHUNK_WORDS words are there, then yields what take() makes of them:
    take(ids, lengths, word hashes). tokens(text) gives the words."""
    lean()
    hashes = WordHashes()
    ids, lengths, words, held = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = tokens(text)
                ids.append(NULL_ID if doc_id is None else doc_id)
                lengths.append(len(found))
                words.append(np.array(hashes(found), dtype=np.int64))
                held += len(found)
                if held >= CHUNK_WORDS or len(ids) >= 50_000:
                    yield from take(np.array(ids, np.int64), np.array(lengths, np.int64), np.concatenate(words).view(np.uint64))
                    ids, lengths, words, held = [], [], [], 0
    if ids:
        yield from take(np.array(ids, np.int64), np.array(lengths, np.int64), np.concatenate(words).view(np.uint64))
    del hashes, ids, lengths, words
    trim()


def rows_batch(rows: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    kind, key, block = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(block, pa.binary())], names=["kind", "key", "block"])


def rows_table(rows: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    fields = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("block", pa.binary())])
    return pa.Table.from_batches([rows_batch(rows)], fields) if rows else fields.empty_table()
