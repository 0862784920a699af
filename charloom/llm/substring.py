"""Substring deduplication by a de Bruijn graph of word windows.

Each window of WIDTH words is an edge between the windows of WIDTH - 1 words that it starts and ends with. Edges meet by their
hash in buckets, where the occurrence in the smallest doc_id is the edge's source coordinate; edges of one document only go no
further. The repeated edges are then joined with the documents, where neighbours that lead on in the same source (nodes
without a branch) compact into one path, a repeated span with its source. A word is removed where a window over it also starts
in a document with a smaller doc_id; all windows are judged on the input.

A null text has no words and loses none. Texts shorter than a window lose none. Repetition within a document removes nothing.
Rows that share a doc_id are one document's: neither is smaller than the other, and a position found in one is found in all.
A null doc_id comes before all others. An edge that recurs in a task is sent on once, from its smallest document there.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import lean, table, texts, trim

WIDTH = 13
PATHS = "key int, doc_id long, first int, last int, source_id long, source_first int"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_paths long, longest_path long"


def _hits(n: int, doc: np.ndarray, pos: np.ndarray, src: np.ndarray, src_pos: np.ndarray):
    """Blocks of repeated edges by document group: (group, block). Source and offset seldom change along a path, so they
    compress to next to nothing."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    order = np.lexsort((pos, doc))
    doc, pos, src, offset = doc[order], pos[order], src[order], (src_pos - pos)[order]
    for g, at in packed.deal(np.mod(doc, n), n):
        docs, counts = packed.counted(doc[at])
        yield g, squeeze(packed.pack(docs, counts.astype(np.uint32), *packed.pack_positions(doc[at], pos[at]), src[at], offset[at].astype(np.int32)))


def _read_hits(blocks: list[bytes]) -> dict[int, list]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    by: dict[int, list] = {}
    for block in blocks:
        raw = packed.unpack(expand(block))
        docs, counts = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.uint32).astype(np.int64)
        pos, src, offset = packed.unpack_positions(counts, *raw[2:5]), np.frombuffer(raw[5], np.int64), np.frombuffer(raw[6], np.int32)
        at = packed.starts_of(counts)
        for i, d in enumerate(docs.tolist()):
            s = slice(at[i], at[i + 1])
            by.setdefault(d, []).append((pos[s], src[s], offset[s]))
    return by


def edges(docs: DataFrame, buckets: int, groups: int, width: int) -> DataFrame:
    """Kind 0: edges by bucket. Kind 1: edges that a smaller document of the same task has, already settled."""

    def take(ids, lengths, words):
        if len(np.unique(ids)) < len(ids) or (np.diff(ids) < 0).any():
            order = np.argsort(ids, kind="stable")
            starts = packed.starts_of(lengths)[:-1][order]
            words = words[np.repeat(starts, lengths[order]) + packed.within(lengths[order])]
            ids, lengths = ids[order], lengths[order]
        h = packed.windows(words, width)
        n = np.maximum(lengths - width + 1, 0)
        pos = packed.within(n)
        at = np.repeat(packed.starts_of(lengths)[:-1], n) + pos
        h, doc = h[at], np.repeat(ids, n)
        order = np.argsort(h, kind="stable")
        head = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.empty(0, bool)
        first = np.empty(len(h), np.int64)
        first[order] = order[head][np.cumsum(head) - 1] if len(h) else order
        own = doc == doc[first]
        rows = []
        late = np.flatnonzero(~own)
        if len(late):
            rows += [(1, g, block) for g, block in _hits(groups, doc[late], pos[late], doc[first[late]], pos[first[late]])]
        keep = np.flatnonzero(own)
        for b, s in packed.deal(packed.bucket_of(h[keep], buckets), buckets):
            s = keep[s]
            docs_, counts = packed.counted(doc[s])
            rows.append((0, b, packed.pack(docs_, counts.astype(np.uint32), *packed.pack_positions(doc[s], pos[s]), packed.squeeze(h[s]))))
        if rows:
            yield packed.rows_batch(rows)

    def run(batches):
        yield from packed.chunked(batches, lambda text: text.encode("utf-8", "surrogatepass").split(), take)

    return docs.mapInArrow(run, packed.ROWS)


def repeated(edge_blocks: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Edges of two documents or more, by document group: one block per bucket and group."""

    def run(key, rows):
        lean()
        kind, block = rows.column("kind").to_numpy(), rows.column("block").to_pylist()
        number = rows.column("key").to_pylist()
        out = [(1, g, b) for k, g, b in zip(kind, number, block) if k == 1]
        h, doc, pos = [], [], []
        for i, k in enumerate(kind):
            if k == 0:
                raw, block[i] = packed.unpack(block[i]), None
                counts = np.frombuffer(raw[1], np.uint32).astype(np.int64)
                h.append(packed.widen(raw[5]))
                doc.append(np.repeat(np.frombuffer(raw[0], np.int64), counts))
                pos.append(packed.unpack_positions(counts, *raw[2:5]).astype(np.int32))
        if h:
            h, doc, pos = np.concatenate(h), np.concatenate(doc), np.concatenate(pos)
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            twin = np.zeros(len(h), bool)
            twin[order[1:][same]] = True
            twin[order[:-1][same]] = True
            h, doc, pos = h[twin], doc[twin], pos[twin]
            order = np.lexsort((pos, doc, h))
            h, doc, pos = h[order], doc[order], pos[order].astype(np.int64)
            if len(h):
                head = np.concatenate([[True], h[1:] != h[:-1]])
                first = np.flatnonzero(head)[np.cumsum(head) - 1]
                late = np.flatnonzero(doc != doc[first])
                if len(late):
                    out += [(1, g, b) for g, b in _hits(groups, doc[late], pos[late], doc[first[late]], pos[first[late]])]
        made = packed.rows_table(out)
        del h, doc, pos, out
        trim()
        return made

    # settled blocks ride along, dealt evenly over all buckets, so a bucket's share doesn't grow with the input
    return edge_blocks.groupBy(F.expr(f"case when kind = 0 then key else pmod(hash(key), {buckets}) end")).applyInArrow(run, packed.ROWS)


def spans_of(found: list, width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """Paths (first word, end word, source document, first word there): neighbours with the same source and offset are one."""
    pos, src, offset = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((src, pos))
    pos, src, offset = pos[order], src[order], offset[order]
    one = np.concatenate([[True], pos[1:] != pos[:-1]])
    pos, src, offset = pos[one], src[one], offset[one]
    cut = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (offset[1:] != offset[:-1])]))
    last = np.concatenate([cut[1:], [len(pos)]]) - 1
    return list(zip(pos[cut].tolist(), (pos[last] + width).tolist(), src[cut].tolist(), (pos[cut] + offset[cut]).tolist()))


def paths(hits: DataFrame, width: int = WIDTH) -> DataFrame:
    """Compacts the repeated edges of each document: a row per path, a span of words that is found in the source as well."""

    def run(key, rows):
        import pyarrow as pa

        group, out = key[0].as_py(), []
        for doc, found in _read_hits(rows.column("block").to_pylist()).items():
            out += [(group, doc, *span) for span in spans_of(found, width)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=["key", "doc_id", "first", "last", "source_id", "source_first"])

    return hits.groupBy("key").applyInArrow(run, PATHS)


def repeated_paths(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, doc_id, first, last, source_id, source_first): words [first, last) of doc_id are those of source_id from
    source_first on. A null doc_id shows as the smallest long. `key` is the document's group."""
    rows = texts(docs)
    return _paths(rows, packed.buckets_for(rows), width)


def _paths(rows: DataFrame, buckets: int, width: int) -> DataFrame:
    groups = packed.groups_for(buckets)
    return paths(repeated(edges(rows, buckets, groups, width), groups, buckets), width)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: words, words removed, the digest of the kept ones, its paths and the longest one."""
    rows = texts(docs)

    def finish(key, left, right):
        import pyarrow as pa

        by: dict[int, list] = {}
        for doc, a, b in zip(right.column("doc_id").to_pylist(), right.column("first").to_pylist(), right.column("last").to_pylist()):
            by.setdefault(doc, []).append((a, b))
        out = []
        for doc_id, text in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()
            total, removed, own = len(words), 0, []
            if found := by.get(packed.NULL_ID if doc_id is None else doc_id):
                own = [s for s in found if s[1] <= total]
                gone = np.zeros(total, bool)
                for a, b in own:
                    gone[a:b] = True
                removed = int(gone.sum())
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            out.append((doc_id, total, removed, hashlib.sha256(b" ".join(words)).hexdigest(), len(own), max((b - a for a, b in own), default=0)))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_paths", "longest_path"]
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
        columns = list(zip(*out)) or [()] * 6
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    buckets = packed.buckets_for(rows)
    groups, found = packed.groups_for(buckets), _paths(rows, buckets, width)
    # the group of a document, as _hits() deals it
    numbered = rows.withColumn("key", F.expr(f"cast(pmod(coalesce(doc_id, {packed.NULL_ID + 1} - 1), {groups}) as int)"))
    return numbered.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(finish, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # how paths divide depends on which tasks met which copies first; what is removed doesn't
    return remove_repeats(table(spark, sf_dir, "documents")).drop("n_paths", "longest_path")
