"""Operators that compare documents, against plain versions written from their contracts."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from charloom.llm import decontaminate, jaccard, packed, substring
from charloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_substring(docs, width=13):
    docs = [(i, WORD.findall(t)) for i, t in docs]
    least = {}
    for i, w in docs:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in docs:
        gone = {p + k for p in range(len(w) - width + 1) if least[tuple(w[p : p + width])] < i for k in range(width)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def plain_jaccard(docs):
    sets = []
    for i, t in docs:
        w = WORD.findall(t.translate(SMALL))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    lists = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            lists[g].append(k)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (_, s) in enumerate(sets):
        n = collections.Counter(o for g in s for o in lists[g] if o < k)
        for o, x in n.items():
            if 100 * x >= 80 * (len(s) + len(sets[o][1]) - x):
                a, b = root(k), root(o)
                up[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def near_copies(seed, n=150, length=60):
    """Texts around a few bases, with so many edits that links are chance."""
    rnd = random.Random(seed)
    bases = [[f"w{rnd.randrange(400)}" for _ in range(length)] for _ in range(3)]
    out = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(30)}"
        if rnd.random() < 0.2:
            w = w[: rnd.randrange(3, len(w))]
        out.append((1000 - i, " ".join(w)))
    return out


def documents(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def inputs(spark, sf, odd):
    yield odd
    yield spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    yield spark.createDataFrame(near_copies(1), "doc_id long, text string").repartition(5)


def test_substring(spark, sf, odd):
    for df in inputs(spark, sf, odd):
        got = sorted(tuple(r)[:4] for r in substring.remove_repeats(df).collect())
        assert got == plain_substring(documents(df))


def test_substring_small_chunks(spark, sf, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_WORDS", 2000)
    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    got = sorted(tuple(r)[:4] for r in substring.remove_repeats(df).collect())
    assert got == plain_substring(documents(df))


def test_substring_paths():
    pos, src, off = np.array([3, 4, 5, 9, 10]), np.array([1, 1, 1, 1, 2]), np.array([0, 0, 0, 0, 0])
    assert substring.spans_of([(pos, src, off)], 13) == [(3, 18, 1, 3), (9, 22, 1, 9), (10, 23, 2, 10)]


def test_repeated_paths(spark, sf):
    """Each path's words are the source's words, and the source has a smaller id."""
    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    words = {i: WORD.findall(t) for i, t in documents(df)}
    found = substring.repeated_paths(df).collect()
    assert found
    for r in found:
        assert r.source_id < r.doc_id and r.last - r.first >= 13
        assert words[r.doc_id][r.first : r.last] == words[r.source_id][r.source_first : r.source_first + r.last - r.first]


def test_jaccard(spark, sf, odd):
    for df in inputs(spark, sf, odd):
        got = sorted(tuple(r) for r in jaccard.jaccard_components(df).collect())
        assert got == plain_jaccard(documents(df))


@pytest.mark.parametrize("seed", [2, 3])
def test_jaccard_in_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    monkeypatch.setattr(packed, "CHUNK_WORDS", 1000)
    df = spark.createDataFrame(near_copies(seed, 200), "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in jaccard.jaccard_components(df).collect()) == plain_jaccard(documents(df))


def test_keep_one(spark):
    docs = near_copies(5, 60)
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, component_id string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain_jaccard(docs)})


def test_empty(none):
    assert substring.remove_repeats(none).count() == 0
    assert jaccard.jaccard_components(none).count() == 0


def test_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (1, text), (2, text + " more")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == {None: 0, 1: 20, 2: 20}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {None: 1, 1: 1, 2: 1}


def test_positions():
    rnd = np.random.default_rng(0)
    owner = np.sort(rnd.integers(0, 20, 500))
    pos = np.concatenate([np.sort(rnd.choice(100_000, (owner == o).sum(), replace=False)) for o in np.unique(owner)])
    counts = packed.counted(owner)[1]
    assert (packed.unpack_positions(counts, *packed.pack_positions(owner, pos)) == pos).all()
    h = rnd.integers(0, 1 << 62, 50).astype(np.uint64)
    assert (packed.widen(packed.squeeze(h)) == h & np.uint64((1 << 56) - 1)).all()


def test_components(spark):
    rnd = random.Random(0)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}


def test_repeated_ids(spark):
    """Different texts of one id are told apart where rows are dropped: only the linked or contaminated ones go."""
    rnd = random.Random(6)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    long_, other, third, item = words(40), words(30), words(35), "Which of the old bridges over the river was built by the masons of the town in winter?"
    rows = [(1, long_), (2, long_), (2, other), (3, third), (3, None), (3, ""), (None, long_), (None, other), (1, long_), (5, f"{words(5)} {item} {words(5)}"), (5, words(12))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, component_id int")
    left = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()), key=repr)
    assert left == sorted([r for r in rows if r != (2, long_)], key=repr)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect()), key=repr)
    assert left == sorted([r for r in rows if r[0] != 5 or item not in r[1]], key=repr)
