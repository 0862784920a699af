"""The epsilon grid order join against all pairs."""

import math

import numpy as np
import pytest

from charloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, h int, c int"


def plain(rows, least=0.95):
    """All pairs, one by one."""
    n, parent = len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def sound(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            u, v = rows[i][1], rows[j][1]
            if sound(u) and sound(v) and len(u) == len(v):
                if math.fsum(x * y for x, y in zip(u, v)) / (math.sqrt(math.fsum(x * x for x in u)) * math.sqrt(math.fsum(x * x for x in v))) >= least:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    smallest = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), vec_id), vec_id)
    return sorted(((r[0], links[i], smallest.get(find(i)), r[0] == smallest.get(find(i))) for i, r in enumerate(rows)), key=repr)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2, 3) for i, v in rows], schema).repartition(3)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def some(rng, n, d, near=0.04):
    """Clusters of near copies, copies, and vectors on their own."""
    centres = rng.normal(size=(12, d))
    out = []
    for k in range(n):
        v = centres[k % 12] + near * (k % 5) * rng.normal(size=d) if k % 3 else rng.normal(size=d)
        out.append([float(np.float32(x)) for x in v])
    return out


@pytest.mark.parametrize("dims", [2, 16])
def test_equals_all_pairs(spark, monkeypatch, dims):
    monkeypatch.setattr(vectors, "STRETCH", 8 * 64 * dims)  # stretches of 64, so that there are many
    monkeypatch.setattr(vectors, "LEAF", 16)
    rows = list(enumerate(some(np.random.default_rng(dims), 400, dims)))
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(7, rows[20][1]), (7, rows[7][1])]
    assert got(vectors.near_links(frame(spark, rows))) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [1.0, inf], [1.0, None], [1.0], [2.0], [-1.0], [1.0, 0.0], [1.0, -0.0], [2.0, 0.0], [1e-30, 0.0], [3e38, 3e37], [1.0, 0.0, 0.0], [0.0, 1.0], None, [0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(odd)] + [(None, [1.0, 0.0]), (None, [0.0, 1.0, 5.0]), (3, [0.0, 1.0])]
    assert got(vectors.near_links(frame(spark, rows))) == plain(rows)
    wide = "vec_id long, embedding array<double>, label int, n_links string, h int, c int"
    rows = [(i, v) for i, v in enumerate([[1e200, 1e200], [1e-200, 1e-200], [-1e300, 1.0], [5e-324, 5e-324]])]
    assert [r[1] for r in got(vectors.near_links(frame(spark, rows, wide)))] == [2, 2, 0, 2]


def test_no_vectors(spark):
    assert got(vectors.near_links(frame(spark, []))) == []
    assert got(vectors.near_links(frame(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_balls_count_without_pairs(monkeypatch):
    """A tight cluster is counted whole: not one pair is compared."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=8) + 0.001 * rng.normal(size=(5000, 8))
    work = vectors.Join(rows, np.full(5000, 8), np.full(5000, 2), np.eye(8), 0.95, math.sqrt(0.1))
    monkeypatch.setattr(vectors.Join, "_compare", lambda *a: pytest.fail("compared"))
    work.run(0, 5000, 0, 5000)
    assert set(work.links) == {2 * 4999} and not work.root.any()


def test_distant_blocks_are_skipped(monkeypatch):
    """Intervals in grid order that are provably apart are never compared."""
    angles = np.linspace(0, math.pi, 4096)
    rows = np.column_stack([np.cos(angles), np.sin(angles)])
    work = vectors.Join(rows, np.full(4096, 2), np.ones(4096, int), np.eye(2), 0.999, math.sqrt(0.002))
    compared = []
    inner = vectors.Join._compare
    monkeypatch.setattr(vectors, "LEAF", 64)
    monkeypatch.setattr(vectors.Join, "_compare", lambda self, a, b, c, d: (compared.append((b - a) * (d - c)), inner(self, a, b, c, d)))
    work.run(0, 4096, 0, 4096)
    cosines = rows @ rows.T
    assert (work.links == (cosines >= 0.999).sum(axis=1) - 1).all()
    assert sum(compared) < 0.2 * 4096**2 / 2


def test_tree_of_stretches(spark):
    """The recursive join keeps just the pairs of boxes that are near."""
    rng = np.random.default_rng(3)
    low = np.sort(rng.uniform(0, 50, 300))
    rows = [(k, float(low[k]), float(low[k] + 0.3), 0.0, 0.0) for k in range(300)]
    boxes = spark.createDataFrame(rows, "stretch long, lo_x double, hi_x double, lo_y double, hi_y double")
    found = {tuple(r) for r in vectors.near_stretches(boxes, 300, 0.5, ["x", "y"]).collect()}
    assert found == {(a, b) for a in range(300) for b in range(a, 300) if low[b] - low[a] - 0.3 <= 0.5}
