"""Embedding near-duplicates by an epsilon grid order join.

Equal vectors are one class first, with their number, so copies never meet each other. The classes are sorted by the cells of a
grid on their leading principal dimensions, with cells as wide as the greatest distance at which unit vectors still link, and
numbered in that order. Stretches of consecutive numbers, bounded in bytes, are joined recursively: Spark goes down a tree of
intervals with sixteen children a node and keeps the pairs whose boxes are near enough; each pair of stretches that is left is a
group of its own, which halves its intervals further, leaves out those provably apart, counts those provably together without
looking at pairs, and compares the rest. Links are counted and spanned by a forest within the group, never listed.

The axes come from at most SAMPLE vectors by hash; they only set the order. Every pair with a cosine of `least` or more is found,
for any axes.

Rows are vectors of their own, also where their ids repeat; equal rows link with each other. Null, empty, zero, or with a null or
non-finite component: no links, and a component of their own. Vectors of unequal length don't link. The smallest id ignores nulls;
a null id with no links has a null component and is kept. An empty table gives no rows. Other columns are ignored, whatever they
are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import drop, lean, save, table, trim
from .components import components

#: Vectors that the principal axes are fitted on, and how many axes there are.
SAMPLE, AXES = 2048, 8
#: Bytes of a stretch's vectors as doubles; vectors within an interval that isn't halved further; children of a tree node, as a shift.
STRETCH, LEAF, FAN = 4 << 20, 512, 4
#: What rounding may add to a distance.
SLACK = 1e-9
RESULT = "c long, n long, r long"


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix of doubles, short rows padded with zeros, and the rows' lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    width = int(sizes.max(initial=0))
    if len(sizes) * width == len(flat):
        return flat.reshape(len(sizes), width), sizes
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by a power of two near their largest component, which changes no cosine and keeps squares finite; norms."""
    top = np.abs(rows).max(axis=1, initial=0)
    rows = np.ldexp(rows, -np.frexp(np.where(top > 0, top, 1))[1][:, None])
    return rows, np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _project(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, which stand for zeros beyond their own length; zeros for axes that aren't there."""
    width = min(units.shape[1], axes.shape[1])
    out = np.zeros((len(units), AXES))
    out[:, : len(axes)] = units[:, :width] @ axes[:, :width].T
    return out


def _axes(classes: DataFrame) -> np.ndarray:
    sample = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toArrow()["vector"]
    if not len(sample):
        return np.zeros((0, 0))
    rows, norms = _scaled(_rows(sample)[0])
    units = rows / norms[:, None]
    return np.linalg.svd(units - units.mean(axis=0), full_matrices=False)[2][:AXES]


def usable(vector) -> F.Column:
    """Whether a vector can link at all."""
    d = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce(F.forall(d, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(d, lambda x: x != 0), F.lit(False))


def _prepared(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id, vector, h: the vector is null where it can't link; a negative zero is a zero."""
    kind = "float" if isinstance(vectors.schema[column].dataType.elementType, FloatType) else "double"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + F.lit(0.0).cast(kind))))
    return rows.withColumn("h", F.xxhash64("vector"))


def grid_order(classes: DataFrame, reach: float) -> tuple[DataFrame, int, np.ndarray]:
    """(c, weight, vector, number, p0 …): numbered by grid cell, then by place within the cell; how many there are; the axes."""
    axes = _axes(classes)
    kind = classes.schema["vector"].dataType.simpleString()

    def run(batches):
        lean()
        for batch in batches:
            rows, sizes = _rows(batch["vector"])
            rows, norms = _scaled(rows)
            p = _project(rows / norms[:, None], axes)
            cell, inside = np.divmod(p / reach, 1)
            parts = [sizes.astype(">u4").view("u1").reshape(-1, 4), np.clip(cell + 128, 0, 255).astype("u1"), (inside * 255).astype("u1"), np.asarray(batch["c"]).astype(">u8").view("u1").reshape(-1, 8)]
            keys = np.hstack(parts)
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            order = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])
            yield pa.RecordBatch.from_arrays([batch["c"], batch["weight"], batch["vector"], pa.array(sizes.astype("f8")), *(pa.array(x) for x in p.T), order], names)
        trim()

    places = [f"p{k}" for k in range(AXES)]
    names = ["c", "weight", "vector", "dims", *places, "order"]
    schema = f"c long, weight long, vector {kind}, dims double, {', '.join(f'{x} double' for x in places)}, order binary"
    placed = classes.select("c", "weight", "vector").mapInArrow(run, schema)
    placed = placed.repartitionByRange("order").sortWithinPartitions("order").drop("order")
    placed = save(placed.withColumn("part", F.spark_partition_id()).withColumn("i", F.expr("monotonically_increasing_id() & 8589934591")), "grid")
    # a row for each partition
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = classes.sparkSession.createDataFrame(before, "part int, before long")
    out = placed.join(offsets, "part").withColumn("number", F.col("i") + F.col("before")).drop("part", "i", "before")
    out._saved_at = placed._saved_at
    return out, total, axes


def near_stretches(boxes: DataFrame, count: int, reach: float, sides: list[str]) -> DataFrame:
    """(a, b), a <= b: stretches whose boxes are no further apart than reach. Goes down the tree of intervals, level by level; the
    children of a pair meet by their parents' numbers, and pairs that are provably apart go no further."""
    pairs, depth = boxes.sparkSession.range(min(count, 1)).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), 0
    while 1 << FAN * depth < count:
        depth += 1
    for level in range(depth - 1, -1, -1):
        ends = [f(F.col(f"{e}_{s}")).alias(f"{e}_{s}") for s in sides for e, f in (("lo", F.min), ("hi", F.max))]
        nodes = boxes.groupBy(F.shiftright("stretch", FAN * level).alias("node")).agg(*ends) if level else boxes.withColumnRenamed("stretch", "node")
        x, y = (nodes.select(F.col("node").alias(f"{n}2"), F.shiftright("node", FAN).alias(n), *(F.col(f"{e}_{s}").alias(f"{n}_{e}_{s}") for s in sides for e in ("lo", "hi"))) for n in "ab")
        gap = lambda s: F.greatest(F.lit(0.0), F.col(f"b_lo_{s}") - F.col(f"a_hi_{s}"), F.col(f"a_lo_{s}") - F.col(f"b_hi_{s}"))
        near = sum((gap(s) * gap(s) for s in sides), F.lit(0.0)) <= reach * reach
        pairs = pairs.join(x, "a").join(y, "b").where((F.col("a2") <= F.col("b2")) & near).select(F.col("a2").alias("a"), F.col("b2").alias("b"))
    return pairs


class Join:
    """The recursive join within one pair of stretches: rows in grid order, links counted, components as a forest."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, weights: np.ndarray, axes: np.ndarray, least: float, reach: float):
        self.rows, self.norms = _scaled(rows)
        units = self.rows / self.norms[:, None]
        self.sizes, self.weights, self.least, self.reach = sizes, weights, least, reach
        self.places = np.column_stack([sizes, _project(units, axes)])
        self.units = units.astype(np.float32)
        #: What a product of unit vectors in single precision may be too low by.
        self.low = np.float32(least - (rows.shape[1] + 4) * 1.2e-7)
        self.links = np.zeros(len(rows), np.int64)
        self.root = np.arange(len(rows))

    def _box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.places[a:b].min(axis=0), self.places[a:b].max(axis=0)

    def run(self, a: int, b: int, c: int, d: int) -> None:
        """Joins rows a to b with rows c to d, which are the same or come after them."""
        todo = [(a, b, c, d)]
        while todo:
            a, b, c, d = todo.pop()
            if a == b or c == d:
                continue
            (low1, high1), (low2, high2) = self._box(a, b), self._box(c, d)
            gap = np.maximum(0, np.maximum(low2 - high1, low1 - high2))
            if gap @ gap > self.reach**2:
                continue
            span = np.maximum(high1, high2) - np.minimum(low1, low2)
            if span @ span <= self.reach**2 and self._together(a, b, c, d):
                self._all(a, b, c, d)
            elif max(b - a, d - c) <= LEAF:
                self._compare(a, b, c, d)
            elif a == c:
                m = (a + b) // 2
                todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            elif b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]

    def _together(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether all rows are provably within reach of each other: two balls hold them."""
        centres, radius = [], 0.0
        for i, j in ((a, b), (c, d)):
            units = self.rows[i:j] / self.norms[i:j, None]
            centres.append(units.mean(axis=0))
            radius += np.sqrt(((units - centres[-1]) ** 2).sum(axis=1).max())
        return bool(np.sqrt(((centres[0] - centres[1]) ** 2).sum()) + radius <= self.reach - 2 * SLACK)

    def _all(self, a: int, b: int, c: int, d: int) -> None:
        self.links[a:b] += self.weights[c:d].sum()
        if a == c:
            self.links[a:b] -= self.weights[a:b]
        else:
            self.links[c:d] += self.weights[a:b].sum()
        self._unite(np.r_[np.full(d - c, a), a:b], np.r_[c:d, np.full(b - a, c)])

    def _compare(self, a: int, b: int, c: int, d: int) -> None:
        found = self.units[a:b] @ self.units[c:d].T >= self.low
        i, j = np.nonzero(np.triu(found, 1) if a == c else found)
        i, j = i + a, j + c
        same = np.concatenate([np.einsum("ij,ij->i", self.rows[i[k : k + 20_000]], self.rows[j[k : k + 20_000]]) / (self.norms[i[k : k + 20_000]] * self.norms[j[k : k + 20_000]]) >= self.least for k in range(0, len(i), 20_000)] or [np.zeros(0, bool)])
        same &= self.sizes[i] == self.sizes[j]
        i, j = i[same], j[same]
        if len(i):
            np.add.at(self.links, i, self.weights[j])
            np.add.at(self.links, j, self.weights[i])
            self._unite(i, j)

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hooks the roots of linked rows to the smaller one until every link lies within one tree."""
        root = self.root
        while True:
            x, y = root[i], root[j]
            open_ = x != y
            if not open_.any():
                return
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]


def near_links(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    rows = _prepared(vectors, key, column)
    classes = save(rows.where("vector is not null").groupBy("h", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("own")).withColumn("c", F.monotonically_increasing_id()), "classes")
    ordered, count, axes = grid_order(classes, reach)
    width = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    ordered = ordered.withColumn("stretch", F.expr(f"number div {max(64, STRETCH // (8 * width))}"))
    sides = ["dims", *(f"p{k}" for k in range(AXES))]
    boxes = save(ordered.groupBy("stretch").agg(*(f(s).alias(f"{e}_{s}") for s in sides for e, f in (("lo", F.min), ("hi", F.max)))), "boxes")
    pairs = save(near_stretches(boxes, boxes.count(), reach, sides), "stretches")
    ends = pairs.select("a", "b", F.col("a").alias("stretch")).unionByName(pairs.where("a < b").select("a", "b", F.col("b").alias("stretch")))

    def join(group: pa.Table) -> pa.Table:
        lean()
        group = group.sort_by("number")
        values, sizes = _rows(group["vector"])
        first = group["a"][0].as_py()
        split = int(np.searchsorted(np.asarray(group["stretch"]), first, side="right"))
        work = Join(values, sizes, np.asarray(group["weight"]), axes, least, reach)
        n = len(values)
        work.run(0, split, *((0, n) if split == n else (split, n)))
        linked, c = np.nonzero(work.links)[0], np.asarray(group["c"])
        out = pa.table({"c": c[linked], "n": work.links[linked], "r": c[work.root[linked]]})
        trim()
        return out

    met = ordered.select("stretch", "number", "c", "weight", "vector").join(ends, "stretch")
    found = save(met.groupBy("a", "b").applyInArrow(join, RESULT), "links")
    totals = found.groupBy("c").agg(F.sum("n").alias("n"))
    roots = components(found.where("c != r").select("c", "r"), "c", "r").select(F.col("node").alias("c"), "root")
    named = classes.join(totals, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = named.groupBy("root").agg(F.min("own").alias("component_id"))
    known = save(named.join(smallest, "root").select("h", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "known")
    for x in (ordered, boxes, pairs, found, classes):
        drop(x)
    out = rows.join(known, ["h", "vector"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "embeddings"))
