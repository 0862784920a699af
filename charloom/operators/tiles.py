"""Joins by a likeness that is no equality: rows are ordered and cut into stretches of bounded size, and pairs of stretches are
compared as groups of their own, each within one Arrow call. Stretches whose boxes are provably too far apart never meet."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charloom.functions.shared import FEW, save

#: Children of a node of the tree of intervals, as a shift.
FAN = 4
#: Tasks that the pairs of stretches are dealt to.
MOST_TASKS = 5000
#: Stretches that rows are cut into while a stretch has room: a row is sent once for every stretch that its own may meet.
STRETCHES = 40


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> tuple[DataFrame, int]:
    """df with each row's place in the order, from 0, and how many rows there are. Places are a range partition's offset, the sum
    of the sizes of those before it, and the place within it; so nothing is sorted in one task. Equal keys are in any order."""
    keys = list(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_i", F.expr("monotonically_increasing_id() & 8589934591"))
    placed = save(placed, "numbered")
    before, total = [], 0
    # a row for each partition
    for part, n in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")
    out._saved_at = placed._saved_at
    return out, total


def near_stretches(boxes: DataFrame, count: int, sides: list[str], reach: float) -> DataFrame:
    """(a, b), a <= b: stretches 0 to count - 1 whose boxes lo_*, hi_* are within reach of each other on every side. Goes down a
    tree of intervals level by level: the children of a pair meet by their parents, and what is too far apart goes no further."""
    pairs, depth = boxes.sparkSession.range(min(count, 1)).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), 0
    while 1 << FAN * depth < count:
        depth += 1
    for level in range(depth - 1, -1, -1):
        nodes = boxes.groupBy(F.shiftright("stretch", FAN * level).alias("node")).agg(F.count(F.lit(1)), *(f(f"{e}_{s}").alias(f"{e}_{s}") for s in sides for e, f in (("lo", F.min), ("hi", F.max))))
        x, y = (nodes.select(F.col("node").alias(f"{n}2"), F.shiftright("node", FAN).alias(n), *(F.col(f"{e}_{s}").alias(f"{n}_{e}_{s}") for s in sides for e in ("lo", "hi"))) for n in "ab")
        near = F.lit(True)
        for s in sides:
            near = near & (F.col(f"b_lo_{s}") - F.col(f"a_hi_{s}") <= reach) & (F.col(f"a_lo_{s}") - F.col(f"b_hi_{s}") <= reach)
        pairs = pairs.join(x, "a").join(y, "b").where((F.col("a2") <= F.col("b2")) & near).select(F.col("a2").alias("a"), F.col("b2").alias("b"))
    return pairs


def compare_stretches(rows: DataFrame, order: list[str], size: int, compare: Callable[[pa.Table, pa.Table | None], pa.Table | Iterable[pa.Table]], schema: str, sides: list[str] | None = None, reach: float = 0.0, most: int = 0) -> DataFrame:
    """compare(rows of a, rows of b) for every pair of stretches of `size` rows that may be near, and compare(rows, None) for each
    stretch with itself; it returns a table, or tables one after the other. Up to `most` rows a stretch grows with the rows, so
    that there are about STRETCHES of them. sides: columns whose difference is no more than reach for rows that can be alike."""
    ordered, count = numbered(rows, *order)
    size = max(size, min(most, -(-count // STRETCHES)))
    ordered = ordered.withColumn("stretch", F.expr(f"number div {size}"))
    sides = sides or []
    boxes = ordered.groupBy("stretch").agg(F.count(F.lit(1)), *(f(s).alias(f"{e}_{s}") for s in sides for e, f in (("lo", F.min), ("hi", F.max))))
    boxes = save(boxes.select("stretch", *(f"{e}_{s}" for s in sides for e in ("lo", "hi"))), "boxes")
    pairs = save(near_stretches(boxes, -(-count // size), sides, reach), "stretches")
    # a pair of stretches is much work for few bytes, so Spark isn't left to put many into one task
    n = pairs.count()
    tasks = min(max(1, 2 * n), MOST_TASKS)
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("stretch"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        mine = pc.equal(group["stretch"], group["a"][0].as_py())
        a, b = group.filter(mine), group.filter(pc.invert(mine))
        found = compare(a, b if b.num_rows else None)
        for part in [found] if isinstance(found, pa.Table) else found:
            yield from part.to_batches()

    return ordered.join(F.broadcast(ends) if n <= FEW else ends, "stretch").repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(work, schema)
