"""Connected components by alternating star joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that the edges lead to. Nodes without edges are left out.

    Large stars tie the larger neighbours of a node to its smallest one, small stars the smaller ones; both keep the components
    and end with a star around each root after about log(n) rounds. A hot node's rows are grouped by partial minima and
    rejoined by their own key; nothing is gathered per node."""
    now = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "cc")
    while True:
        large = _star(now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        both = save(_star(large, False), "cc")
        # done when every u has one v and no v is a u
        todo = both.groupBy("u").count().where("count > 1").select("u").unionByName(both.join(both.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")).isEmpty()
        same = todo
        drop(now)
        now = both
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): of each u, the neighbours v; large: both directions are there."""
    if large:
        least = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        out = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        tied = pairs.join(least, "u")
        out = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()
