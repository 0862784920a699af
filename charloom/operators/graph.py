"""Connected components by alternating star joins; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charloom.functions.shared import drop, save


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node that the edges lead to; nodes of any ordered type. Nodes without edges are left out.

    A round ties the greater neighbours of each node to its least one, then the lesser ones among themselves; both keep the
    components and leave a star around each root after about log(n) rounds. A node's rows are summed up before they are shuffled;
    nothing is gathered per node."""
    now = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "stars")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = save(small.where("u > v").distinct(), "stars")
        # stars: every u has one v, and no v is a u
        open_ = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u").unionByName(after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u"))
        done = open_.isEmpty()
        drop(now)
        now = after
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
