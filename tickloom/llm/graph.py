"""Connected components by alternating stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node with an edge to another one; root is the smallest node reachable.

    Every round hangs each node's neighbours on its smallest neighbour (first the larger ones, then the smaller ones), which
    needs O(log^2 n) rounds also for long chains. Minima are combined before the shuffle, and the joins back are plain
    sort-merge joins, whose hot partitions (a node that a third of all edges touch) Spark splits. Each round is a table in the
    shared folder, so lineage stays short. Edges with a null end, loops and repeated edges count for nothing.
    """
    x, y = F.col(a), F.col(b)
    now = stored(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state["n"] == 0 or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v"), F.col("v")).distinct())
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least).distinct(), "edges")
