"""Connected components of an edge table, in rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for all ends of edges; component is the smallest node reachable.

    Alternates the "large star" and "small star" steps, which keep the set of
    components and end with a star around each smallest node, after about
    log(nodes) rounds. A node's neighbours are never gathered: each step is a
    minimum by node and a join, so hubs are pre-aggregated and their join can be
    split. Each round is written to the shared folder.
    """
    now = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        after = stage(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        # done when every node has one edge and no centre has an edge of its own
        loose = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = after.select("a").join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        now = after
        if loose.union(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
