"""Code hierarchies as edge tables (J13-J16, G37, G38). Dimensions are joined by key; Spark broadcasts them while they are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(child: DataFrame, parent: DataFrame, child_key: Column, parent_key: Column, child_id: Column, parent_id: Column, kind: str) -> DataFrame:
    """Distinct (src, dst, type) for the pairs with equal keys."""
    c = child.select(child_key.cast("string").alias("k"), child_id.cast("string").alias("src")).where("k IS NOT NULL")
    p = parent.select(parent_key.cast("string").alias("k"), parent_id.cast("string").alias("dst"))
    return c.join(p, "k").select("src", "dst", F.lit(kind).alias("type")).distinct()


def chain(levels: list[DataFrame]) -> DataFrame:
    """Paths over edge tables, one per level: the dst of a level is the src of the next."""
    got = levels[0].select(F.col("src").alias("n0"), F.col("dst").alias("n1"))
    for k, level in enumerate(levels[1:], 1):
        got = got.join(level.select(F.col("src").alias(f"n{k}"), F.col("dst").alias(f"n{k + 1}")), f"n{k}")
    return got


def orphans(nodes: DataFrame, edge: DataFrame, node: str) -> DataFrame:
    return nodes.select(F.col(node).cast("string").alias("src")).distinct().join(edge.select("src"), "src", "left_anti")


def edge_counts(edge: DataFrame) -> DataFrame:
    return edge.groupBy("type").agg(F.count("*").alias("n"))


def edge_coverage(facts: DataFrame, edge: DataFrame, fact: str) -> DataFrame:
    """Percent of the distinct facts with an edge of each type."""
    all_facts = facts.agg(F.count_distinct(fact).alias("facts"))
    return edge.groupBy("type").agg(F.count_distinct("src").alias("linked")).crossJoin(F.broadcast(all_facts)).withColumn("percent", 100.0 * F.col("linked") / F.col("facts"))
