"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _largest(both: DataFrame, total: int) -> DataFrame:
    """Neighbours above a node move to its smallest neighbour, or to the node itself."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return common.hot_join(both, least, ["u"], "n", total).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _smallest(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = common.hot_join(edges, least, ["u"], "n", total).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of its component, for every node of an edge between different nodes.

    Edges may repeat, and have either direction; loops and edges with a null are ignored. Each round writes its edges to the shared folder. The number of rounds grows as the
    logarithm of the longest chain; RuntimeError after `rounds`. Hot centres are joined by broadcast of at most 1,000 of them (hot_join).
    """
    now = common.checkpoint(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") != F.col("b")).distinct()
    )
    for _ in range(rounds):
        total = now.count()
        if not total:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = common.checkpoint(_largest(both, 2 * total).filter("a <> b").distinct())
        small = common.checkpoint(_smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")), large.count()).filter("a <> b").distinct())
        # A fixpoint is a set of stars: each node has one smaller neighbour, and no centre has any.
        if small.count() == total and small.exceptAll(now).isEmpty():
            nodes = small.unionByName(small.select(F.col("b").alias("a"), "b")).distinct()
            return nodes.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = small
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
