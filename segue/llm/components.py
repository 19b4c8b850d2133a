"""Connected components of a graph that only tables hold: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.store import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(smallest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.unionByName(smallest.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node that is not its own root.

    ``edges`` has two columns ``a`` and ``b``.  Each round is a few equi-joins and a
    stored table; the number of rounds grows with the logarithm of the nodes.  Ends
    when a round changes nothing, i.e. all edges point straight to a root.
    """
    current = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                           F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))).alias("s")).first()
        if seen == mark or seen["n"] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        current = saved(_small_star(_large_star(current)))
