"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_b")).select(
        F.col("a").alias("_a"), F.least("a", "_b").alias("_m"))
    return both.where("b > a").join(least, F.col("a") == F.col("_a")).select(
        F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_a")
    met = edges.join(least, F.col("a") == F.col("_a"))
    return met.select("a", F.col("_m").alias("b")).unionAll(
        met.where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge that is not its own root; the root of a component
    is its smallest node. Edges are (a, b) longs; loops, repeats and both directions are fine.

    Rounds are logarithmic in the number of nodes, also for long chains. Each writes its edges to
    the shared folder, which cuts the lineage, and two numbers tell whether it changed anything.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = stage(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = stage(_small_star(_large_star(now)), "edges")
