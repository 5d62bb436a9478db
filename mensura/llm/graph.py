"""Connected components of a graph that is a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges (a, b: long).

    Alternates large-star and small-star steps (each node's neighbours are linked to its smallest one), which
    need O(log^2 n) rounds for any shape (more than MAX_ROUNDS are an error).  No step emits more rows than there are
    edges, and each is stored in the shared checkpoint folder.  Smallest neighbours are partial minima first; the joins
    that bring them back are sort-merge joins, whose partition of a large star's centre Spark splits (adaptive skew join)."""
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("b", "a"))).first())

    links = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(links)
    for _ in range(MAX_ROUNDS):
        around = _both_ways(links)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = stored(small.filter("a != b"))
        links, last, before = after, before, mark(after)
        if last == before:  # a step changed nothing: every link goes from a leaf straight to a smallest node
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(after.select(F.col("b"), F.col("b")).distinct())
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
