"""Connected components by alternating large and small stars, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cut


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a vertex to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the least of them (edges have a < b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    near = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return near.unionByName(own).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least vertex of the component of every vertex in ``edges`` (a, b).

    The work of a round is in proportion to the edges; the number of rounds
    grows with the logarithm of the longest path.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        after = cut(small_star(large_star(now)))
        new = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        now, mark = after, new
    return after.select(F.col("b").alias("id"), F.col("a").alias("root"))
