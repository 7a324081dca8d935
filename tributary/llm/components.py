"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, root) of every node of the edges (a, b): root is the component's least id.

    Each round hangs neighbours onto the least node around (a grouped minimum, summed up in each task first, and a join
    back); rounds end when nothing moves. Only a count and a checksum of a round come to the driver.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of a node moves to the least node around it
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: every smaller neighbour of a node, and the node, move to the least of them
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(small, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = cut(moved.union(small.select(F.col("m").alias("a"), "b")).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return stars.union(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
