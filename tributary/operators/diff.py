"""Differences of two graphs, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import closure
from .graph import KEY, edge_flow


def node_diff(old: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    """(id, change) of added, removed and changed nodes; ``compared`` decides what a change is."""
    a = old.select("id", F.struct(*compared).alias("was"), F.lit(True).alias("__old"))
    b = new.select("id", F.struct(*compared).alias("now"), F.lit(True).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added and removed edges by key; both graphs are grouped at once, and keys with nulls are equal."""
    both = old.select(*KEY, F.lit(False).alias("__new")).unionByName(new.select(*KEY, F.lit(True).alias("__new")))
    sides = both.groupBy(*KEY).agg(F.min("__new").alias("all_new"), F.max("__new").alias("any_new")).where("all_new = any_new")
    return sides.select(*KEY, F.when(F.col("any_new"), "added").otherwise("removed").alias("change"))


def impact_seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, side) from a node diff and an edge diff: what to start from in the current and in the baseline graph."""
    n = nodes.select(F.col("id").alias("seed"), F.when(F.col("change") == "removed", "baseline").otherwise("current").alias("side"))
    e = edge_flow(edges).select(F.col("up").alias("seed"), F.when(F.col("change") == "removed", "baseline").otherwise("current").alias("side"))
    return n.unionByName(e).distinct()


def file_seeds(files: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(seed, side) of changed files (path): the current nodes of these files, and the baseline's that are gone.

    Nodes without a file (an empty name) are nobody's, and would all meet in one task.
    """
    paths = files.select(F.col("path").alias("source_file")).where("source_file <> ''")
    of = lambda nodes: nodes.where("source_file <> ''").select(F.col("id").alias("seed"), "source_file").join(paths, "source_file", "left_semi").select("seed")
    known = new.select(F.col("id").alias("seed"), F.lit("current").alias("side"))
    was = of(old).join(known, "seed", "left").select("seed", F.coalesce("side", F.lit("baseline")).alias("side"))
    return of(new).withColumn("side", F.lit("current")).unionByName(was).distinct()


def impact_map(seeds: DataFrame, old_flow: DataFrame, new_flow: DataFrame) -> DataFrame:
    """(seed, node): what each seed reaches downstream in its own graph; a seed of both gets the union.

    Both graphs are walked in one loop, their edges told apart by bits, so what they share is there once.
    """
    bit = lambda df, n, *c: df.select(*c, F.lit(n).alias("sides"))
    flow = bit(old_flow, 1, "up", "down").unionByName(bit(new_flow, 2, "up", "down"))
    roots = seeds.select(F.col("seed").alias("root"), F.when(F.col("side") == "baseline", 1).otherwise(2).alias("sides"))
    met = closure(flow, roots, sides=True)
    return met.select(F.col("root").alias("seed"), "node").where("seed <> node").distinct()


def stale_files(committed: DataFrame, fresh: DataFrame) -> DataFrame:
    """(path, state) of files that are missing, extra or different; inputs (path, sha)."""
    j = committed.withColumnRenamed("sha", "old").join(fresh.withColumnRenamed("sha", "new"), "path", "full_outer")
    state = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "orphaned").when(F.col("old") != F.col("new"), "changed")
    return j.select("path", state.alias("state")).where("state is not null")
