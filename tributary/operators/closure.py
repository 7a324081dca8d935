"""Reachability over the flow of the graph: level by level, many roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Laid, laid


def closure(flow: DataFrame, roots: DataFrame, direction: str = "down", depth: int | None = None, parents: bool = False, sides: bool = False) -> DataFrame:
    """(root, node, depth): what each root reaches, with the least number of steps; the root itself is left out. With
    ``parents`` also the least node one step nearer to the root from which each node was met (parent).

    ``flow`` has the columns up and down, ``roots`` the column root. Cycles end, since a round keeps only nodes that its
    root has not met. With ``sides`` both also have a whole number ``sides``, whose bits are graphs: a root walks all its graphs
    at once, and a node that it meets in several at different depths has a row, with the new bits, for each.

    Steps are laid by where they begin and what was met by root and node, so a round moves its front and what that meets
    once each, however much was met before, and writes what is new.
    """
    here, there = ("up", "down") if direction == "down" else ("down", "up")
    bits = ["sides"] if sides else []
    either = lambda df: df.groupBy("here", "node").agg(F.bit_or("sides").alias("sides"))
    steps = laid(flow.select(F.col(here).alias("here"), F.col(there).alias("node"), *bits), "here", **({"once": either} if sides else {}))
    met = Laid(flow.sparkSession, "root", "node")
    first = roots.groupBy("root").agg(F.bit_or("sides").alias("sides")) if sides else roots.select("root").distinct()
    kind = steps.schema["node"].dataType
    begin = first.select("root", F.col("root").cast(kind).alias("node"), F.lit(0).alias("depth"), *([F.lit(None).cast(kind).alias("parent")] if parents else []), *bits)
    met.add(met.deal(begin))
    level = 0
    while (depth is None or level < depth) and not met.rows().where(F.col("depth") == level).isEmpty():
        at = met.rows().where(F.col("depth") == level).select("root", F.col("node").alias("here"), *([F.col("sides").alias("of")] if sides else []))
        new = at.join(steps.hint("merge"), "here")
        known = met.rows().select("root", "node", *bits)
        level += 1
        # the front is all that lies one step nearer, so what led here is there already
        if parents:
            new = new.groupBy("root", "node").agg(F.min("here").alias("parent"))
        elif sides:
            new = new.where("sides & of <> 0").groupBy("root", "node").agg(F.bit_or(F.expr("sides & of")).alias("sides"))
            known = known.groupBy("root", "node").agg(F.bit_or("sides").alias("of"))
        else:
            new = new.select("root", "node").distinct()
        if sides:
            new = new.join(known.hint("merge"), ["root", "node"], "left").withColumn("sides", F.expr("sides & ~coalesce(of, 0)")).where("sides <> 0")
        else:
            new = new.join(known.hint("merge"), ["root", "node"], "left_anti")
        met.add(new.select("root", "node", F.lit(level).alias("depth"), *(["parent"] if parents else []), *bits))
    return met.done().where("depth > 0")


def multi_source(flow: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) of everything downstream of each seed."""
    return closure(flow, seeds.select(F.col("seed").alias("root"))).select(F.col("root").alias("seed"), "node")


def column_trace(columns: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, depth) over column-level lineage (node_id, col, src_id, src_col); nodes are ``id.column``."""
    step = columns.select(F.concat_ws(".", "src_id", "src_col").alias("up"), F.concat_ws(".", "node_id", "col").alias("down"))
    return closure(step, roots, "up", depth)


def sources_union(lineage: DataFrame) -> DataFrame:
    """(node_id, col, sources): the sorted set of what all writers of a column read for it; lineage (node_id, col, source)."""
    return lineage.groupBy("node_id", "col").agg(F.array_sort(F.collect_set("source")).alias("sources"))
