"""Keyed merges and key rewrites of the lineage graph, as aggregates and joins.

``nodes`` have a key ``id``, ``edges`` the key (source_id, target_id, edge_type). Contributions carry ``ord``; every
"first wins" is a minimum by ``ord`` and every "last wins" a maximum, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import flow
from ..plans.session import spread

KEY = ["source_id", "target_id", "edge_type"]


def edge_flow(edges: DataFrame) -> DataFrame:
    """Edges with their ends ``up`` and ``down`` in the direction of the data."""
    up, down = flow(F.col("edge_type"), F.col("source_id"), F.col("target_id"))
    return edges.select(up.alias("up"), down.alias("down"), *[c for c in edges.columns if c not in ("source_id", "target_id")])


def first_filled(c: str, order: str = "ord") -> Column:
    """The first non-empty value by ``order``; empty if there is none."""
    filled = F.when(F.col(c) != "", F.col(order))
    return F.coalesce(F.min_by(c, filled), F.lit("")).alias(c)


def edge_dedup(edges: DataFrame) -> DataFrame:
    """One edge for each key, with its first non-empty evidence."""
    return edges.groupBy(*KEY).agg(first_filled("evidence"))


def drop_self_edges(edges: DataFrame) -> DataFrame:
    return edges.where("source_id <> target_id")


def node_merge(contributions: DataFrame, scalars: list[str]) -> DataFrame:
    """One node for each id; each scalar is its first non-empty value."""
    return contributions.groupBy("id").agg(*[first_filled(c) for c in scalars])


def column_merge(columns: DataFrame) -> DataFrame:
    """Columns of each node united by their lower-cased name: the first spelling and type win, first-seen order stays. Of
    columns with the same ``ord`` the lesser (name, type) comes first."""
    first = columns.groupBy("node_id", F.lower("name").alias("key")).agg(F.min(F.struct("ord", "name", "data_type")).alias("c"))
    return first.groupBy("node_id").agg(F.array_sort(F.collect_list("c")).alias("columns"))


def last_wins(rows: DataFrame, keys: list[str], values: list[str], order: str = "ord") -> DataFrame:
    """One row for each key, the latest one's values."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")


def rename_ends(edges: DataFrame, renamed: DataFrame) -> DataFrame:
    """Edges with both ends moved by (old, new), deduplicated again, self-edges dropped."""
    left = renamed.select(F.col("old").alias("source_id"), F.col("new").alias("new_source"))
    right = renamed.select(F.col("old").alias("target_id"), F.col("new").alias("new_target"))
    moved = edges.join(left, "source_id", "left").join(right, "target_id", "left")
    moved = moved.withColumns({"source_id": F.coalesce("new_source", "source_id"), "target_id": F.coalesce("new_target", "target_id")})
    return drop_self_edges(edge_dedup(moved.select(*edges.columns)))


def stub_redirects(nodes: DataFrame) -> DataFrame:
    """(old, new): gold-table stubs without a file whose qualified name is a view's."""
    stubs = nodes.where("node_type = 'gold_table' and source_file = ''").select(F.col("id").alias("old"), "schema_name", F.lower("name").alias("name"))
    views = nodes.where("node_type = 'view'").groupBy("schema_name", F.lower("name").alias("name")).agg(F.min("id").alias("new"))
    return stubs.join(views.hint("merge"), ["schema_name", "name"]).select("old", "new")


def retype(nodes: DataFrame, new_ids: DataFrame, scalars: list[str]) -> DataFrame:
    """Nodes with ids changed by (old, new); where ids collide, the node that had the id wins, then the lesser old id."""
    n = nodes.join(new_ids.withColumnRenamed("old", "id"), "id", "left")
    rank = F.struct(F.when(F.col("new").isNull() | (F.col("new") == F.col("id")), 0).otherwise(1).alias("moved"), F.col("id").alias("old"))
    return node_merge(n.select(F.coalesce("new", "id").alias("id"), rank.alias("ord"), *scalars), scalars)


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with these ids and the edges with both ends among them."""
    keep = ids.select(F.col("id")).distinct()
    inside = edges
    for end in ("source_id", "target_id"):
        # no semi join, which would move below the parts that the edges are spread to
        inside = spread(inside, end).join(keep.withColumnRenamed("id", end).hint("merge"), end)
    return nodes.join(keep, "id", "left_semi"), inside.select(*edges.columns)


def collapse(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges of children moved up to their top ancestor by (child, parent); links between child and parent vanish."""
    top = parents.join(parents.select(F.col("child").alias("parent"), F.col("parent").alias("grand")), "parent", "left")
    return rename_ends(edges, top.select(F.col("child").alias("old"), F.coalesce("grand", "parent").alias("new")))


def metadata_merge(entries: DataFrame) -> DataFrame:
    """(id, key, value) of metadata entries (id, key, value, ord): the first contribution that has a key gives its value."""
    return entries.groupBy("id", "key").agg(F.min_by("value", "ord").alias("value"))


def rewrite_columns(lineage: DataFrame, renamed: DataFrame) -> DataFrame:
    """Column lineage (…, table_id, …) with its tables moved by (old, new), each row once."""
    moved = lineage.join(renamed.select(F.col("old").alias("table_id"), F.col("new").alias("__new")), "table_id", "left")
    return moved.withColumn("table_id", F.coalesce("__new", "table_id")).select(*lineage.columns).distinct()
