"""Schema pruning and the assignment of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import glob_regex

# Schemas that belong to the database system, and the node types that have schemas.
SYSTEM_SCHEMAS = ["sys", "information_schema", "tempdb", "guest"]
SQL_TYPES = ["bronze_table", "silver_table", "gold_table", "view", "stored_proc"]
LAYERS = ["gold", "silver", "bronze"]


def pruned(ignore: list[str] = (), include: list[str] = ()) -> Column:
    """Whether a node falls to the schema filter."""
    s = F.lower("schema_name")
    last = F.element_at(F.split(s, "\\."), -1)
    bad = [x.lower() for x in [*SYSTEM_SCHEMAS, *ignore]]
    drop = s.isin(bad) | last.isin(bad) | last.startswith("db_")
    if include:
        good = [x.lower() for x in include]
        stub = (F.col("source_file") == "") & s.contains(".")
        drop |= ~s.isin(good) & (~last.isin(good) | stub)
    return F.col("node_type").isin(SQL_TYPES) & (s != "") & drop


def prune_schemas(nodes: DataFrame, edges: DataFrame, ignore: list[str] = (), include: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass the filter, and the edges that touch no dropped node."""
    nodes = nodes.withColumn("__drop", pruned(ignore, include))
    gone = nodes.where("__drop").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.where("not __drop").drop("__drop"), kept.select(*edges.columns)


def layer_rule(rules: dict[str, dict[str, list[str]]]) -> Column:
    """The first of gold, silver, bronze whose schemas or path globs fit the node; null if none does."""
    out = F.lit(None).cast("string")
    for layer in reversed(LAYERS):
        r = rules.get(layer, {})
        fit = (F.col("schema_name") != "") & F.lower("schema_name").isin([s.lower() for s in r.get("schemas", [])])
        for g in r.get("paths", []):
            fit |= F.col("source_file").rlike(glob_regex(g))
        out = F.when(fit, F.lit(layer)).otherwise(out)
    return out


def layer_heuristic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Gold tables that no rule claimed, that nothing writes or defines and that no file declares: (id)."""
    written = edges.where("edge_type in ('writes', 'defines')").select(F.col("target_id").alias("id"))
    loose = nodes.where("layer is null and node_type = 'gold_table' and source_file = ''")
    return loose.join(written, "id", "left_anti").select("id")


def unclassified(nodes: DataFrame, heuristic: DataFrame, any_rule: bool) -> DataFrame:
    """Info rows for tables (id) that only the heuristic gave a layer, where layer rules are configured at all."""
    w = nodes.join(heuristic.select("id"), "id", "left_semi")
    return w.where(F.lit(any_rule)).select(F.col("id").alias("file"), F.lit("no layer rule fits this table").alias("message"), F.lit("layer_unclassified").alias("category"))
