"""Baseline graphs: what an earlier commit or file holds, in the layout of one JSON document."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id: string, node_type: string, name: string, schema_name: string, display_name: string, source_file: string>"
EDGE = "struct<source_id: string, target_id: string, edge_type: string, evidence: string>"
_GRAPH = f"nodes map<string, {NODE}>, edges array<{EDGE}>"


def graph_of(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents (value); the node's key stands for a missing id."""
    g = document.select(F.from_json("value", _GRAPH).alias("g"))
    n = g.select(F.explode("g.nodes").alias("key", "n")).select(F.coalesce("n.id", "key").alias("id"), *[f"n.{c}" for c in ("node_type", "name", "schema_name", "display_name", "source_file")])
    return n.na.fill("", ["schema_name", "display_name", "source_file"]), g.select(F.inline("g.edges"))


def from_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return graph_of(spark.read.text(path, wholetext=True))


def from_commit(spark: SparkSession, repository: str, commit: str, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph that a commit holds; plain git shows it, one file through the driver."""
    if commit.startswith("-"):
        raise ValueError(f"no commit: {commit}")
    shown = subprocess.run(["git", "-C", repository, "show", f"{commit}:{path}"], capture_output=True, check=True, timeout=60)
    return graph_of(spark.createDataFrame([(shown.stdout.decode("utf-8", "replace"),)], "value string"))
