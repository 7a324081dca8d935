"""Dependency lists of a database catalog: which object references which, checked against the lineage that was parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_identifier
from ..operators.layering import SYSTEM_SCHEMAS

VERSION = 1
_SIDE = "struct<`schema`: string, name: string, type: string, database: string, server: string>"
_DOC = f"version int, dependencies array<struct<object: {_SIDE}, references: {_SIDE}>>"


def read_dependencies(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries, warnings) of list files: entries (list, object, references); a file of another shape or version only warns."""
    docs = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("list"), F.from_json("value", _DOC).alias("d"))
    good = (F.col("d.version") == VERSION) & F.col("d.dependencies").isNotNull()
    entries = docs.where(good).select("list", F.inline("d.dependencies")).where("object.name <> '' and references.name <> ''")
    bad = docs.where(~F.coalesce(good, F.lit(False))).select(F.col("list").alias("file"), F.lit("no dependency list of a known version").alias("message"), F.lit("catalog_dependencies_unreadable").alias("category"))
    return entries, bad


def _schema(side: str) -> Column:
    """The schema of a side, in front of it its database and server where they are named."""
    parts = F.filter(F.array(*[normalize_identifier(F.col(f"{side}.{c}")) for c in ("server", "database", "schema")]), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(parts, ".")


def in_scope(schema: Column, ignored: list[str], included: list[str]) -> Column:
    """Whether a schema is neither a system's nor ignored and, where some are listed, one of these."""
    out = [x.lower() for x in [*SYSTEM_SCHEMAS, *ignored]]
    last = F.element_at(F.split(schema, r"\."), -1)
    good = ~(schema.isin(out) | last.isin(out) | last.startswith("db_"))
    wanted = [x.lower() for x in included]
    return good & (schema.isin(wanted) | last.isin(wanted)) if wanted else good


def catalog_gaps(entries: DataFrame, nodes: DataFrame, edges: DataFrame, ignored: list[str] = (), included: list[str] = ()) -> DataFrame:
    """(node_id, reference) of listed references that no edge, in either direction, joins to a documented object.

    Sequences and temporary names carry no lineage; a reference out of scope is skipped, as is an object that is not
    documented. A reference without a schema is met by any object of its name.
    """
    e = entries.where("coalesce(references.type, '') not ilike '%sequence%' and references.name not like '#%' and references.name not like '@%'")
    e = e.select(F.coalesce(F.nullif(_schema("object"), F.lit("")), F.lit("dbo")).alias("o_schema"), normalize_identifier(F.col("object.name")).alias("o_name"), _schema("references").alias("r_schema"), normalize_identifier(F.col("references.name")).alias("r_name"))
    e = e.where((F.col("r_schema") == "") | in_scope(F.col("r_schema"), list(ignored), list(included)))
    n = nodes.select("id", F.lower("schema_name").alias("s"), F.lower("name").alias("n"))
    of = e.join(n.select(F.col("id").alias("node_id"), F.col("s").alias("o_schema"), F.col("n").alias("o_name")), ["o_schema", "o_name"]).select("node_id", "r_schema", "r_name").distinct()
    full = of.where("r_schema <> ''").join(n.select(F.col("id").alias("target"), F.col("s").alias("r_schema"), F.col("n").alias("r_name")), ["r_schema", "r_name"])
    bare = of.where("r_schema = ''").join(n.select(F.col("id").alias("target"), F.col("n").alias("r_name")), "r_name")
    pair = lambda a, b: [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]
    have = edges.select(*pair("source_id", "target_id")).distinct()
    linked = full.select("node_id", "r_schema", "r_name", *pair("node_id", "target")).unionByName(bare.select("node_id", "r_schema", "r_name", *pair("node_id", "target"))).join(have, ["x", "y"], "left_semi")
    open_ = of.join(linked.select("node_id", "r_schema", "r_name").distinct(), ["node_id", "r_schema", "r_name"], "left_anti")
    return open_.select("node_id", F.when(F.col("r_schema") != "", F.concat_ws(".", "r_schema", "r_name")).otherwise(F.col("r_name")).alias("reference"))
