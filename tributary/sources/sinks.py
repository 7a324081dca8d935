"""Exports of the graph: rows ready for writing, and writers that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import csv_neutralize


def objects_export(nodes: DataFrame) -> DataFrame:
    """Columns of the object list; layer by the table's type, trust always empty."""
    kind = F.col("node_type")
    layer = F.when(kind.endswith("table"), F.split_part(kind, F.lit("_"), F.lit(1))).otherwise("")
    return nodes.select(*[csv_neutralize(c).alias(n) for n, c in (("id", F.col("id")), ("type", kind), ("schema", F.col("schema_name")), ("name", F.col("name")), ("layer", layer), ("source_file", F.col("source_file")))], F.lit("").alias("trust"))


def edges_export(edges: DataFrame) -> DataFrame:
    return edges.select(csv_neutralize(F.col("source_id")).alias("source"), csv_neutralize(F.col("target_id")).alias("target"), "edge_type", csv_neutralize(F.col("evidence")).alias("evidence"))


def columns_export(nodes: DataFrame) -> DataFrame:
    """One row for each column of nodes with ``columns array<struct<name, data_type, nullable, constraints>>``."""
    c = nodes.select(F.col("id").alias("object_id"), F.posexplode("columns").alias("pos", "c"))
    null = F.when(F.col("c.nullable").isNull(), "").otherwise(F.col("c.nullable").cast("string"))
    return c.select("object_id", csv_neutralize(F.col("c.name")).alias("column"), csv_neutralize(F.coalesce("c.data_type", F.lit(""))).alias("type"), null.alias("nullable"), F.array_join("c.constraints", ";").alias("constraints"))


def measures_export(measures: DataFrame, edges: DataFrame) -> DataFrame:
    """Measures (id, model, name, dax) and whether nothing references or shows them."""
    used = edges.where("edge_type in ('references', 'visualizes')").select(F.col("target_id").alias("id")).distinct().withColumn("__used", F.lit(True))
    unused = F.when(F.col("__used").isNull(), "True").otherwise("False")
    return measures.join(used, "id", "left").select(csv_neutralize(F.col("model")).alias("model"), csv_neutralize(F.col("name")).alias("measure"), csv_neutralize(F.coalesce("dax", F.lit(""))).alias("dax"), unused.alias("unused"))


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Sorted CSV with header; sorted ranges become files, in order, so no task holds all rows."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two folders of JSON lines with sorted keys, in order of id and of edge key."""
    sorted_struct = lambda df: F.to_json(F.struct(*sorted(df.columns))).alias("value")
    nodes.drop("source_code").repartitionByRange("id").sortWithinPartitions("id").select(sorted_struct(nodes.drop("source_code"))).write.mode("overwrite").text(f"{path}/nodes")
    key = ["source_id", "target_id", "edge_type"]
    edges.repartitionByRange(*key).sortWithinPartitions(*key).select(sorted_struct(edges)).write.mode("overwrite").text(f"{path}/edges")


def read_graph_json(spark, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(node_schema).json(f"{path}/nodes"), spark.read.schema(edge_schema).json(f"{path}/edges")


def canonical_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ord, value): the lines of the one graph file, nodes by id and edges by key, keys sorted, without source code.

    Lines are sorted by (part, ord); the commas stand at the beginning of all lines but the first of a part, so each line is
    made on its own.
    """
    row = lambda df: F.to_json(F.struct(*sorted(df.columns)))
    n = nodes.drop("source_code")
    key = F.concat_ws("\x1f", "source_id", "target_id", "edge_type")
    n_first, e_first = n.agg(F.min("id")).collect()[0][0], edges.agg(F.min(key)).collect()[0][0]
    comma = lambda at, first: F.when(at == F.lit(first), F.lit("")).otherwise(",")
    quoted = F.regexp_extract(F.to_json(F.struct("id")), r'^\{"id":(.*)\}$', 1)
    lines = n.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(comma(F.col("id"), n_first), quoted, F.lit(":"), row(n)).alias("value"))
    lines = lines.unionByName(edges.select(F.lit(3).alias("part"), key.alias("ord"), F.concat(comma(key, e_first), row(edges)).alias("value")))
    fixed = nodes.sparkSession.createDataFrame([(0, "", '{"nodes":{'), (2, "", '},"edges":['), (4, "", "]}")], "part int, ord string, value string")
    return lines.unionByName(fixed)


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Lines as text files whose names follow their order, so that joining the files gives the whole."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def read_canonical(spark, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file or folder as ``write_lines`` of ``canonical_json`` leaves it, line by line."""
    lines = spark.read.text(path)
    key = r'^,?"(?:[^"\\]++|\\.)*+":(?=\{)'  # possessive: keys of any length match without recursion
    node = lines.where(F.col("value").rlike(key))
    edge = lines.where(F.col("value").rlike(r"^,?\{") & ~F.col("value").startswith('{"nodes":{'))
    nodes = node.select(F.from_json(F.regexp_replace("value", key, ""), node_schema).alias("n")).select("n.*")
    edges = edge.select(F.from_json(F.regexp_replace("value", "^,", ""), edge_schema).alias("e")).select("e.*")
    return nodes, edges


def publish(write, path: str, spark, blocked: bool) -> bool:
    """Lets ``write(beside)`` make a new generation beside the old one and puts it in its place, unless it is blocked; a run
    that is blocked or fails leaves the old generation as it was."""
    if blocked:
        return False
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = place(path + ".new"), place(path + ".old")
    fs.delete(new, True)
    write(path + ".new")
    fs.delete(old, True)
    if fs.exists(place(path)) and not fs.rename(place(path), old):
        return False
    if not fs.rename(new, place(path)):
        fs.rename(old, place(path))
        return False
    fs.delete(old, True)
    return True
