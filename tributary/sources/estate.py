"""A lineage graph over the driver's star schema: every graph operator runs on it at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import table


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _edge(source: Column, target: Column, kind: str, evidence: Column, order: Column) -> list[Column]:
    return [source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("edge_type"), evidence.alias("evidence"), order.cast("bigint").alias("ord")]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored edges, directions mixed, keys repeated, some evidence empty."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("nation").select(*_edge(_id("nation", "n_nationkey"), _id("region", "n_regionkey"), "reads", F.col("n_name"), F.col("n_nationkey")))
        .unionByName(t("customer").select(*_edge(_id("nation", "c_nationkey"), _id("customer", "c_custkey"), "feeds", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")), F.col("c_custkey"))))
        .unionByName(t("orders").select(*_edge(_id("orders", "o_orderkey"), _id("customer", "o_custkey"), "references", F.col("o_orderpriority"), F.col("o_orderkey"))))
        .unionByName(t("lineitem").select(*_edge(_id("part", "l_partkey"), _id("supplier", "l_suppkey"), "writes", F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_returnflag")), F.col("l_orderkey") * 10 + F.col("l_linenumber"))))
    )


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with edges back from some orders to a nation, and some edges of a part to itself."""
    back = table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0")
    back = back.select(*_edge(_id("orders", "o_orderkey"), F.concat(F.lit("nation:"), (F.col("o_custkey") % 25).cast("string")), "feeds", F.lit(""), F.col("o_orderkey")))
    own = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(*_edge(_id("part", "p_partkey"), _id("part", "p_partkey"), "references", F.lit("self"), F.col("p_partkey")))
    return edges(spark, sf_dir).unionByName(back).unionByName(own)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each key of each table; every seventh has no file, every eleventh of the orders is a view."""

    def rows(name: str, key: str, kind: Column, schema: Column, label: Column) -> DataFrame:
        k = F.col(key)
        return table(spark, sf_dir, name).select(
            _id(name, key).alias("id"), kind.alias("node_type"), label.alias("name"), schema.alias("schema_name"),
            F.when(k % 5 == 0, F.upper(label)).otherwise("").alias("display_name"),
            F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(f"repo/{name}/"), k.cast("string"), F.lit(".sql"))).alias("source_file"),
            k.cast("bigint").alias("key"),
        )

    bronze, silver = F.lit("bronze_table"), F.lit("silver_table")
    named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    return (
        rows("region", "r_regionkey", bronze, F.lit("raw"), F.col("r_name"))
        .unionByName(rows("nation", "n_nationkey", bronze, F.lit("raw"), F.col("n_name")))
        .unionByName(rows("customer", "c_custkey", silver, F.lower("c_mktsegment"), F.col("c_name")))
        .unionByName(rows("supplier", "s_suppkey", silver, F.lit("db_supply"), F.col("s_name")))
        .unionByName(rows("part", "p_partkey", silver, F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))), named("Part", "p_partkey")))
        .unionByName(rows("orders", "o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "view").otherwise("gold_table"), F.concat(F.lit("ext."), F.lower("o_orderstatus")), named("Order", "o_orderkey")))
    )


# The same definitions for the checking engine.
EDGES_SQL = """
SELECT concat('nation:', CAST(n_nationkey AS VARCHAR)) AS source_id, concat('region:', CAST(n_regionkey AS VARCHAR)) AS target_id, 'reads' AS edge_type, n_name AS evidence, CAST(n_nationkey AS BIGINT) AS ord FROM nation
UNION ALL SELECT concat('nation:', CAST(c_nationkey AS VARCHAR)), concat('customer:', CAST(c_custkey AS VARCHAR)), 'feeds', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, c_custkey FROM customer
UNION ALL SELECT concat('orders:', CAST(o_orderkey AS VARCHAR)), concat('customer:', CAST(o_custkey AS VARCHAR)), 'references', o_orderpriority, o_orderkey FROM orders
UNION ALL SELECT concat('part:', CAST(l_partkey AS VARCHAR)), concat('supplier:', CAST(l_suppkey AS VARCHAR)), 'writes', CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END, l_orderkey * 10 + l_linenumber FROM lineitem
"""
CYCLIC_SQL = f"""{EDGES_SQL}
UNION ALL SELECT concat('orders:', CAST(o_orderkey AS VARCHAR)), concat('nation:', CAST(o_custkey % 25 AS VARCHAR)), 'feeds', '', o_orderkey FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT concat('part:', CAST(p_partkey AS VARCHAR)), concat('part:', CAST(p_partkey AS VARCHAR)), 'references', 'self', p_partkey FROM part WHERE p_partkey % 50 = 0
"""


def _node_sql(name: str, key: str, kind: str, schema: str, label: str) -> str:
    return f"""SELECT concat('{name}:', CAST({key} AS VARCHAR)) AS id, {kind} AS node_type, {label} AS name, {schema} AS schema_name, CASE WHEN {key} % 5 = 0 THEN upper({label}) ELSE '' END AS display_name,
CASE WHEN {key} % 7 = 0 THEN '' ELSE concat('repo/{name}/', CAST({key} AS VARCHAR), '.sql') END AS source_file, CAST({key} AS BIGINT) AS key FROM {name}"""


NODES_SQL = "\nUNION ALL ".join(
    [
        _node_sql("region", "r_regionkey", "'bronze_table'", "'raw'", "r_name"),
        _node_sql("nation", "n_nationkey", "'bronze_table'", "'raw'", "n_name"),
        _node_sql("customer", "c_custkey", "'silver_table'", "lower(c_mktsegment)", "c_name"),
        _node_sql("supplier", "s_suppkey", "'silver_table'", "'db_supply'", "s_name"),
        _node_sql("part", "p_partkey", "'silver_table'", "lower(replace(p_brand, '#', '_'))", "concat('Part', CAST(p_partkey AS VARCHAR))"),
        _node_sql("orders", "o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN 'view' ELSE 'gold_table' END", "concat('ext.', lower(o_orderstatus))", "concat('Order', CAST(o_orderkey AS VARCHAR))"),
    ]
)
FLOW_SQL = "SELECT CASE WHEN edge_type IN ('reads','references','visualizes') THEN target_id ELSE source_id END AS up, CASE WHEN edge_type IN ('reads','references','visualizes') THEN source_id ELSE target_id END AS down, edge_type, evidence, ord"
