"""Queries of links inside models and of the rows behind object pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, linking, pages
from ..sources import estate
from .queries import _DECISIONS, _ITEMS_SQL, _decisions, _items, query
from .session import table


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_flow(estate.edges(spark, sf_dir))


_SRC = "SELECT p_partkey AS table_id, p_brand AS model, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN 'Brand#' || CAST(p_size AS VARCHAR) ELSE 'none' END AS upstream FROM part"


@query(f"WITH s AS ({_SRC}) SELECT table_id, upstream, upstream <> model AND upstream IN (SELECT p_brand FROM part) AS linked FROM s", False)
def composite_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    up = F.when(k == 0, F.col("p_brand")).when(k == 1, F.concat(F.lit("Brand#"), F.col("p_size").cast("string"))).otherwise("none")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_brand").alias("model"), up.alias("upstream"))
    links, left = pages.composite_links(p, p.select("model"))
    return links.withColumn("linked", F.lit(True)).unionByName(left.withColumn("linked", F.lit(False)))


@query(
    """WITH r AS (SELECT DISTINCT l_orderkey AS source_id, l_returnflag AS model, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 't' || CAST(l_suppkey % 5 AS VARCHAR) END AS table_name, 'm' || CAST(l_partkey AS VARCHAR) AS name FROM lineitem),
m AS (SELECT p_partkey AS id, f AS model, 't' || CAST(p_partkey % 5 AS VARCHAR) AS table_name, 'm' || CAST(p_partkey AS VARCHAR) AS name FROM part, (SELECT unnest(['A', 'N', 'R']) AS f)),
c AS (SELECT DISTINCT f AS model, 't' || CAST(p_partkey % 5 AS VARCHAR) AS table_name, 'm' || CAST(p_partkey AS VARCHAR) AS name FROM part, (SELECT unnest(['A', 'N', 'R']) AS f) WHERE p_partkey % 4 = 0)
SELECT DISTINCT source_id, target_id FROM (
 SELECT r.source_id, m.id AS target_id FROM r JOIN m ON m.model = r.model AND m.name = r.name WHERE r.table_name = ''
 UNION ALL SELECT r.source_id, m.id FROM r JOIN m ON m.model = r.model AND m.name = r.name AND m.table_name = r.table_name ANTI JOIN c ON c.model = r.model AND c.table_name = r.table_name AND c.name = r.name WHERE r.table_name <> '') WHERE source_id <> target_id""",
    False,
)
def measure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    refs = li.selectExpr("l_orderkey as source_id", "l_returnflag as model", "case when l_linenumber % 2 = 0 then '' else concat('t', cast(l_suppkey % 5 as string)) end as table_name", "concat('m', cast(l_partkey as string)) as name")
    every = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("model"))
    measures = every.selectExpr("p_partkey as id", "model", "concat('t', cast(p_partkey % 5 as string)) as table_name", "concat('m', cast(p_partkey as string)) as name")
    return pages.measure_links(refs, measures, measures.where("id % 4 = 0"))


@query(
    """, b AS (SELECT down AS node, 'up' AS side, up AS neighbour, edge_type, evidence, ord FROM f UNION ALL SELECT up, 'down', down, edge_type, evidence, ord FROM f)
SELECT node, side, neighbour, edge_type, evidence FROM b QUALIFY row_number() OVER (PARTITION BY node, side, neighbour ORDER BY ord, edge_type, evidence) = 1"""
)
def lineage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.lineage_table(_flow(spark, sf_dir))


@query(
    """, r AS (SELECT id AS root FROM n WHERE id LIKE 'orders:%'),
a AS (SELECT r.root, f.up AS node, 1 AS depth, r.root AS parent FROM r JOIN f ON f.down = r.root),
b AS (SELECT a.root, f.up AS node, 2 AS depth, min(a.node) AS parent FROM a JOIN f ON f.down = a.node GROUP BY 1, 2),
d AS (SELECT b.root, f.up AS node, 3 AS depth, min(b.node) AS parent FROM b JOIN f ON f.down = b.node GROUP BY 1, 2)
SELECT DISTINCT * FROM a UNION SELECT * FROM b UNION SELECT * FROM d"""
)
def upstream_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, customer, nation, region: each node under the one that is a step nearer to the order."""
    roots = estate.nodes(spark, sf_dir).where("id like 'orders:%'").select(F.col("id").alias("root"))
    return pages.ancestry(_flow(spark, sf_dir), roots)


@query("SELECT DISTINCT 'nation:' || CAST(c_nationkey AS VARCHAR) AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 11 = 0 UNION SELECT DISTINCT 'region:' || CAST(n_regionkey AS VARCHAR) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 11 = 0", False)
def wants_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.feeds_a_model(_flow(spark, sf_dir), estate.nodes(spark, sf_dir), ["bronze_table"], ["view"])


@query("SELECT s_nationkey AS table_id, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS single FROM (SELECT s_nationkey, 'src' || CAST(s_suppkey % 3 AS VARCHAR) AS s FROM supplier) GROUP BY 1", False)
def partition_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.partition_sources(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("table_id"), F.concat(F.lit("src"), (F.col("s_suppkey") % 3).cast("string")).alias("source")))


@query(
    """, p AS (SELECT 'gold:' || id AS id, schema_name, CASE WHEN key % 13 = 0 THEN 'same' ELSE name END AS name, source_file FROM n WHERE key % 2 = 0 AND id LIKE 'part:%'), w AS (SELECT CASE WHEN key % 3 = 0 THEN 'gold:' ELSE 'silver:' END || id AS id, schema_name, CASE WHEN key % 13 = 0 THEN 'same' ELSE name END AS name, source_file FROM n WHERE id LIKE 'part:%')
SELECT old_id, w.id AS new_id FROM w JOIN (SELECT schema_name, name, source_file, min(id) AS old_id FROM p GROUP BY 1, 2, 3 HAVING count(*) = 1) o ON o.schema_name = w.schema_name AND o.name = w.name AND o.source_file = w.source_file WHERE w.id NOT IN (SELECT id FROM p)"""
)
def intent_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = estate.nodes(spark, sf_dir).where("id like 'part:%'").withColumn("name", F.expr("case when key % 13 = 0 then 'same' else name end"))
    prior = n.where("key % 2 = 0").withColumn("id", F.concat(F.lit("gold:"), "id"))
    return pages.intent_moves(prior, n.withColumn("id", F.concat(F.when(F.col("key") % 3 == 0, "gold:").otherwise("silver:"), "id")))


@query(f"WITH d AS ({_DECISIONS}), i AS ({_ITEMS_SQL}) SELECT d.key || '#s' AS key FROM d WHERE d.key IN (SELECT key FROM i) AND d.key || '#s' NOT IN (SELECT key FROM i)", False)
def unmatched_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir).withColumn("key", F.concat("key", F.lit("#s")))
    items = _items(spark, sf_dir)
    return linking.unmatched_decisions(d, items, items.select(F.col("key").alias("id"))).select("key")


@query("SELECT o_orderkey AS path, o_orderstatus AS object FROM orders WHERE (o_orderkey, o_orderstatus) NOT IN (SELECT (l_orderkey, l_linestatus) FROM lineitem)", False)
def undeclared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("object"))
    return pages.undeclared(files, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linestatus").alias("object")))


@query("SELECT p_partkey, p_name || '+' || p_brand AS name FROM part", False)
def percent_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(F.replace(F.concat("p_name", F.lit("+"), "p_brand"), F.lit("#"), F.lit("%23")), F.lit(" "), F.lit("%20"))
    return table(spark, sf_dir, "part").select("p_partkey", pages.percent_decoded(raw).alias("name"))


@query("SELECT DISTINCT split_part(url, '/', 3) AS folder FROM pages", False)
def top_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select(pages.top_folders(path).alias("folder")).where("folder is not null").distinct()
