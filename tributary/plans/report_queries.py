"""Queries of the report side: bindings, usage, diagnostics, coverage and the estate map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bindings, graph, quality, statements
from ..sources import estate, models
from .queries import query
from .session import dealt, table

# Orders are reports (their id modulo 500), lines are visuals, and a part's name is the entity they show; a table is a
# part of that name, its model the size group.
_BINDINGS_SQL = "SELECT o_orderkey % 500 AS report, p_name || '/' || CAST(p_partkey % 40 AS VARCHAR) AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_TABLES_SQL = "SELECT DISTINCT p_name || '/' || CAST(p_partkey % 40 AS VARCHAR) AS entity, CAST(p_partkey AS VARCHAR) AS table_id, 'm' || CAST(p_size AS VARCHAR) AS model FROM part WHERE p_partkey % 3 <> 0"
_DECLARED_SQL = "SELECT DISTINCT o_orderkey % 500 AS report, 'm' || CAST(o_orderkey % 50 + 1 AS VARCHAR) AS model FROM orders WHERE o_orderkey % 500 % 4 = 0"
_RESOLVED_SQL = f"""b0 AS ({_BINDINGS_SQL}), t AS ({_TABLES_SQL}), dm AS (SELECT report, min(model) AS model FROM ({_DECLARED_SQL}) GROUP BY 1), b AS (SELECT DISTINCT report, entity FROM b0),
p AS (SELECT b.report, b.entity, t.table_id, t.model, dm.model AS own FROM b JOIN t ON t.entity = b.entity LEFT JOIN dm ON dm.report = b.report),
p2 AS (SELECT *, coalesce(bool_or(model = own) OVER (PARTITION BY report, entity), false) AS has_own FROM p),
s1 AS (SELECT report, entity, min(table_id) AS table_id, min(model) AS model, 1 AS step FROM p2 WHERE NOT has_own OR model = own GROUP BY 1, 2 HAVING count(DISTINCT table_id) = 1),
dr AS (SELECT DISTINCT report, model FROM s1),
rest AS (SELECT p.* FROM p ANTI JOIN s1 ON s1.report = p.report AND s1.entity = p.entity),
s2 AS (SELECT report, entity, min(table_id) AS table_id, min(model) AS model, 2 AS step FROM rest WHERE report NOT IN (SELECT report FROM dr) OR (report, model) IN (SELECT (report, model) FROM dr) GROUP BY 1, 2 HAVING count(DISTINCT table_id) = 1),
s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2)
"""


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select((F.col("o_orderkey") % 500).alias("report"), F.expr("concat(p_name, '/', cast(p_partkey % 40 as string))").alias("entity"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr("concat(p_name, '/', cast(p_partkey % 40 as string)) as entity", "cast(p_partkey as string) as table_id", "concat('m', cast(p_size as string)) as model").distinct()


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").where("o_orderkey % 500 % 4 = 0").selectExpr("o_orderkey % 500 as report", "concat('m', cast(o_orderkey % 50 + 1 as string)) as model")
    return d.groupBy("report").agg(F.min("model").alias("model"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.resolve_bindings(_bindings(spark, sf_dir), _tables(spark, sf_dir), _declared(spark, sf_dir))


@query(f"WITH {_RESOLVED_SQL} SELECT report, entity, table_id, model, step FROM s", False)
def two_pass_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("report", "entity", "table_id", "model", "step")


@query(
    f"""WITH {_RESOLVED_SQL}, o AS (SELECT entity, string_agg(model, ',' ORDER BY model) AS owners FROM (SELECT DISTINCT entity, model FROM t) GROUP BY 1)
SELECT b0.report, b0.entity, CASE WHEN o.owners IS NULL THEN 'unmatched_visual_entity' ELSE 'ambiguous_visual_binding' END AS category, count(*) AS n, coalesce(o.owners, '') AS owners
FROM b0 ANTI JOIN s ON s.report = b0.report AND s.entity = b0.entity LEFT JOIN o ON o.entity = b0.entity GROUP BY 1, 2, 3, o.owners""",
    False,
)
def ambiguous_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.unresolved_rollup(_bindings(spark, sf_dir), _tables(spark, sf_dir), _resolved(spark, sf_dir))


_SHOWN_SQL = "SELECT l_orderkey % 500 AS report, l_partkey AS target FROM lineitem"
_OWNERS_SQL = "SELECT p_partkey AS target, 'm' || CAST(p_size AS VARCHAR) AS model, CASE WHEN p_partkey % 4 = 0 THEN 'measure' ELSE 'table' END AS kind FROM part"


def _shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 as report", "l_partkey as target")
    o = table(spark, sf_dir, "part").selectExpr("p_partkey as target", "concat('m', cast(p_size as string)) as model", "case when p_partkey % 4 = 0 then 'measure' else 'table' end as kind")
    return v, o


@query(f"SELECT DISTINCT report, model FROM ({_SHOWN_SQL}) v JOIN ({_OWNERS_SQL}) o ON o.target = v.target", False)
def report_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.report_models(*_shown(spark, sf_dir))


@query(
    f"""SELECT report, count(DISTINCT model) AS n_models, count(DISTINCT CASE WHEN kind = 'table' THEN v.target END) AS n_tables, count(DISTINCT CASE WHEN kind = 'measure' THEN v.target END) AS n_measures
FROM ({_SHOWN_SQL}) v JOIN ({_OWNERS_SQL}) o ON o.target = v.target GROUP BY 1""",
    False,
)
def report_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.report_overview(*_shown(spark, sf_dir))


@query("SELECT l_suppkey AS dimension, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{x}') AS \"{x}\"" for x in "ANR") + " FROM lineitem GROUP BY 1", False)
def relationship_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dimension"), F.col("l_returnflag").alias("fact"))
    return bindings.relationship_grid(r, ["A", "N", "R"])


@query("SELECT DISTINCT l_returnflag AS role, l_partkey AS target, concat('t', CAST(l_suppkey AS VARCHAR)) AS entity, l_linestatus AS property, 'column' AS kind, CAST(l_linenumber % 2 AS VARCHAR) AS scope FROM lineitem", False)
def field_ref_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return bindings.field_refs(li.selectExpr("l_returnflag as role", "l_partkey as target", "concat('t', cast(l_suppkey as string)) as entity", "l_linestatus as property", "'column' as kind", "cast(l_linenumber % 2 as string) as scope"))


# --- diagnostics: events are warnings, their type a category, their user a file ---------------------------------------

_CATEGORY = "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'tmdl_parse' WHEN event_type = 'error' THEN 'file_unreadable' WHEN event_type = 'click' THEN 'dynamic_sql' WHEN event_type = 'view' THEN 'select_star_view' WHEN event_type = 'signup' THEN 'unheard_of' ELSE 'identity_collision' END"
_W = f"w AS (SELECT {_CATEGORY} AS category, 'f' || CAST(user_id AS VARCHAR) AS file, 'event ' || CAST(event_id AS VARCHAR) AS message FROM events)"
_SEV = "CASE WHEN category IN ('tmdl_parse', 'file_unreadable', 'identity_collision') THEN 'error' WHEN category = 'select_star_view' THEN 'info' ELSE 'warning' END"


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr(_CATEGORY).alias("category"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"))


@query(f"WITH {_W} SELECT {_SEV} AS severity, count(*) AS n FROM w GROUP BY 1", False)
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.severity_counts(_warnings(spark, sf_dir))


@query(f"WITH {_W} SELECT {_SEV} AS severity, category, count(*) AS n FROM w GROUP BY 1, 2", False)
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.category_counts(_warnings(spark, sf_dir))


@query(f"WITH {_W} SELECT message, {_SEV} AS severity FROM w", False)
def severity_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warnings(spark, sf_dir).select("message", quality.severity_of(F.col("category")).alias("severity"))


@query(f"WITH {_W} SELECT *, {_SEV} AS severity, CASE {_SEV} WHEN 'error' THEN 0 WHEN 'info' THEN 2 ELSE 1 END AS severity_rank FROM w", False)
def diagnostics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.diagnostics_rows(_warnings(spark, sf_dir))


@query(f"WITH {_W} SELECT file, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, file LIMIT 5", False)
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_files(_warnings(spark, sf_dir))


@query(f"WITH {_W} SELECT category, file, message FROM w WHERE category IN ('file_unreadable', 'identity_collision', 'dynamic_sql', 'tmdl_parse')", False)
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate_failures(_warnings(spark, sf_dir), "strict")


# --- coverage and usage -----------------------------------------------------------------------------------------------


@query("SELECT r AS repo_key, count(doc_id) AS n_files, CASE WHEN count(doc_id) > 0 THEN 'scanned' ELSE 'missing' END AS state FROM (SELECT DISTINCT 'src' || CAST(r_regionkey * 10 AS VARCHAR) AS r FROM region) LEFT JOIN documents ON source = r GROUP BY 1", False)
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = table(spark, sf_dir, "region").select(F.concat(F.lit("src"), (F.col("r_regionkey") * 10).cast("string")).alias("repo_key"))
    return quality.source_coverage(table(spark, sf_dir, "documents").select(F.col("source").alias("repo_key")), repos)


_FACTS = "key % 211 = 1 AS unresolved, key % 223 = 2 AS skipped, key % 5003 = 3 AS source_missing, key % 227 = 4 AS dynamic_sql_untraced, CASE WHEN key % 229 = 5 THEN 'regex_fallback' ELSE 'ast' END AS parse_quality, key % 233 = 6 AS columns_unresolved, key % 239 = 7 AS external_source"


@query(
    f"""SELECT schema_name, node_type, CASE WHEN bool_or(unresolved OR skipped) THEN 'unresolved' WHEN bool_or(source_missing) THEN 'missing' WHEN bool_or(dynamic_sql_untraced OR parse_quality = 'regex_fallback' OR columns_unresolved) THEN 'partial'
 WHEN bool_or(source_file = '') THEN 'unknown' WHEN bool_or(external_source) THEN 'external' ELSE 'complete' END AS state FROM (SELECT n.*, {_FACTS} FROM n) GROUP BY 1, 2"""
)
def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = estate.nodes(spark, sf_dir).selectExpr("*", *[x.strip() for x in _FACTS.split(",")])
    return quality.evidence_state(n, ["schema_name", "node_type"])


@query("SELECT p_name AS model, count(DISTINCT (p_brand, p_type)) AS n_roots FROM part GROUP BY 1 HAVING count(DISTINCT (p_brand, p_type)) > 1", False)
def identity_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.identity_collisions(table(spark, sf_dir, "part").select(F.col("p_name").alias("model"), F.col("p_brand").alias("repo_key"), F.col("p_type").alias("root")))


@query("SELECT DISTINCT o_custkey AS table_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')", False)
def measure_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return quality.measure_homes(o.select(F.col("o_custkey").alias("table_id"), (F.col("o_orderstatus") != "O").alias("hidden")), o.select(F.col("o_custkey").alias("table_id")))


@query("SELECT DISTINCT schema_name FROM n WHERE node_type IN ('bronze_table', 'silver_table', 'gold_table', 'view', 'stored_proc')")
def sql_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate.nodes(spark, sf_dir).where("node_type in ('bronze_table', 'silver_table', 'gold_table', 'view', 'stored_proc')").select("schema_name").distinct()


@query("SELECT u.model, o.schema_name, count(DISTINCT u.name) AS votes FROM (SELECT DISTINCT p_brand AS model, lower(p_name) AS name FROM part WHERE p_size > 17) u JOIN (SELECT DISTINCT p_type AS schema_name, lower(p_name) AS name FROM part WHERE p_size <= 17) o ON o.name = u.name GROUP BY 1, 2", False)
def schema_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return quality.schema_votes(p.where("p_size > 17").selectExpr("p_brand as model", "p_name as name"), p.where("p_size <= 17").selectExpr("p_type as schema_name", "p_name as name"))


@query("SELECT node_type, count(*) AS n FROM n GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate.nodes(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"))


@query("SELECT id, node_type AS type, schema_name AS schema, name, CASE WHEN node_type LIKE '%table' THEN split_part(node_type, '_', 1) ELSE '' END AS layer, source_file, '' AS trust FROM n")
def export_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import objects_export

    return objects_export(estate.nodes(spark, sf_dir))


@query("SELECT source_id AS source, target_id AS target, edge_type, coalesce(arg_min(evidence, ord) FILTER (WHERE evidence <> ''), '') AS evidence FROM e GROUP BY 1, 2, 3")
def export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import edges_export

    return edges_export(graph.edge_dedup(estate.edges(spark, sf_dir)))


_LAYERED = "SELECT id, node_type, name, schema_name, CASE WHEN node_type LIKE '%table' THEN split_part(node_type, '_', 1) END AS layer, source_file = '' AS unresolved FROM n"
_GROUPED = f"g AS (SELECT *, 'sql:' || coalesce(layer, 'none') || ':' || schema_name AS group_id, CASE layer WHEN 'gold' THEN 2 WHEN 'silver' THEN 1 ELSE 0 END AS lane FROM ({_LAYERED}))"


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("node_type").endswith("table"), F.split_part("node_type", F.lit("_"), F.lit(1)))
    return estate.nodes(spark, sf_dir).select("id", "node_type", "name", "schema_name", layer.alias("layer"), (F.col("source_file") == "").alias("unresolved"))


@query(f", {_GROUPED} SELECT group_id, min(lane) AS lane, count_if(node_type LIKE '%table') AS n_tables, count_if(node_type = 'view') AS n_views, count_if(node_type = 'stored_proc') AS n_procs, count_if(unresolved) AS n_warnings FROM g GROUP BY 1")
def estate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.estate_groups(_layered(spark, sf_dir))


@query(f", {_GROUPED} SELECT a.group_id AS source_group, b.group_id AS target_group, count(*) AS weight FROM e JOIN g a ON a.id = source_id JOIN g b ON b.id = target_id WHERE a.group_id <> b.group_id GROUP BY 1, 2")
def estate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.estate_edges(_layered(spark, sf_dir), estate.edges(spark, sf_dir))


@query(
    f""", {_GROUPED}, gg AS (SELECT group_id, min(lane) AS lane FROM g GROUP BY 1), z AS (SELECT lane, count(*) AS c FROM gg GROUP BY 1)
SELECT group_id, gg.lane, row_number() OVER (PARTITION BY gg.lane ORDER BY lower(group_id), group_id) - 1 AS row, ((SELECT max(c) FROM z) - z.c) / 2.0 AS "offset" FROM gg JOIN z ON z.lane = gg.lane"""
)
def estate_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.estate_layout(quality.estate_groups(_layered(spark, sf_dir)))


@query("SELECT id FROM n WHERE (id LIKE 'customer:%' OR id LIKE 'part:%') AND id NOT IN (SELECT target_id FROM c WHERE edge_type IN ('references', 'visualizes'))")
def unused_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = estate.nodes(spark, sf_dir).where("id like 'customer:%' or id like 'part:%'").select("id")
    return quality.unused_measures(m, estate.cyclic_edges(spark, sf_dir))


@query(
    """WITH u AS (SELECT l_partkey AS table_id, l_returnflag AS name FROM lineitem WHERE l_quantity > 45), ut AS (SELECT DISTINCT l_partkey AS table_id FROM lineitem WHERE l_discount > 0.095),
a AS (SELECT table_id FROM u UNION SELECT table_id FROM ut)
SELECT p_partkey AS table_id, '' AS name, 'table' AS kind FROM part WHERE p_partkey NOT IN (SELECT table_id FROM a)
UNION ALL SELECT c.table_id, c.name, 'column' FROM (SELECT DISTINCT l_partkey AS table_id, l_returnflag AS name FROM lineitem) c WHERE c.table_id IN (SELECT table_id FROM a) AND (c.table_id, c.name) NOT IN (SELECT (table_id, name) FROM u)
 AND (c.table_id, c.name) NOT IN (SELECT (l_partkey, l_returnflag) FROM lineitem WHERE l_linenumber = 7)""",
    False,
)
def unused_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fields = lambda rows: rows.select(F.col("l_partkey").alias("table_id"), F.col("l_returnflag").alias("name")).distinct()
    tables = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"))
    return quality.unused_fields(tables, fields(li), fields(li.where("l_discount > 0.095")), fields(li.where("l_quantity > 45")), fields(li.where("l_linenumber = 7")))


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", False)
def silent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("path", F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"))
    return quality.silent_files(files, labels.where("quality = 1").select(F.col("path").alias("source_file")), labels.where("toxic = 1").select(F.col("path").alias("file")))


@query("SELECT DISTINCT 'supplier:' || CAST(p_size AS VARCHAR) AS a, 'part:' || CAST(p_partkey AS VARCHAR) AS b FROM part WHERE ('part:' || CAST(p_partkey AS VARCHAR), 'supplier:' || CAST(p_size AS VARCHAR)) NOT IN (SELECT (source_id, target_id) FROM e)")
def catalog_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "part").select(F.concat(F.lit("supplier:"), F.col("p_size").cast("string")).alias("a"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("b"))
    return quality.catalog_gap(listed, estate.edges(spark, sf_dir))


# --- texts: each order becomes a small SQL script ----------------------------------------------------------------------

_SCRIPT = """-- order FROM no.where
/* a /* nested */ FROM no.way */ INSERT INTO [mart].[Ord%d] SELECT 'FROM x.y' FROM raw.cust%d c JOIN stg.status_%s AS s ON c.id = s.id;
WITH q AS (SELECT * FROM base.p%d) UPDATE c SET a = 1 FROM mart.ord%d c JOIN q ON 1 = 1
GO
EXEC sp_executesql N'DELETE FROM z'
GO
EXEC @rc = dbo.usp_%s"""


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.format_string(_SCRIPT, k % 50, F.col("o_custkey"), F.col("o_orderstatus"), k % 7, k % 50, F.lower("o_orderstatus"))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    return orders.select(F.lit("r").alias("repo_key"), k.cast("string").alias("path"), text.alias("text"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS path, stmt, direction, schema_name, name FROM (
 SELECT o_orderkey, 0 AS stmt, 'writes' AS direction, 'mart' AS schema_name, concat('ord', CAST(o_orderkey % 50 AS VARCHAR)) AS name FROM orders
 UNION ALL SELECT o_orderkey, 0, 'reads', 'raw', concat('cust', CAST(o_custkey AS VARCHAR)) FROM orders
 UNION ALL SELECT o_orderkey, 0, 'reads', 'stg', lower(concat('status_', o_orderstatus)) FROM orders
 UNION ALL SELECT o_orderkey, 1, 'writes', 'mart', concat('ord', CAST(o_orderkey % 50 AS VARCHAR)) FROM orders
 UNION ALL SELECT o_orderkey, 1, 'reads', 'base', concat('p', CAST(o_orderkey % 7 AS VARCHAR)) FROM orders)""",
    False,
)
def statement_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.statement_lineage(statements.statements(_scripts(spark, sf_dir))).select("path", "stmt", "direction", "schema_name", "name")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS file, 'dynamic_sql' AS category FROM orders", False)
def dynamic_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.dynamic_sql(statements.statements(_scripts(spark, sf_dir))).select("file", "category")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'dbo' AS schema_name, concat('usp_', lower(o_orderstatus)) AS name FROM orders", False)
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.callees(statements.statements(_scripts(spark, sf_dir))).select("path", "schema_name", "name")


# Each customer becomes a measure that names columns and other measures.
_DAX = """CALCULATE([Total %s], 'My Sales'[Cust %d] = "[no]", Dim[x]) // [never]
 + IF(1 IN [Rate], 2)"""


@query(
    """SELECT c_custkey, table_name, name FROM (SELECT c_custkey, '' AS table_name, concat('Total ', c_mktsegment) AS name FROM customer UNION ALL SELECT c_custkey, 'My Sales', concat('Cust ', CAST(c_custkey % 9 AS VARCHAR)) FROM customer
 UNION ALL SELECT c_custkey, 'Dim', 'x' FROM customer UNION ALL SELECT c_custkey, '', 'Rate' FROM customer)""",
    False,
)
def dax_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", F.format_string(_DAX, "c_mktsegment", F.col("c_custkey") % 9).alias("expression"))
    return models.dax_refs(c).select("c_custkey", "table_name", "name")


# Each supplier becomes a table partition whose M expression navigates to a source or sends a query.
_M = """let Source = Sql.Database("srv", "db"), // {[Schema="no",Item="no"]}
 T = Source{[Schema="s%d",Item="T%d"]}[Data], Q = Value.NativeQuery(Source, "SELECT * FROM nat.q%d x JOIN ""ext"".z ON 1=1") in Table.Combine({T, Q})"""


@query(
    """SELECT s_suppkey, schema_name, name, raw_kind FROM (SELECT s_suppkey, concat('s', CAST(s_nationkey AS VARCHAR)) AS schema_name, concat('t', CAST(s_suppkey AS VARCHAR)) AS name, 'navigation' AS raw_kind FROM supplier
 UNION ALL SELECT s_suppkey, 'nat', concat('q', CAST(s_suppkey % 10 AS VARCHAR)), 'native_query' FROM supplier UNION ALL SELECT s_suppkey, 'ext', 'z', 'native_query' FROM supplier)""",
    False,
)
def m_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dealt(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").select("s_suppkey", F.format_string(_M, "s_nationkey", "s_suppkey", F.col("s_suppkey") % 10).alias("expression"))
    return models.m_sources(s).select("s_suppkey", "schema_name", "name", "raw_kind")


@query(
    """SELECT concat('T', CAST(l_orderkey // 500 AS VARCHAR)) AS "table", concat('c', CAST(l_partkey AS VARCHAR)) AS name, min(l_linestatus) AS data_type, bool_and(l_returnflag = 'R') AS hidden FROM lineitem GROUP BY 1, 2""",
    False,
)
def tom_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines become columns of model files, one file for each 500 orders, written as JSON and read back."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 500").alias("t"), "l_partkey").agg(F.min("l_linestatus").alias("d"), F.bool_and(F.col("l_returnflag") == "R").alias("h"))
    cols = F.collect_list(F.struct(F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("name"), F.col("d").alias("dataType"), F.col("h").alias("isHidden")))
    tables = F.array(F.struct(F.concat(F.lit("T"), F.col("t").cast("string")).alias("name"), F.col("c").alias("columns")))
    files = li.groupBy("t").agg(cols.alias("c")).select(F.lit("r").alias("repo_key"), F.concat(F.col("t").cast("string"), F.lit(".bim")).alias("path"), F.to_json(F.struct(F.struct(tables.alias("tables")).alias("model"))).alias("text"))
    return models.tom(files)["columns"].select("table", "name", "data_type", "hidden")
