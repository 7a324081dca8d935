"""Queries of the build from texts to the graph, and of the operators it is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, names
from ..operators import bindings, closure, diff, graph, layering, linking, partitions, quality, reports, statements
from ..sources import catalog, estate, models, sinks
from . import build
from .queries import _NEW_N, _OLD_N, _versions, query
from .session import dealt, table

# Orders are scripts, each with a view, a procedure and a call that is built at run time; parts are tables of models, every
# second one with a measure; lines are visuals, the seventh ones filters of the report.
_SCRIPT = """CREATE VIEW rep.v%d AS SELECT a.x FROM [mart].[Ord%d] a, raw.cust%d b -- FROM no.no
GO
CREATE PROC etl.p%d AS
INSERT INTO mart.ord%d SELECT ';' FROM stg.[st;%s] s JOIN rep.v%d v ON 1 = 1
EXEC dbo.log_it
GO
EXEC sp_executesql N'DELETE FROM z'"""


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.format_string(_SCRIPT, k, k % 50, F.col("o_custkey"), k, k % 50, F.col("o_orderstatus"), k)
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    return orders.select(F.lit("r").alias("repo_key"), k.cast("string").alias("path"), text.alias("text"))


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr("p_partkey as k", "concat('m', cast(p_size as string)) as model", "concat('t', cast(p_partkey as string)) as table_name", "concat('pbi_table:m', cast(p_size as string), '.t', cast(p_partkey as string)) as table_id")
    kind = F.when(F.col("k") % 5 == 2, "calculated").when(F.col("k") % 5 == 4, "query").otherwise("m")
    nav = F.format_string('let Itm = "Ord%d", S = Sql.Database("a", "b"), T = S{[Schema="mart", Item=Itm]}[Data] in T', F.col("k") % 50)
    native = F.format_string('Value.NativeQuery(Sql.Database("a", "b"), "SELECT * FROM raw.cust%d c JOIN ""rep"".v%d v ON 1 = 1")', F.col("k"), F.col("k"))
    calculated = F.format_string("ADDCOLUMNS('t%d', \"[no]\", [M%d] + [M%d])", F.col("k"), F.col("k"), F.col("k") - 2)
    sql = F.format_string("SELECT a FROM raw.cust%d /* FROM no.no */", F.col("k") + 1)
    text = F.when(F.col("k") % 5 == 0, nav).when(F.col("k") % 5 == 1, native).when(F.col("k") % 5 == 2, calculated).when(F.col("k") % 5 == 4, sql).otherwise('Web.Contents("x") // {[Schema="no", Item="no"]}')
    parts = p.select("table_id", "model", F.col("table_name").alias("name"), kind.alias("type"), text.alias("expression"))
    named = F.concat(F.lit("M"), F.col("k").cast("string"))
    dax = F.format_string("SUM('t%d'[x]) + [M%d] -- [no]", F.col("k"), F.col("k") - 2)
    measures = p.where("k % 2 = 0").select(F.concat(F.lit("measure:"), "model", F.lit("."), F.lower(named)).alias("id"), "model", "table_name", named.alias("name"), dax.alias("expression"))
    return p.select("table_id", "model", "table_name"), parts, measures


def _fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").selectExpr("*", "concat('R', cast(l_orderkey % 200 as string)) as report", "concat('t', cast(l_partkey as string)) as entity", "concat('M', cast(l_partkey as string)) as property", "case when l_linenumber % 2 = 0 then 'measure' else 'column' end as kind")
    visual = F.concat_ws("_", F.lit("v"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    shown = li.where("l_linenumber < 7").select(F.concat(F.lit("visual:"), visual).alias("source_id"), "report", visual.alias("visual"), "entity", "property", "kind", F.lit("shown").alias("role"))
    filters = li.where("l_linenumber = 7").select(F.concat(F.lit("report:"), F.lower("report")).alias("source_id"), "report", "entity", "property", F.lit("unknown").alias("kind"), F.lit("page").alias("scope"))
    declared = table(spark, sf_dir, "orders").where("o_orderkey % 200 % 4 = 0").selectExpr("concat('R', cast(o_orderkey % 200 as string)) as report", "concat('m', cast(o_orderkey % 200 % 50 + 1 as string)) as model").distinct()
    return shown, filters, declared


def _built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return build.build(_scripts(spark, sf_dir), *_models(spark, sf_dir), *_fields(spark, sf_dir))


_O = "o AS (SELECT o_orderkey AS k, o_orderkey % 50 AS j, o_custkey AS c, lower(o_orderstatus) AS s FROM orders)"
_P = "p AS (SELECT p_partkey AS k, 'm' || CAST(p_size AS VARCHAR) AS model, 't' || CAST(p_partkey AS VARCHAR) AS t, 'pbi_table:m' || CAST(p_size AS VARCHAR) || '.t' || CAST(p_partkey AS VARCHAR) AS id FROM part), me AS (SELECT *, 'measure:' || model || '.m' || CAST(k AS VARCHAR) AS mid FROM p WHERE k % 2 = 0)"
_L = "l AS (SELECT 'R' || CAST(l_orderkey % 200 AS VARCHAR) AS report, l_partkey AS k, l_linenumber AS n FROM lineitem)"


@query(
    f"""WITH {_O}, {_P}, {_L}
SELECT 'view:rep.v' || CAST(k AS VARCHAR) AS id, 'view' AS node_type, 'v' || CAST(k AS VARCHAR) AS name FROM o
UNION ALL SELECT 'stored_proc:etl.p' || CAST(k AS VARCHAR), 'stored_proc', 'p' || CAST(k AS VARCHAR) FROM o
UNION ALL SELECT DISTINCT 'gold_table:mart.ord' || CAST(j AS VARCHAR), 'gold_table', 'ord' || CAST(j AS VARCHAR) FROM o
UNION ALL SELECT DISTINCT 'gold_table:raw.cust' || CAST(c AS VARCHAR), 'gold_table', 'cust' || CAST(c AS VARCHAR) FROM o
UNION ALL SELECT DISTINCT 'gold_table:stg.st;' || s, 'gold_table', 'st;' || s FROM o
UNION ALL SELECT DISTINCT 'semantic_model:' || model, 'semantic_model', model FROM p
UNION ALL SELECT id, 'pbi_table', t FROM p
UNION ALL SELECT mid, 'measure', 'M' || CAST(k AS VARCHAR) FROM me
UNION ALL SELECT DISTINCT 'report:' || lower(report), 'report', report FROM l""",
    False,
)
def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of scripts, models and reports built from their texts."""
    return _built(spark, sf_dir)["nodes"].select("id", "node_type", "name")


_SHOWN_SQL = "SELECT DISTINCT report, k FROM l"


@query(
    f"""WITH {_O}, {_P}, {_L}, g AS (SELECT 'gold_table:mart.ord' || CAST(j AS VARCHAR) AS id FROM o UNION SELECT 'gold_table:raw.cust' || CAST(c AS VARCHAR) FROM o UNION SELECT 'view:rep.v' || CAST(k AS VARCHAR) FROM o)
SELECT 'view:rep.v' || CAST(k AS VARCHAR) AS source_id, 'gold_table:mart.ord' || CAST(j AS VARCHAR) AS target_id, 'reads' AS edge_type FROM o
UNION SELECT 'view:rep.v' || CAST(k AS VARCHAR), 'gold_table:raw.cust' || CAST(c AS VARCHAR), 'reads' FROM o
UNION SELECT 'stored_proc:etl.p' || CAST(k AS VARCHAR), 'gold_table:mart.ord' || CAST(j AS VARCHAR), 'writes' FROM o
UNION SELECT 'stored_proc:etl.p' || CAST(k AS VARCHAR), 'gold_table:stg.st;' || s, 'reads' FROM o
UNION SELECT 'stored_proc:etl.p' || CAST(k AS VARCHAR), 'view:rep.v' || CAST(k AS VARCHAR), 'reads' FROM o
UNION SELECT 'stored_proc:etl.p' || CAST(k AS VARCHAR), 'stored_proc:dbo.log_it', 'references' FROM o
UNION SELECT id, 'semantic_model:' || model, 'feeds' FROM p
UNION SELECT mid, 'semantic_model:' || model, 'feeds' FROM me
UNION SELECT 'gold_table:mart.ord' || CAST(k % 50 AS VARCHAR), id, 'feeds' FROM p WHERE k % 5 = 0 AND 'gold_table:mart.ord' || CAST(k % 50 AS VARCHAR) IN (SELECT id FROM g)
UNION SELECT 'gold_table:raw.cust' || CAST(k AS VARCHAR), id, 'feeds' FROM p WHERE k % 5 = 1 AND 'gold_table:raw.cust' || CAST(k AS VARCHAR) IN (SELECT id FROM g)
UNION SELECT 'view:rep.v' || CAST(k AS VARCHAR), id, 'feeds' FROM p WHERE k % 5 = 1 AND 'view:rep.v' || CAST(k AS VARCHAR) IN (SELECT id FROM g)
UNION SELECT 'gold_table:raw.cust' || CAST(k + 1 AS VARCHAR), id, 'feeds' FROM p WHERE k % 5 = 4 AND 'gold_table:raw.cust' || CAST(k + 1 AS VARCHAR) IN (SELECT id FROM g)
UNION SELECT p.id, me.mid, 'references' FROM p JOIN me ON me.model = p.model AND (me.k = p.k OR me.k = p.k - 2) WHERE p.k % 5 = 2
UNION SELECT a.mid, b.mid, 'references' FROM me a JOIN me b ON b.model = a.model AND b.k = a.k - 2
UNION SELECT mid, id, 'references' FROM me
UNION SELECT 'report:' || lower(report), id, 'visualizes' FROM l JOIN p ON p.k = l.k
UNION SELECT 'report:' || lower(report), mid, 'visualizes' FROM l JOIN me ON me.k = l.k WHERE n = 7 OR n % 2 = 0
UNION SELECT 'semantic_model:' || model, 'report:' || lower(report), 'feeds' FROM l JOIN p ON p.k = l.k""",
    False,
)
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the same graph."""
    return _built(spark, sf_dir)["edges"].select("source_id", "target_id", "edge_type")


@query(
    f"""WITH {_P}, {_L} SELECT DISTINCT 'report:' || lower(report) AS report_id, CASE WHEN n = 7 THEN 'filter' ELSE 'shown' END AS role, id AS target, CASE WHEN n = 7 THEN 'unknown' WHEN n % 2 = 0 THEN 'measure' ELSE 'column' END AS kind, CASE WHEN n = 7 THEN 'page' ELSE 'visual' END AS scope FROM l JOIN p ON p.k = l.k
UNION SELECT DISTINCT 'report:' || lower(report), CASE WHEN n = 7 THEN 'filter' ELSE 'shown' END, mid, 'measure', CASE WHEN n = 7 THEN 'page' ELSE 'visual' END FROM l JOIN me ON me.k = l.k WHERE n = 7 OR n % 2 = 0""",
    False,
)
def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each report shows and filters on, folded up from visuals and pages."""
    tables, _, measures = _models(spark, sf_dir)
    return build.report_graph(*_fields(spark, sf_dir), tables, measures)["field_refs"].select("report_id", "role", "target", "kind", "scope")


@query("SELECT 'dynamic_sql' AS category, CAST(o_orderkey AS VARCHAR) AS file FROM orders UNION ALL SELECT 'unresolved_partition_source', 'pbi_table:m' || CAST(p_size AS VARCHAR) || '.t' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 5 = 3", False)
def build_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)["warnings"].select("category", "file")


@query(
    f"WITH {_P} SELECT id AS table_id, k % 5 = 2 AS calculated, k % 5 = 3 AS unresolved, FALSE AS static FROM p",
    False,
)
def partition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.attach(_models(spark, sf_dir)[1])["flags"].select("table_id", "calculated", "unresolved", "static")


# Report hierarchy: lines are visuals, their order a page, the order's customer a report.
@query(
    """SELECT DISTINCT 'visual:v' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS source_id, 'report_page:p' || CAST(l_orderkey AS VARCHAR) AS target_id FROM lineitem
UNION ALL SELECT DISTINCT 'report_page:p' || CAST(l_orderkey AS VARCHAR), 'report:r' || CAST(l_orderkey % 100 AS VARCHAR) FROM lineitem""",
    False,
)
def report_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").selectExpr("concat('R', cast(l_orderkey % 100 as string)) as report", "concat('P', cast(l_orderkey as string)) as page", "concat_ws('_', concat('V', cast(l_orderkey as string)), cast(l_linenumber as string)) as visual", "'f' as file")
    return reports.chain(v)[1].select("source_id", "target_id")


# Filters whose entity (a part's type) has tables in several models.
_FILTER_T = "t AS (SELECT p_type AS entity, CAST(p_partkey AS VARCHAR) AS table_id, 'm' || CAST(p_size AS VARCHAR) AS model FROM part), f AS (SELECT DISTINCT l_orderkey % 300 AS report, p_type AS entity FROM lineitem JOIN part ON l_partkey = p_partkey), rm AS (SELECT DISTINCT o_orderkey % 300 AS report, 'm' || CAST(o_custkey % 50 + 1 AS VARCHAR) AS model FROM orders WHERE o_orderkey % 300 % 3 = 0)"


def _filter_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    tables = part.selectExpr("p_type as entity", "cast(p_partkey as string) as table_id", "concat('m', cast(p_size as string)) as model")
    f = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey % 300 as report", "p_type as entity").distinct()
    f = f.selectExpr("cast(report as string) as source_id", "report", "entity", "'x' as property", "'column' as kind", "'page' as scope")
    models = table(spark, sf_dir, "orders").where("o_orderkey % 300 % 3 = 0").selectExpr("o_orderkey % 300 as report", "concat('m', cast(o_custkey % 50 + 1 as string)) as model").distinct()
    return f, tables, tables.selectExpr("model", "'none' as name", "'none' as measure_id").where("false"), models


@query(
    f"""WITH {_FILTER_T}, pr AS (SELECT f.report, f.entity, t.table_id, t.model FROM f JOIN t ON t.entity = f.entity),
sc AS (SELECT report, entity, min(table_id) AS table_id FROM pr WHERE report NOT IN (SELECT report FROM rm) OR (report, model) IN (SELECT (report, model) FROM rm) GROUP BY 1, 2 HAVING count(DISTINCT table_id) = 1),
gl AS (SELECT report, entity, min(table_id) AS table_id FROM pr ANTI JOIN sc ON sc.report = pr.report AND sc.entity = pr.entity GROUP BY 1, 2 HAVING count(DISTINCT table_id) = 1)
SELECT report, entity, table_id AS target, 'resolved' AS state FROM sc UNION ALL SELECT report, entity, table_id, 'resolved' FROM gl
UNION ALL SELECT DISTINCT report, entity, '', 'ambiguous' FROM pr WHERE (report, entity) NOT IN (SELECT (report, entity) FROM sc) AND (report, entity) NOT IN (SELECT (report, entity) FROM gl)""",
    False,
)
def report_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, warnings = reports.filter_fields(*_filter_inputs(spark, sf_dir))
    several = warnings.select(F.col("file").cast("bigint").alias("report"), F.regexp_extract("message", r"^page filter (.*)\.x may mean", 1).alias("entity"), F.lit("").alias("target"), F.lit("ambiguous").alias("state"))
    return refs.select("report", "entity", "target", F.lit("resolved").alias("state")).unionByName(several)


# --- definitions and names ---------------------------------------------------------------------------------------------

_DDL = "CREATE TABLE [S%d].[T %d] (id INT IDENTITY(1, 1), [a,%s] DECIMAL(%d, 2) NOT NULL, c VARCHAR(20) DEFAULT ('x,y'), CONSTRAINT pk PRIMARY KEY (ID, c)); CREATE VIEW v.All%d AS SELECT t.* FROM [S%d].[T %d] t"


def _ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.format_string(_DDL, F.col("p_size"), k, F.col("p_brand"), F.col("p_size") + 2, k, F.col("p_size"), k)
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey").select(F.lit("r").alias("repo_key"), k.cast("string").alias("path"), text.alias("text"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS path, lower('s' || CAST(p_size AS VARCHAR)) AS schema_name, 't ' || CAST(p_partkey AS VARCHAR) AS name, c AS "column", t AS data_type, n AS nullable, k AS constraints FROM (
 SELECT *, 'id' AS c, 'INT' AS t, FALSE AS n, 'primary_key,identity' AS k FROM part UNION ALL SELECT *, 'a,' || p_brand, 'DECIMAL(' || CAST(p_size + 2 AS VARCHAR) || ',2)', FALSE, '' FROM part UNION ALL SELECT *, 'c', 'VARCHAR(20)', FALSE, 'primary_key,default' FROM part)""",
    False,
)
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = statements.table_columns(statements.statements(_ddl(spark, sf_dir)))
    return c.select("path", "schema_name", "name", "column", "data_type", "nullable", F.array_join("constraints", ",").alias("constraints"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'gold_table' AS node_type, lower('s' || CAST(p_size AS VARCHAR)) AS schema_name, 'T ' || CAST(p_partkey AS VARCHAR) AS display_name FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'view', 'v', 'All' || CAST(p_partkey AS VARCHAR) FROM part", False)
def sql_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.definitions(statements.statements(_ddl(spark, sf_dir))).select("path", "node_type", "schema_name", "display_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, 'select_star_view' AS category FROM part", False)
def star_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.star_views(statements.statements(_ddl(spark, sf_dir))).select("file", "category")


@query("SELECT p_partkey, 'SELECT ''' || repeat(' ', length(p_name)) || ''' ' || repeat(' ', length(p_type) + 3) || chr(10) || 'FROM [x]' AS text FROM part", False)
def sql_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings and comments blank, every other character in its place."""
    text = F.concat(F.lit("SELECT '"), "p_name", F.lit("' -- "), "p_type", F.lit("\nFROM [x]"))
    return table(spark, sf_dir, "part").select("p_partkey", masks.sql_blanked(text).alias("text"))


@query("SELECT id, CASE WHEN display_name <> '' THEN display_name ELSE name END AS shown FROM n")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate.nodes(spark, sf_dir).select("id", names.display(F.col("display_name"), F.col("name")).alias("shown"))


@query("SELECT p_partkey, p_name || '.X' AS name FROM part", False)
def original_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("["), "p_brand", F.lit('].['), "p_name", F.lit(".X]"))
    return table(spark, sf_dir, "part").select("p_partkey", names.original_name(raw).alias("name"))


_PATHS = "CASE WHEN page_id % 3 = 0 THEN 'a/b/M' || CAST(page_id AS VARCHAR) || '.SemanticModel/definition/tables/x.tmdl' WHEN page_id % 3 = 1 THEN 'a/N' || CAST(page_id AS VARCHAR) || '/definition/model.tmdl' ELSE 'K' || CAST(page_id AS VARCHAR) || '.bim' END"


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/b/M' || CAST(page_id AS VARCHAR) || '.SemanticModel' WHEN 1 THEN 'a/N' || CAST(page_id AS VARCHAR) ELSE '' END AS root,
 CASE page_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'N' ELSE 'K' END || CAST(page_id AS VARCHAR) AS name FROM pages""",
    False,
)
def model_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(_PATHS.replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "pages").select("page_id", names.model_root(path).alias("r")).select("page_id", "r.root", "r.name")


@query(
    "SELECT page_id, left(html, 100000) AS code, '``` `' || chr(96) || url || ' ```' AS inline, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS attribute, NOT (page_id % 2 = 0) AS kept FROM pages",
    False,
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source as it is shown, code in a line, attribute values, and entities that are no automatic date tables."""
    entity = F.when(F.col("page_id") % 2 == 0, "LocalDateTable_0a1b2c3d-99").otherwise("DateTable")
    return table(spark, sf_dir, "pages").select("page_id", names.shortened(F.col("html")).alias("code"), names.inline_code(F.concat(F.lit("``"), "url")).alias("inline"), names.html_attribute(F.col("html")).alias("attribute"), (~names.auto_date_entity(entity)).alias("kept"))


# --- catalog, diagnostics, exports, decisions ----------------------------------------------------------------------------


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    side = lambda schema, name, kind: F.struct(schema.alias("schema"), name.alias("name"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("database"), F.lit(None).cast("string").alias("server"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    ref = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    schema = F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, "sys").otherwise("Sup")
    entries = li.select(side(F.lit("P"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), "TABLE").alias("object"), F.when(F.col("l_linenumber") == 3, side(schema, F.concat(F.lit("#"), ref), "TABLE")).otherwise(side(schema, ref, "VIEW")).alias("references"))
    nodes = table(spark, sf_dir, "part").selectExpr("concat('part:', cast(p_partkey as string)) as id", "'p' as schema_name", "concat('P', cast(p_partkey as string)) as name").unionByName(table(spark, sf_dir, "supplier").selectExpr("concat('supplier:', cast(s_suppkey as string)) as id", "'sup' as schema_name", "concat('s', cast(s_suppkey as string)) as name"))
    return entries, nodes


@query(
    """SELECT DISTINCT 'part:' || CAST(l_partkey AS VARCHAR) AS node_id, CASE WHEN l_linenumber = 1 THEN '' ELSE 'sup.' END || 's' || CAST(l_suppkey AS VARCHAR) AS reference FROM lineitem
WHERE l_linenumber NOT IN (2, 3) AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_quantity < 40)""",
    False,
)
def catalog_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a catalog list that the lineage (the lines of small quantity) does not have."""
    entries, nodes = _catalog(spark, sf_dir)
    edges = table(spark, sf_dir, "lineitem").where("l_quantity < 40").selectExpr("concat('supplier:', cast(l_suppkey as string)) as source_id", "concat('part:', cast(l_partkey as string)) as target_id")
    return catalog.catalog_gaps(entries, nodes, edges)


_FINDING = "CASE WHEN event_type = 'error' THEN 'tmdl_parse' WHEN event_type = 'view' THEN 'select_star_view' ELSE 'dynamic_sql' END"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr(_FINDING).alias("category"), F.concat(F.lit("f|"), F.col("user_id").cast("string")).alias("file"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"))


@query(
    f"""SELECT '{{"rule":"' || c || '","severity":"' || CASE c WHEN 'tmdl_parse' THEN 'error' WHEN 'select_star_view' THEN 'info' ELSE 'warning' END || '","message":"event ' || CAST(event_id AS VARCHAR) || '","file":"f|' || CAST(user_id AS VARCHAR) || '","line":0,"object":""}}' AS value FROM (SELECT *, {_FINDING} AS c FROM events)""",
    False,
)
def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.findings_json(_findings(spark, sf_dir)).select("value")


@query(
    f"""WITH w AS (SELECT *, {_FINDING} AS c, CASE {_FINDING} WHEN 'tmdl_parse' THEN 'error' WHEN 'select_star_view' THEN 'info' ELSE 'warning' END AS s FROM events)
SELECT '| ' || s || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS value FROM w GROUP BY s UNION ALL SELECT '### `' || c || '` (' || CAST(count(*) AS VARCHAR) || ')' FROM w GROUP BY c
UNION ALL SELECT '| f\\|' || CAST(user_id AS VARCHAR) || ' | event ' || CAST(event_id AS VARCHAR) || ' |' FROM w""",
    False,
)
def diagnostics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.diagnostics_markdown(_findings(spark, sf_dir)).select("value")


@query(
    """, m AS (SELECT id, name, split_part(id, ':', 1) AS model FROM n WHERE id LIKE 'customer:%' OR id LIKE 'nation:%')
SELECT model, name AS measure, '''=1' AS dax, CASE WHEN id IN (SELECT target_id FROM e WHERE edge_type IN ('references', 'visualizes')) THEN 'False' ELSE 'True' END AS unused FROM m"""
)
def export_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = estate.nodes(spark, sf_dir).where("id like 'customer:%' or id like 'nation:%'").select("id", "name", F.split_part("id", F.lit(":"), F.lit(1)).alias("model"), F.lit("=1").alias("dax"))
    return sinks.measures_export(m, estate.edges(spark, sf_dir))


@query(
    """SELECT 1 AS part, CASE WHEN id = (SELECT min(id) FROM n) THEN '' ELSE ',' END || '"' || id || '":{"id":"' || id || '","node_type":"' || node_type || '"}' AS value FROM n
UNION ALL SELECT 3, CASE WHEN k = (SELECT min(source_id || chr(31) || target_id || chr(31) || edge_type) FROM e) THEN '' ELSE ',' END || '{"edge_type":"' || edge_type || '","source_id":"' || source_id || '","target_id":"' || target_id || '"}' FROM (SELECT DISTINCT source_id, target_id, edge_type, source_id || chr(31) || target_id || chr(31) || edge_type AS k FROM e)
UNION ALL SELECT 0, '{"nodes":{' UNION ALL SELECT 2, '},"edges":[' UNION ALL SELECT 4, ']}'"""
)
def canonical_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the one canonical graph file."""
    return sinks.canonical_json(estate.nodes(spark, sf_dir).select("id", "node_type"), estate.edges(spark, sf_dir).select("source_id", "target_id", "edge_type").distinct()).select("part", "value")


_OLD_SQL, _NEW_SQL = f"SELECT * FROM n WHERE {_OLD_N}", f"SELECT * FROM n WHERE {_NEW_N}"


@query(
    f""", ch AS (SELECT source_file AS path FROM n WHERE key % 3 = 0 AND source_file <> ''), a AS ({_NEW_SQL} AND source_file IN (SELECT path FROM ch)), b AS ({_OLD_SQL} AND source_file IN (SELECT path FROM ch))
SELECT id AS seed, 'current' AS side FROM a UNION SELECT id, CASE WHEN id IN (SELECT id FROM ({_NEW_SQL})) THEN 'current' ELSE 'baseline' END FROM b"""
)
def file_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an impact analysis of changed files starts."""
    old, new, _, _ = _versions(spark, sf_dir)
    files = estate.nodes(spark, sf_dir).where("key % 3 = 0 and source_file <> ''").select(F.col("source_file").alias("path"))
    return diff.file_seeds(files, old, new)


_LADDER_I = "SELECT p_partkey AS k, 'i' || CAST(p_partkey AS VARCHAR) AS key, p_brand AS signature, p_type AS legacy FROM part"


@query(
    f"""WITH i AS ({_LADDER_I}) SELECT key, CASE k % 8 WHEN 2 THEN 'd' WHEN 3 THEN 'e' WHEN 4 THEN 'r' WHEN 5 THEN CASE WHEN k % 3 = 0 THEN 'f' END END AS target,
 CASE k % 8 WHEN 0 THEN 'review' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'external' ELSE 'review' END WHEN 2 THEN 'cache' WHEN 3 THEN 'exact' WHEN 4 THEN 'rule' WHEN 5 THEN CASE WHEN k % 3 = 0 THEN 'fuzzy' ELSE 'pending' END WHEN 6 THEN 'pending' ELSE 'unresolved' END AS method FROM i""",
    False,
)
def ladder_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung of the link ladder: changed and unsigned decisions, external ones, exact, rule, similar, pending, none."""
    i = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat('i', cast(p_partkey as string)) as key", "p_brand as signature", "p_type as legacy")
    decisions = i.where("k % 8 < 3").selectExpr("key", "case when k % 8 = 2 then 'd' end as target", "case when k % 8 = 0 then 'old' when k % 8 = 2 then signature end as signature", "case when k % 8 = 1 and k % 3 = 0 then legacy when k % 8 = 1 then 'was' end as published")
    exact, rule = i.where("k % 8 = 3").selectExpr("key", "'e' as target"), i.where("k % 8 in (3, 4)").selectExpr("key", "'r' as target")
    fuzzy = i.where("k % 8 in (3, 5, 6, 7)").selectExpr("key", "'f' as target", "case when k % 8 = 5 then 0.95 when k % 8 = 7 then 0.5 else 0.7 end as score", "case when k % 8 = 5 and k % 3 <> 0 then 0.95 else 0.4 end as runner_up")
    return linking.ladder(i, decisions, exact, rule, fuzzy)


@query("SELECT 'i' || CAST(p_partkey AS VARCHAR) AS file, CASE WHEN p_partkey % 3 = 0 THEN 'cache_source_changed' ELSE 'cache_source_unverified' END AS category FROM part WHERE p_partkey % 3 < 2", False)
def decision_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat('i', cast(p_partkey as string)) as key", "p_brand as signature")
    d = i.selectExpr("key", "case when k % 3 = 0 then 'old' when k % 3 = 2 then signature end as signature")
    return linking.decision_warnings(i, d).select("file", "category")


@query("SELECT 'i' || CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 3 = 0 THEN 's' END AS since, 'open' AS state FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'i' || CAST(p_partkey AS VARCHAR), 's', 'retired' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 1", False)
def review_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat('i', cast(p_partkey as string)) as key")
    kept, retired = linking.carried_reviews(p.where("k % 3 = 0").selectExpr("key", "'s' as since"), p.selectExpr("key", "null as target", "case when k % 4 = 0 then 'review' when k % 2 = 0 then 'pending' else 'exact' end as method"))
    return kept.selectExpr("key", "since", "'open' as state").unionByName(retired.selectExpr("key", "since", "'retired' as state"))


# --- merges and rewrites of what hangs on nodes ------------------------------------------------------------------------


@query("SELECT 'c' || CAST(o_custkey AS VARCHAR) AS id, o_orderstatus AS key, arg_min(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1, 2", False)
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metadata_merge(table(spark, sf_dir, "orders").selectExpr("concat('c', cast(o_custkey as string)) as id", "o_orderstatus as key", "o_orderpriority as value", "o_orderkey as ord"))


@query("SELECT DISTINCT l_suppkey AS proc, CASE WHEN l_partkey % 3 = 0 THEN 'silver:' ELSE 'gold:' END || CAST(l_partkey AS VARCHAR) AS table_id, l_returnflag AS col FROM lineitem", False)
def dml_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as proc", "concat('gold:', cast(l_partkey as string)) as table_id", "l_returnflag as col")
    renamed = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("concat('gold:', cast(p_partkey as string)) as old", "concat('silver:', cast(p_partkey as string)) as new")
    return graph.rewrite_columns(li, renamed)


@query("SELECT l_partkey AS node_id, l_returnflag AS col, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS sources FROM lineitem GROUP BY 1, 2", False)
def writers_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = closure.sources_union(table(spark, sf_dir, "lineitem").selectExpr("l_partkey as node_id", "l_returnflag as col", "cast(l_suppkey as string) as source"))
    return u.select("node_id", "col", F.array_join("sources", ",").alias("sources"))


@query("SELECT o_orderkey AS report, CASE o_orderkey % 4 WHEN 0 THEN 'M' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'M' || CAST(o_custkey AS VARCHAR) ELSE 'Gone' END AS model, CASE WHEN o_orderkey % 4 < 2 THEN 'declared' ELSE 'unresolved' END AS state FROM orders", False)
def declared_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("o_orderkey") % 4, F.concat(F.lit("M"), F.col("o_custkey").cast("string"))
    path = F.when(k == 0, F.concat(F.lit("./Models\\"), F.upper(name), F.lit(".SemanticModel/"))).when(k == 2, "Models/No.SemanticModel")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), F.lit("r").alias("repo_key"), path.alias("path"), F.when(k == 1, F.lower(name)).otherwise("Gone").alias("model"))
    m = table(spark, sf_dir, "customer").selectExpr("concat('M', cast(c_custkey as string)) as model", "'r' as repo_key", "concat('Models/M', cast(c_custkey as string), '.SemanticModel') as root")
    return bindings.declared_models(r, m)


@query("SELECT l_orderkey % 500 AS report, count(DISTINCT p_size) AS n_models, count(DISTINCT CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN p_partkey END) AS n_tables, count(DISTINCT CASE WHEN p_partkey % 4 = 0 THEN p_partkey END) AS n_measures FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1", False)
def report_overview_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their data tables; every fifth table only holds measures."""
    part = table(spark, sf_dir, "part")
    v = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 as report", "l_partkey as target")
    return bindings.report_overview(v, part.selectExpr("p_partkey as target", "p_size as model", "case when p_partkey % 4 = 0 then 'measure' else 'table' end as kind"), part.where("p_partkey % 5 = 0").selectExpr("p_partkey as table_id"))


@query("SELECT id AS file, 'layer_unclassified' AS category FROM n WHERE id LIKE 'part:%' AND key % 3 = 0")
def layer_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = estate.nodes(spark, sf_dir)
    return layering.unclassified(n, n.where("id like 'part:%' and key % 3 = 0"), True).select("file", "category")


# --- owners: each order is a batch of objects, one for each of its lines ------------------------------------------------

# Lines 1 and 5 become tables, lines 2, 4, 6 and 7 views, line 3 a procedure, whose body takes in all that follows it.
_OBJECT = {
    "table": "CREATE TABLE own.t%d_%d (id INT)",
    "view": "Create View own.v%d_%d As Select * From src.p%d x, (Select 1 As a) y, src.s%d",
    "proc": "CREATE PROC own.q%d_%d AS BEGIN INSERT INTO out.p%d SELECT * FROM src.s%d END",
}


def _object_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = (F.col("l_orderkey"), F.col("l_linenumber"))
    more = (*ids, F.col("l_partkey") % 97, F.col("l_suppkey") % 7)
    n = F.col("l_linenumber")
    text = F.when(n.isin(1, 5), F.format_string(_OBJECT["table"], *ids)).when(n == 3, F.format_string(_OBJECT["proc"], *more)).otherwise(F.format_string(_OBJECT["view"], *more))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    objects = lines.select("l_orderkey", F.struct(n.alias("n"), text.alias("t")).alias("o"))
    batch = objects.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("o")).alias("o"))  # at most seven lines an order
    joined = F.array_join(F.transform("o", lambda x: F.concat(x["t"], F.when(x["n"] % 2 == 0, "\n").otherwise(";\n"))), "")
    return batch.select(F.lit("r").alias("repo_key"), F.col("l_orderkey").cast("string").alias("path"), joined.alias("text"))


@query(
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) % 97 AS p, min(l_suppkey) % 7 AS s FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, max(CASE WHEN n = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY k) = 1 AND n >= 3 AS inside FROM l),
w AS (SELECT *, CASE WHEN inside THEN 'stored_proc:own.q' || CAST(k AS VARCHAR) || '_3' ELSE 'view:own.v' || CAST(k AS VARCHAR) || '_' || CAST(n AS VARCHAR) END AS owner FROM b WHERE n NOT IN (1, 5))
SELECT owner AS source_id, 'gold_table:src.s' || CAST(s AS VARCHAR) AS target_id, 'reads' AS edge_type FROM w
UNION SELECT owner, 'gold_table:src.p' || CAST(p AS VARCHAR), 'reads' FROM w WHERE n <> 3
UNION SELECT owner, 'gold_table:out.p' || CAST(p AS VARCHAR), 'writes' FROM w WHERE n = 3""",
    False,
)
def owned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of batches that hold several objects, each of its own object or of the body around it."""
    return build.sql_graph(_object_scripts(spark, sf_dir))["edges"].select("source_id", "target_id", "edge_type")


# Formulas in every case: each part is a table with columns and, every third one, a measure; formulas name them in upper case.
@query(
    """WITH p AS (SELECT p_partkey AS k, 'm' || CAST(p_size AS VARCHAR) AS model, 'T' || CAST(p_partkey AS VARCHAR) AS t FROM part), me AS (SELECT *, 'measure:' || model || '.x' || CAST(k AS VARCHAR) AS id FROM p WHERE k % 3 = 0)
SELECT a.id AS source_id, 'pbi_table:' || b.model || '.' || lower(b.t) AS target_id FROM me a JOIN p b ON b.model = a.model AND b.k IN (a.k, a.k - 3, a.k - 5)
UNION SELECT a.id, b.id FROM me a JOIN me b ON b.model = a.model AND b.k = a.k - 3 AND b.k % 2 = 0""",
    False,
)
def formula_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What formulas reference, names compared without case, a column before a measure of the same name."""
    k = F.col("k")
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat('m', cast(p_size as string)) as model", "concat('T', cast(p_partkey as string)) as table_name", "concat('pbi_table:m', cast(p_size as string), '.t', cast(p_partkey as string)) as table_id")
    dax = F.format_string("SUM(t%d[amount]) + T%d[X%d] + 'T%d'[y]", k, k - 3, k - 3, k - 5)
    measures = p.where("k % 3 = 0").select(F.format_string("measure:%s.x%d", "model", k).alias("id"), "model", "table_name", F.format_string("x%d", k).alias("name"), dax.alias("expression"))
    columns = p.where("k % 2 = 1").select("model", "table_name", F.format_string("x%d", k).alias("name"))
    parts = p.where("false").select("table_id", "model", F.col("table_name").alias("name"), F.lit("m").alias("type"), F.lit("").alias("expression"))
    sql_nodes = build.sql_graph(p.where("false").select(F.lit("r").alias("repo_key"), F.lit("").alias("path"), F.lit("").alias("text")))["nodes"]
    edges = build.model_graph(p.select("model", "table_name", "table_id"), parts, measures, lambda: sql_nodes, columns)["edges"]
    return edges.where("edge_type = 'references'").select("source_id", "target_id")


# --- steps of M: chains of 1 to 20 steps, each with a dead one beside it; every third text has its steps in reverse -------


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_partkey") % 20
    step = lambda i: F.format_string('#"s %d" = #"s %d"{[Schema="live", Item="t%d_%d"]}[Data]', i, i - 1, k, i)
    dead = lambda i: F.format_string('Dead%d = Value.NativeQuery(#"s %d", "SELECT * FROM dead.d%d")', i, i, i)
    first = F.array(F.lit('#"s 0" = let a = Sql.Database("in", "b"), c = a in c'))
    steps = F.concat(first, F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.array(step(i), dead(i)))))
    steps = F.when(k % 3 == 0, F.reverse(steps)).otherwise(steps)
    text = F.concat(F.lit("let "), F.array_join(steps, ", "), F.format_string(' in #"s %d"', n + 1 - F.when(n > 2, 1).otherwise(0)))
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.cast("string").alias("id"), text.alias("expression"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'live' AS schema_name, 't' || CAST(p_partkey AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS name FROM part, range(1, 22) r(i) WHERE i <= p_partkey % 20 + 1 - CASE WHEN p_partkey % 20 > 2 THEN 1 ELSE 0 END", False)
def reachable_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What M expressions read, steps left out that the result does not need."""
    return models.m_sources(_chains(spark, sf_dir)).select("id", "schema_name", "name")
