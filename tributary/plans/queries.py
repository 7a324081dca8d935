"""The registered queries: every operator over the estate graph or the tables, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import closure, diff, graph, layering, linking, quality
from ..sources import estate
from .session import cut, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_WITH = f"""WITH RECURSIVE e AS ({estate.EDGES_SQL}), c AS ({estate.CYCLIC_SQL}), n AS ({estate.NODES_SQL}),
f AS ({estate.FLOW_SQL} FROM e), cf AS ({estate.FLOW_SQL} FROM c)
"""


def query(sql: str | None = None, over_estate: bool = True):
    """Registers a query under its function's name, with the SQL that checks it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _WITH + sql if over_estate else sql
        return f

    return register


# --- flow, merges, rewrites ------------------------------------------------------------------------------------------


@query("SELECT up, down, edge_type, evidence, ord FROM f")
def edge_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_flow(estate.edges(spark, sf_dir))


@query("SELECT source_id, target_id, edge_type, coalesce(arg_min(evidence, ord) FILTER (WHERE evidence <> ''), '') AS evidence FROM e GROUP BY 1, 2, 3")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_dedup(estate.edges(spark, sf_dir))


@query("SELECT * FROM c WHERE source_id <> target_id")
def drop_self_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.drop_self_edges(estate.cyclic_edges(spark, sf_dir))


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_custkey") * 2).alias("ord"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit("").alias("schema_name"), F.lit("").alias("source_file"),
    )
    stubs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id"), (F.col("o_orderkey") * 2 + 1).alias("ord"),
        F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("schema_name"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))).otherwise("").alias("source_file"),
    )
    return own.unionByName(stubs)


@query(
    """
SELECT id, coalesce(arg_min(name, ord) FILTER (WHERE name <> ''), '') AS name, coalesce(arg_min(schema_name, ord) FILTER (WHERE schema_name <> ''), '') AS schema_name,
 coalesce(arg_min(source_file, ord) FILTER (WHERE source_file <> ''), '') AS source_file
FROM (SELECT concat('customer:', CAST(c_custkey AS VARCHAR)) AS id, c_custkey * 2 AS ord, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, '' AS schema_name, '' AS source_file FROM customer
 UNION ALL SELECT concat('customer:', CAST(o_custkey AS VARCHAR)), o_orderkey * 2 + 1, o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN concat('f', CAST(o_orderkey AS VARCHAR)) ELSE '' END FROM orders)
GROUP BY id""",
    False,
)
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_merge(_contributions(spark, sf_dir), ["name", "schema_name", "source_file"])


@query(
    """
WITH c AS (SELECT l_partkey AS node_id, CASE WHEN l_linenumber % 2 = 0 THEN upper(l_returnflag) ELSE lower(l_returnflag) END AS name, l_linestatus AS data_type, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
d AS (SELECT node_id, lower(name) AS k, arg_min(name || ' ' || data_type, ord) AS col, min(ord) AS ord FROM c GROUP BY 1, 2)
SELECT node_id, string_agg(col, ',' ORDER BY ord) AS columns FROM d GROUP BY 1""",
    False,
)
def column_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns per part; (order, line) numbers are made unique by taking one row of each."""
    li = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("l_returnflag")).otherwise(F.lower("l_returnflag"))
    cols = li.select(F.col("l_partkey").alias("node_id"), name.alias("name"), F.col("l_linestatus").alias("data_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph.column_merge(cols).select("node_id", F.array_join(F.transform("columns", lambda x: F.concat_ws(" ", x["name"], x["data_type"])), ",").alias("columns"))


@query("SELECT c_nationkey AS a, c_mktsegment AS b, arg_max(c_name, c_custkey) AS name, arg_max(c_acctbal, c_custkey) AS balance FROM customer GROUP BY 1, 2", False)
def last_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("ord"))
    return graph.last_wins(c, ["a", "b"], ["name", "balance"])


_RENAMED_SQL = """
SELECT s AS source_id, t AS target_id, edge_type, coalesce(arg_min(evidence, ord) FILTER (WHERE evidence <> ''), '') AS evidence
FROM (SELECT coalesce(a.new, source_id) AS s, coalesce(b.new, target_id) AS t, edge_type, evidence, ord FROM {edges} LEFT JOIN ({map}) a ON a.old = source_id LEFT JOIN ({map}) b ON b.old = target_id)
WHERE s <> t GROUP BY 1, 2, 3"""
_STUBS = "SELECT id AS old, concat('orders:', CAST(key - key % 11 AS VARCHAR)) AS new FROM n WHERE node_type = 'gold_table' AND source_file = '' AND id LIKE 'orders:%'"


@query(_RENAMED_SQL.format(edges="c", map=_STUBS))
def stub_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stub orders share the name of the view that starts their block of eleven, and give way to it."""
    n = estate.nodes(spark, sf_dir).where("id like 'orders:%'").select("id", "node_type", "source_file", F.lit("ext").alias("schema_name"), F.expr("concat('block', cast(key - key % 11 as string))").alias("name"))
    return graph.rename_ends(estate.cyclic_edges(spark, sf_dir), graph.stub_redirects(n))


_LAYERS = {"gold": {"schemas": ["ext.o"], "paths": ["repo/orders/*1.sql"]}, "silver": {"schemas": ["ext.f"]}, "bronze": {"schemas": ["raw"], "paths": ["**/part/**"]}}
_LAYER_SQL = """CASE WHEN lower(schema_name) IN ('ext.o') OR source_file LIKE 'repo/orders/%1.sql' THEN 'gold' WHEN lower(schema_name) IN ('ext.f') THEN 'silver'
 WHEN lower(schema_name) IN ('raw') OR source_file LIKE '%/part/%' THEN 'bronze' END"""


@query(f"SELECT id, {_LAYER_SQL} AS layer FROM n")
def layer_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate.nodes(spark, sf_dir).select("id", layering.layer_rule(_LAYERS).alias("layer"))


@query(f"SELECT id FROM n WHERE {_LAYER_SQL} IS NULL AND node_type = 'gold_table' AND source_file = '' AND id NOT IN (SELECT target_id FROM e WHERE edge_type IN ('writes', 'defines'))")
def layer_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = estate.nodes(spark, sf_dir).withColumn("layer", layering.layer_rule(_LAYERS))
    return layering.layer_heuristic(n, estate.edges(spark, sf_dir))


_RETYPE_MAP = f"SELECT id AS old, concat({_LAYER_SQL}, '_table:', schema_name, '.', lower(name)) AS new FROM n WHERE node_type LIKE '%\\_table' ESCAPE '\\' AND {_LAYER_SQL} IS NOT NULL"


@query(_RENAMED_SQL.format(edges="c", map=_RETYPE_MAP))
def retype_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after tables took the type of their layer, and with it a new id."""
    n = estate.nodes(spark, sf_dir).withColumn("layer", layering.layer_rule(_LAYERS)).where("layer is not null and node_type like '%\\_table'")
    new = n.select(F.col("id").alias("old"), names.make_id(F.concat("layer", F.lit("_table")), F.col("schema_name"), F.col("name")).alias("new"))
    return graph.rename_ends(estate.cyclic_edges(spark, sf_dir), new)


@query(
    """
SELECT id, coalesce(arg_min(name, o) FILTER (WHERE name <> ''), '') AS name, coalesce(arg_min(source_file, o) FILTER (WHERE source_file <> ''), '') AS source_file
FROM (SELECT CASE WHEN id LIKE 'orders:%' AND key % 3 <> 0 THEN concat('orders:', CAST(key - key % 3 AS VARCHAR)) ELSE id END AS id,
  concat(CASE WHEN id LIKE 'orders:%' AND key % 3 <> 0 THEN '1' ELSE '0' END, id) AS o, name, source_file FROM n) GROUP BY 1"""
)
def retype_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after ids collided: the node that had the id wins, then the least old id."""
    n = estate.nodes(spark, sf_dir)
    new = n.where("id like 'orders:%' and key % 3 <> 0").select(F.col("id").alias("old"), F.expr("concat('orders:', cast(key - key % 3 as string))").alias("new"))
    return graph.retype(n, new, ["name", "source_file"])


_PRUNED = """(lower(schema_name) IN ('sys','information_schema','tempdb','guest','machinery') OR split_part(lower(schema_name), '.', -1) IN ('sys','information_schema','tempdb','guest','machinery') OR split_part(lower(schema_name), '.', -1) LIKE 'db\\_%' ESCAPE '\\'
 OR (lower(schema_name) NOT IN ('raw','o','building') AND (split_part(lower(schema_name), '.', -1) NOT IN ('raw','o','building') OR (source_file = '' AND contains(schema_name, '.')))))"""


@query(f"SELECT source_id, target_id, edge_type, evidence, ord FROM e WHERE source_id NOT IN (SELECT id FROM n WHERE {_PRUNED}) AND target_id NOT IN (SELECT id FROM n WHERE {_PRUNED})")
def prune_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layering.prune_schemas(estate.nodes(spark, sf_dir), estate.edges(spark, sf_dir), ["machinery"], ["raw", "o", "building"])[1].select("source_id", "target_id", "edge_type", "evidence", "ord")


@query("SELECT e.* FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE a.key % 2 = 0 AND b.key % 2 = 0")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = estate.nodes(spark, sf_dir)
    return graph.subgraph(n, estate.edges(spark, sf_dir), n.where("key % 2 = 0"))[1].select("source_id", "target_id", "edge_type", "evidence", "ord")


@query(_RENAMED_SQL.format(edges="e", map="SELECT concat('orders:', CAST(o_orderkey AS VARCHAR)) AS old, concat('nation:', CAST(c_nationkey AS VARCHAR)) AS new FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT concat('customer:', CAST(c_custkey AS VARCHAR)), concat('nation:', CAST(c_nationkey AS VARCHAR)) FROM customer"))
def collapse_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers fold into their nation."""
    ident = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    o = table(spark, sf_dir, "orders").select(ident("orders:", "o_orderkey").alias("child"), ident("customer:", "o_custkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(ident("customer:", "c_custkey").alias("child"), ident("nation:", "c_nationkey").alias("parent"))
    return graph.collapse(estate.edges(spark, sf_dir), o.unionByName(c))


# --- closures --------------------------------------------------------------------------------------------------------


def _roots(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return estate.nodes(spark, sf_dir).where(where).select(F.col("id").alias("root"))


@query(
    """, x AS (SELECT id AS root, id AS node FROM n WHERE id LIKE 'region:%' UNION SELECT x.root, cf.down FROM x JOIN cf ON cf.up = x.node)
SELECT root, node FROM x WHERE root <> node"""
)
def downstream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = graph.edge_flow(estate.cyclic_edges(spark, sf_dir))
    return closure.closure(flow, _roots(spark, sf_dir, "id like 'region:%'")).select("root", "node")


@query("SELECT DISTINCT down AS root, up AS node FROM cf WHERE down LIKE 'orders:%' AND up <> down")
def upstream_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = graph.edge_flow(estate.cyclic_edges(spark, sf_dir))
    return closure.closure(flow, _roots(spark, sf_dir, "id like 'orders:%'"), "up", 1).select("root", "node")


@query(
    """SELECT root, node, min(depth) AS depth FROM (
 SELECT down AS root, up AS node, 1 AS depth FROM cf WHERE down LIKE 'orders:%'
 UNION ALL SELECT a.down, b.up, 2 FROM cf a JOIN cf b ON a.up = b.down WHERE a.down LIKE 'orders:%') WHERE root <> node GROUP BY 1, 2"""
)
def upstream_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = graph.edge_flow(estate.cyclic_edges(spark, sf_dir))
    return closure.closure(flow, _roots(spark, sf_dir, "id like 'orders:%'"), "up", 2)


# Baseline and current graph: two overlapping parts of the estate, some names changed between them.
_OLD_N, _NEW_N = "key % 101 <> 1", "key % 103 <> 2"
_NEW_NAME = "case when key % 107 = 3 then concat(name, ' v2') else name end"
_OLD_E, _NEW_E = "ord % 109 <> 4", "ord % 113 <> 5"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n, e = estate.nodes(spark, sf_dir), estate.edges(spark, sf_dir)
    return n.where(_OLD_N), n.where(_NEW_N).withColumn("name", F.expr(_NEW_NAME)), e.where(_OLD_E), e.where(_NEW_E)


_COMPARED = ["node_type", "name", "schema_name", "source_file"]
_NODE_DIFF = f"""SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM n WHERE {_OLD_N}) o FULL JOIN (SELECT id, {_NEW_NAME} AS name FROM n WHERE {_NEW_N}) w ON o.id = w.id WHERE o.id IS NULL OR w.id IS NULL OR o.name <> w.name"""
_K = "source_id, target_id, edge_type"
_EDGE_DIFF = f"""SELECT *, 'added' AS change FROM (SELECT {_K} FROM e WHERE {_NEW_E} EXCEPT SELECT {_K} FROM e WHERE {_OLD_E})
UNION ALL SELECT *, 'removed' FROM (SELECT {_K} FROM e WHERE {_OLD_E} EXCEPT SELECT {_K} FROM e WHERE {_NEW_E})"""
_SEEDS = f"""SELECT id AS seed, CASE WHEN change = 'removed' THEN 'baseline' ELSE 'current' END AS side FROM ({_NODE_DIFF})
UNION SELECT CASE WHEN edge_type IN ('reads','references','visualizes') THEN target_id ELSE source_id END, CASE WHEN change = 'removed' THEN 'baseline' ELSE 'current' END FROM ({_EDGE_DIFF})"""


@query(_NODE_DIFF)
def graph_diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _, _ = _versions(spark, sf_dir)
    return diff.node_diff(old, new, _COMPARED)


@query(_EDGE_DIFF)
def graph_diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, old, new = _versions(spark, sf_dir)
    return diff.edge_diff(old, new)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n0, n1, e0, e1 = _versions(spark, sf_dir)
    return diff.impact_seeds(diff.node_diff(n0, n1, _COMPARED), diff.edge_diff(e0, e1))


@query(_SEEDS)
def impact_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir)


@query(
    f""", s AS ({_SEEDS}), x AS (SELECT seed, side, seed AS node FROM s UNION SELECT x.seed, x.side, v.down FROM x JOIN (SELECT *, 'current' AS side FROM f WHERE {_NEW_E} UNION ALL SELECT *, 'baseline' FROM f WHERE {_OLD_E}) v ON v.up = x.node AND v.side = x.side)
SELECT DISTINCT seed, node FROM x WHERE seed <> node"""
)
def impact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, e0, e1 = _versions(spark, sf_dir)
    return diff.impact_map(cut(_seeds(spark, sf_dir)), graph.edge_flow(e0), graph.edge_flow(e1))


@query(
    """SELECT path, state FROM (SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'missing' WHEN b.p IS NULL THEN 'orphaned' WHEN a.s <> b.s THEN 'changed' END AS state
 FROM (SELECT url AS p, sha256(html) AS s FROM pages WHERE page_id % 10 <> 1) a FULL JOIN (SELECT url AS p, sha256(CASE WHEN page_id % 10 = 2 THEN concat(html, ' ') ELSE html END) AS s FROM pages WHERE page_id % 10 <> 3) b ON a.p = b.p) WHERE state IS NOT NULL""",
    False,
)
def stale_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    html = F.when(F.col("page_id") % 10 == 2, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    pick = lambda rows, text: rows.select(F.col("url").alias("path"), names.definition_hash(text).alias("sha"))
    return diff.stale_files(pick(p.where("page_id % 10 <> 1"), F.col("html")), pick(p.where("page_id % 10 <> 3"), html))


_MAPS_SQL = """SELECT 'li' AS k, concat('ord', CAST(l_orderkey AS VARCHAR), '.', l_returnflag) AS down, concat('part', CAST(l_partkey AS VARCHAR), '.price') AS up FROM lineitem
UNION ALL SELECT 'o', concat('cust', CAST(o_custkey AS VARCHAR), '.spend'), concat('ord', CAST(o_orderkey AS VARCHAR), '.', CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'N' END) FROM orders"""


def _column_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer spend from an order's column, which comes from the prices of its parts."""
    ident = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    li = table(spark, sf_dir, "lineitem").select(ident("ord", "l_orderkey").alias("node_id"), F.col("l_returnflag").alias("col"), ident("part", "l_partkey").alias("src_id"), F.lit("price").alias("src_col"))
    o = table(spark, sf_dir, "orders").select(ident("cust", "o_custkey").alias("node_id"), F.lit("spend").alias("col"), ident("ord", "o_orderkey").alias("src_id"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("N").alias("src_col"))
    return li.unionByName(o)


@query(f"WITH m AS ({_MAPS_SQL}) SELECT DISTINCT down AS root, up AS node, 1 AS depth FROM m WHERE k = 'o' UNION SELECT DISTINCT a.down, b.up, 2 FROM m a JOIN m b ON a.up = b.down WHERE a.k = 'o' AND b.k = 'li'", False)
def column_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "orders").select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit(".spend")).alias("root"))
    return closure.column_trace(_column_maps(spark, sf_dir), roots)


@query(f"WITH m AS (SELECT DISTINCT down, up FROM ({_MAPS_SQL})) SELECT down AS target, string_agg(up, ',' ORDER BY up) AS sources FROM m GROUP BY 1", False)
def dml_sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _column_maps(spark, sf_dir).select(F.concat_ws(".", "node_id", "col").alias("target"), F.concat_ws(".", "src_id", "src_col").alias("s"))
    return m.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))


# --- names and files -------------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN schema_name <> '' THEN concat(node_type, ':', lower(schema_name), '.', lower(name)) ELSE concat(node_type, ':', lower(name)) END AS made FROM n")
def make_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate.nodes(spark, sf_dir).select("id", names.make_id(F.col("node_type"), F.col("schema_name"), F.col("name")).alias("made"))


_RAW = "concat('[', p_brand, '].\"', p_type, '\".[', p_name, '.x]')"


@query(f"SELECT p_partkey, lower(trim(regexp_replace({_RAW}, '[\\[\\]\"''`]', '', 'g'))) AS name FROM part", False)
def normalize_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.normalize_identifier(F.expr(_RAW)).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'dbo' ELSE lower(concat(p_brand, '.', p_type)) END AS schema_name, lower(concat(p_name, '.x')) AS name FROM part", False)
def qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 2 == 0, F.expr("concat('[', p_name, '.x]')")).otherwise(F.expr(_RAW))
    return table(spark, sf_dir, "part").select("p_partkey", names.qualify(raw).alias("q")).select("p_partkey", "q.schema_name", "q.name")


@query(
    """SELECT id, concat(CASE WHEN s <> '' THEN s ELSE node_type END, '-', left(sha1(id), 8)) AS slug FROM (
 SELECT id, node_type, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(id), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^[-. ]+|[-. ]+$', '', 'g'), 80), '[-. ]+$', '', 'g') AS s FROM n)"""
)
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate.nodes(spark, sf_dir).select("id", names.slug(F.col("id"), F.col("node_type")).alias("slug"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents", False)
def definition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", names.definition_hash(F.col("text")).alias("sha"))


@query("SELECT page_id, concat_ws(chr(31), '1', 'tsql', 'objects', concat_ws('/', 'web', url), sha256(html)) AS key FROM pages", False)
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.cache_key("1", "tsql", "objects", F.lit("web"), F.col("url"), names.definition_hash(F.col("html"))).alias("key"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('''', '=', c_name) WHEN c_custkey % 4 = 1 THEN concat('''', '  -', c_name) ELSE c_name END AS cell FROM customer", False)
def csv_neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    cell = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, F.concat(F.lit("  -"), "c_name")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.csv_neutralize(cell).alias("cell"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\\|'), '[\\r\\n]+', ' ', 'g')) AS cell FROM pages", False)
def md_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.md_cell(F.col("html")).alias("cell"))


_PATH = "concat(url, CASE page_id % 10 WHEN 0 THEN '.SQL' WHEN 1 THEN '.tmdl' WHEN 2 THEN '/definition/report.json' WHEN 3 THEN '/report.json' WHEN 4 THEN '/definition/pages/p1/visuals/v/visual.json' WHEN 5 THEN '/definition.pbir' WHEN 6 THEN '.bim' WHEN 7 THEN '/definition/pages/p1/page.json' WHEN 8 THEN '/visual.json' ELSE '/definition/x/report.json' END)"


@query(
    "SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'sql_file' WHEN 1 THEN 'tmdl' WHEN 2 THEN 'pbir_report' WHEN 3 THEN 'report_json_legacy' WHEN 4 THEN 'pbir_visual' WHEN 5 THEN 'pbir_definition' WHEN 6 THEN 'bim' WHEN 7 THEN 'pbir_page' END AS kind FROM pages",
    False,
)
def file_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visual.json outside of pages and a report.json deeper under definition are no report files."""
    return table(spark, sf_dir, "pages").select("page_id", names.file_kind(F.expr(_PATH)).alias("kind"))


@query("SELECT page_id, url FROM pages WHERE (regexp_matches(url, '(?i)^http://.*example\\.com/.*') OR regexp_matches(url, '(?i)^(.*/)?en/.*')) AND NOT regexp_matches(url, '(?i).*#top$')", False)
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = names.glob_filter(F.col("url"), ["http://*example.com/*", "**/en/**"], ["*#TOP"])
    return table(spark, sf_dir, "pages").where(want).select("page_id", "url")


@query("SELECT page_id, CAST(3 AS BIGINT) AS n_refs, '[' || url || '],T' || CAST(page_id AS VARCHAR) || '[c],[x]' AS refs FROM pages", False)
def dax_bracket_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a formula made for each page: a bare one named by its link, a column of a table, one behind RETURN."""
    from ..sources.models import dax_refs

    formula = F.concat(F.lit("VAR a = [ "), "url", F.lit("] + T"), F.col("page_id").cast("string"), F.lit('[c] + "[no]" RETURN [x] + [x]'))
    refs = dax_refs(table(spark, sf_dir, "pages").select("page_id", "url", formula.alias("expression")))
    shown = F.concat("table_name", F.lit("["), F.trim("name"), F.lit("]"))
    order = F.when(F.trim("name") == F.col("url"), 0).when(F.col("table_name") != "", 1).otherwise(2)
    g = refs.groupBy("page_id").agg(F.count("*").alias("n_refs"), F.array_sort(F.collect_list(F.struct(order.alias("o"), shown.alias("s")))).alias("r"))
    return g.select("page_id", "n_refs", F.array_join(F.transform("r", lambda x: x["s"]), ",").alias("refs"))


# --- linking ---------------------------------------------------------------------------------------------------------

_ITEMS_SQL = """SELECT concat('item:', CAST(p_partkey AS VARCHAR)) AS key, concat('m', CAST(p_size AS VARCHAR)) AS model,
 CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE lower(replace(p_brand, '#', '_')) END AS schema_name, CASE WHEN p_partkey % 9 = 0 THEN 'Gone' ELSE concat('PART', CAST(p_partkey AS VARCHAR)) END AS name, sha256(concat(p_type, CAST(p_size AS VARCHAR))) AS signature FROM part"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("item:"), k.cast("string")).alias("key"), F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("model"),
        F.when(k % 4 == 0, "none").otherwise(F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))).alias("schema_name"),
        F.when(k % 9 == 0, "Gone").otherwise(F.concat(F.lit("PART"), k.cast("string"))).alias("name"),
        names.definition_hash(F.concat("p_type", F.col("p_size").cast("string"))).alias("signature"),
    )


_MAP_SQL = "SELECT model, schema_name, pos FROM (SELECT concat('m', CAST(p_size AS VARCHAR)) AS model, lower(replace(p_brand, '#', '_')) AS schema_name, min(p_partkey) AS pos FROM part GROUP BY 1, 2)"


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("model"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias("schema_name"), "p_partkey")
    return p.groupBy("model", "schema_name").agg(F.min("p_partkey").alias("pos"))


_EXACT = "SELECT i.key, min(n.id) AS target FROM i JOIN n ON lower(n.schema_name) = lower(i.schema_name) AND lower(n.name) = lower(i.name) WHERE n.node_type <> 'pbi_table' GROUP BY 1"
_RULE = "SELECT i.key, arg_min(n.id, m.pos) AS target FROM i JOIN m ON m.model = i.model JOIN n ON lower(n.schema_name) = lower(m.schema_name) AND lower(n.name) = lower(i.name) GROUP BY 1"
_DECISIONS = "SELECT concat('item:', CAST(p_partkey AS VARCHAR)) AS key, CASE WHEN p_partkey % 15 = 5 THEN NULL WHEN p_partkey % 25 = 0 THEN 'part:-1' ELSE concat('part:', CAST(p_partkey AS VARCHAR)) END AS target, CASE WHEN p_partkey % 10 = 0 THEN 'old' ELSE sha256(concat(p_type, CAST(p_size AS VARCHAR))) END AS signature FROM part WHERE p_partkey % 5 = 0"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = F.concat(F.lit("part:"), k.cast("string"))
    sha = names.definition_hash(F.concat("p_type", F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(
        F.concat(F.lit("item:"), k.cast("string")).alias("key"),
        F.when(k % 15 == 5, F.lit(None)).when(k % 25 == 0, "part:-1").otherwise(part).alias("target"),
        F.when(k % 10 == 0, "old").otherwise(sha).alias("signature"),
    )


@query(f", i AS ({_ITEMS_SQL}) {_EXACT}")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.exact_match(_items(spark, sf_dir), estate.nodes(spark, sf_dir))


@query(f", i AS ({_ITEMS_SQL}), m AS ({_MAP_SQL}) {_RULE}")
def config_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.config_rule_match(_items(spark, sf_dir), estate.nodes(spark, sf_dir), _mappings(spark, sf_dir))


_LADDER = f""", i AS ({_ITEMS_SQL}), m AS ({_MAP_SQL}), d AS ({_DECISIONS}), x AS ({_EXACT}), r AS ({_RULE}), l AS (
SELECT i.key, CASE WHEN d.key IS NOT NULL AND d.signature <> i.signature THEN NULL WHEN d.key IS NOT NULL THEN d.target WHEN x.key IS NOT NULL THEN x.target ELSE r.target END AS target,
 CASE WHEN d.key IS NOT NULL AND d.signature <> i.signature THEN 'review' WHEN d.key IS NOT NULL AND d.target IS NULL THEN 'external' WHEN d.key IS NOT NULL THEN 'cache' WHEN x.key IS NOT NULL THEN 'exact' WHEN r.key IS NOT NULL THEN 'rule' ELSE 'unresolved' END AS method
FROM i LEFT JOIN d ON d.key = i.key LEFT JOIN x ON x.key = i.key LEFT JOIN r ON r.key = i.key)"""


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = _items(spark, sf_dir), estate.nodes(spark, sf_dir)
    return linking.ladder(i, _decisions(spark, sf_dir), linking.exact_match(i, n), linking.config_rule_match(i, n, _mappings(spark, sf_dir)))


@query(_LADDER + " SELECT key, target, method FROM l")
def resolution_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ladder(spark, sf_dir)


@query(_LADDER + " SELECT method, count(*) AS n FROM l GROUP BY 1")
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ladder(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"))


@query(f"WITH i AS ({_ITEMS_SQL}), d AS ({_DECISIONS}) SELECT i.key, i.signature AS now, d.signature AS was FROM i JOIN d ON d.key = i.key WHERE i.signature <> d.signature", False)
def signature_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir).select("key", F.col("signature").alias("was"))
    return _items(spark, sf_dir).join(d, "key").where(~F.col("signature").eqNullSafe(F.col("was"))).select("key", F.col("signature").alias("now"), "was")


@query(f", d AS ({_DECISIONS}) SELECT key, target, signature FROM d WHERE target IS NOT NULL AND target NOT IN (SELECT id FROM n)")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.prune_decisions(_decisions(spark, sf_dir), estate.nodes(spark, sf_dir)).select("key", "target", "signature")


@query("SELECT o_custkey AS table_id, o_orderstatus AS qualified, sha256(string_agg(d, ',' ORDER BY d)) AS signature FROM (SELECT o_custkey, o_orderstatus, concat(o_orderpriority, '|', CAST(o_orderkey AS VARCHAR)) AS d FROM orders) GROUP BY 1, 2", False)
def source_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderstatus").alias("qualified"), F.concat_ws("|", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("definition"))
    return linking.source_signatures(o)


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name against every distinct brand and type; both sides are lists of names, not of rows."""
    p = table(spark, sf_dir, "part")
    items = p.select(F.concat_ws(".", F.lower("p_type"), "p_name").alias("needle")).distinct().select(F.col("needle").alias("key"), "needle")
    candidates = p.select(F.concat_ws(".", F.lower(F.left("p_type", F.lit(6))), F.reverse(F.split("p_name", " "))[0]).alias("qualified")).distinct().select(F.col("qualified").alias("target"), "qualified")
    return linking.best_candidates(items, candidates)


@query()
def fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir).select("key", "rank", "target", "score")


@query()
def best_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.best_and_runner_up(_fuzzy(spark, sf_dir))


_SOURCES_SQL = "SELECT DISTINCT l_partkey AS table_id, concat(lower(l_returnflag), '.', CAST(l_suppkey AS VARCHAR)) AS qualified FROM lineitem"
_LINKS_SQL = "SELECT p_partkey AS table_id FROM part WHERE p_size % 3 = 0"


@query(
    f"""WITH s AS ({_SOURCES_SQL}), q AS (SELECT concat('N.', CAST(s_suppkey AS VARCHAR)) AS query FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 0)
SELECT DISTINCT query, table_id, table_id IN ({_LINKS_SQL}) AS linked FROM q JOIN s ON CASE WHEN contains(query, '.') THEN s.qualified = lower(query) ELSE split_part(s.qualified, '.', -1) = lower(query) END""",
    False,
)
def loaded_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("table_id"), F.concat_ws(".", F.lower("l_returnflag"), F.col("l_suppkey").cast("string")).alias("qualified")).distinct()
    links = table(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("table_id"))
    supplier = table(spark, sf_dir, "supplier")
    q = supplier.select(F.concat(F.lit("N."), F.col("s_suppkey").cast("string")).alias("query")).unionByName(supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").cast("string").alias("query")))
    return quality.loaded_by(s, links, q)


@query(
    """, q AS (SELECT concat('ORDERS:', CAST(s_suppkey AS VARCHAR)) AS query FROM supplier UNION ALL SELECT concat('part', CAST(s_suppkey AS VARCHAR)) FROM supplier UNION ALL SELECT concat('raw.', n_name) FROM nation UNION ALL SELECT upper(left(r_name, 4)) FROM region),
k AS (SELECT id, lower(id) AS i, lower(name) AS a, lower(concat_ws('.', schema_name, name)) AS b FROM n),
h AS (SELECT query, id, 1 AS step FROM q JOIN k ON k.i = lower(query) UNION ALL SELECT query, id, 2 FROM q JOIN k ON k.a = lower(query) UNION ALL SELECT query, id, 2 FROM q JOIN k ON k.b = lower(query)
 UNION ALL SELECT query, id, 3 FROM q JOIN k ON (contains(k.id, lower(query)) OR contains(k.b, lower(query))) WHERE lower(query) NOT IN (SELECT i FROM k UNION SELECT a FROM k UNION SELECT b FROM k))
SELECT DISTINCT query, id FROM h JOIN (SELECT query AS qq, min(step) AS s FROM h GROUP BY 1) ON qq = query AND s = step"""
)
def match_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    q = s.select(F.concat(F.lit("ORDERS:"), "k").alias("query")).unionByName(s.select(F.concat(F.lit("part"), "k").alias("query")))
    q = q.unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("raw."), "n_name").alias("query"))).unionByName(table(spark, sf_dir, "region").select(F.upper(F.left("r_name", F.lit(4))).alias("query")))
    return quality.match_nodes(estate.nodes(spark, sf_dir), q)


from . import build_queries, file_queries, page_queries, report_queries, usage_queries  # noqa: E402,F401  these register their queries
