"""Queries of the way from files to the graph; the files are texts that the tables are written out as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import file_kind
from ..operators import reports, roots
from ..sources import functions, stored
from ..streaming import state
from . import build, from_files
from .queries import query
from .session import checkpoint_folder, table

# Parts are views, and tables of models by size, every odd model nested in the folder of the one before; orders are visuals on
# ten pages of 50 reports. Every tenth table names its view with a letter too many.
_VIEW = "CREATE VIEW rep.v%d AS SELECT a.x FROM raw.c%d a JOIN sys.objects o ON o.k = a.k"
_TABLE = """table T%d
\tmeasure M%d = SUM(t%d[A]) + [m%d]

\tcolumn a
\t\tdataType: int64

\tpartition p%d = m
\t\tmode: import
\t\tsource =
\t\t\tlet
\t\t\t\tSource = Sql.Database("s", "d"),
\t\t\t\tUnused = Source{[Schema="rep",Item="v%d"]}[Data],
\t\t\t\tData = Source{[Schema="rep",Item="v%d%s"]}[Data]
\t\t\tin
\t\t\t\tData
"""
_VISUAL = '{"name": "v%d", "visual": {"query": {"Column": {"Expression": {"SourceRef": {"Entity": "T%d"}}, "Property": "a"}}}}'


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_size as s")
    k, s = F.col("k"), F.col("s")
    outer = F.when(s % 2 == 1, F.format_string("models/m%d.SemanticModel/inner/", s - 1)).otherwise("models/")
    tmdl = F.format_string(_TABLE, k, k, k, k - 50, k, k + 1, k, F.when(k % 10 == 0, "x").otherwise(""))
    file = lambda df, path, text: df.select(F.lit("r").alias("repo_key"), path.alias("path"), text.alias("text"))
    out = file(p, F.format_string("db/v%d.sql", k), F.format_string(_VIEW, k, k % 40))
    out = out.unionByName(file(p, F.concat(outer, F.format_string("m%d.SemanticModel/definition/tables/t%d.tmdl", s, k)), tmdl))
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as c")
    page = F.format_string("bi/R%d.Report/definition/pages/p%d/", k % 50, k % 10)
    out = out.unionByName(file(o, F.concat(page, F.format_string("visuals/v%d/visual.json", k)), F.format_string(_VISUAL, k, F.col("c"))))
    out = out.unionByName(file(o.select(F.col("k") % 50 % 10, page.alias("page")).toDF("n", "page").distinct(), F.concat("page", F.lit("page.json")), F.format_string('{"displayName": "Page %d"}', F.col("n"))))
    return out.withColumn("kind", file_kind(F.col("path"))).repartition(spark.sparkContext.defaultParallelism, "path")


_P = "p AS (SELECT p_partkey AS k, 'm' || CAST(p_size AS VARCHAR) AS model, 'pbi_table:m' || CAST(p_size AS VARCHAR) || '.t' || CAST(p_partkey AS VARCHAR) AS id, 'measure:m' || CAST(p_size AS VARCHAR) || '.m' || CAST(p_partkey AS VARCHAR) AS mid, 'view:rep.v' || CAST(p_partkey AS VARCHAR) AS v FROM part), o AS (SELECT o_orderkey AS k, 'report:r' || CAST(o_orderkey % 50 AS VARCHAR) AS r, p.id, p.model FROM orders JOIN p ON p.k = o_custkey)"


@query(
    f"""WITH {_P}
SELECT v AS source_id, 'bronze_table:raw.c' || CAST(k % 40 AS VARCHAR) AS target_id, 'reads' AS edge_type FROM p
UNION SELECT id, 'semantic_model:' || model, 'feeds' FROM p UNION SELECT mid, 'semantic_model:' || model, 'feeds' FROM p
UNION SELECT v, id, 'feeds' FROM p UNION SELECT mid, id, 'references' FROM p
UNION SELECT a.mid, b.mid, 'references' FROM p a JOIN p b ON b.k = a.k - 50 AND b.model = a.model
UNION SELECT r, id, 'visualizes' FROM o UNION SELECT 'semantic_model:' || model, r, 'feeds' FROM o""",
    False,
)
def estate_edges_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the whole way: extracted, linked (similar names too), given layers and pruned."""
    return from_files.estate(_files(spark, sf_dir))["edges"].select("source_id", "target_id", "edge_type")


@query(f"WITH {_P} SELECT id AS key, v AS target, CASE WHEN k % 10 = 0 THEN 'fuzzy' ELSE 'exact' END AS method FROM p", False)
def estate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rung of the ladder on which each table's source was found."""
    files = _files(spark, sf_dir)
    m, sql = from_files.model_inputs(files), build.sql_graph(files.where("kind = 'sql_file'"))
    links = build.Links(similar=True)
    return build.model_graph(m["tables"], m["partitions"], m["measures"], lambda: sql["nodes"], m["columns"], links)["links"].select("key", "target", "method")


@query(
    """WITH o AS (SELECT 'r' || CAST(o_orderkey % 50 AS VARCHAR) AS r, o_orderkey % 10 AS n, o_orderkey AS k FROM orders)
SELECT 'visual:' || r || '.p' || CAST(n AS VARCHAR) || '.v' || CAST(k AS VARCHAR) AS source_id, 'report_page:' || r || '.page ' || CAST(n AS VARCHAR) AS target_id FROM o
UNION SELECT 'report_page:' || r || '.page ' || CAST(n AS VARCHAR), 'report:' || r FROM o""",
    False,
)
def page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visuals, pages and reports as their files lie."""
    return reports.chain(from_files.report_visuals(_files(spark, sf_dir)))[1].select("source_id", "target_id")


@query(
    """SELECT 't' || CAST(p_partkey AS VARCHAR) || '.tmdl' AS file, CASE WHEN p_size % 2 = 1 THEN 'models/m' || CAST(p_size - 1 AS VARCHAR) || '.SemanticModel/inner/' ELSE 'models/' END || 'm' || CAST(p_size AS VARCHAR) || '.SemanticModel' AS root, 'm' || CAST(p_size AS VARCHAR) AS owner FROM part""",
    False,
)
def nearest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that each model file belongs to, of models that nest."""
    files = _files(spark, sf_dir)
    return roots.nearest(files.where("kind = 'tmdl'"), roots.model_roots(files)).select(roots.last_part(F.col("path")).alias("file"), "root", "owner")


@query(
    """SELECT 't' || CAST(p_partkey AS VARCHAR) || '.tmdl' AS file, kind, name FROM part, (SELECT unnest(['table', 'measure', 'column', 'partition']) AS kind),
LATERAL (SELECT CASE kind WHEN 'table' THEN 'T' || CAST(p_partkey AS VARCHAR) WHEN 'measure' THEN 'M' || CAST(p_partkey AS VARCHAR) WHEN 'column' THEN 'a' ELSE 'p' || CAST(p_partkey AS VARCHAR) END AS name)""",
    False,
)
def extracted_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model files read by the table function of SQL."""
    functions.register(spark)
    _files(spark, sf_dir).where("kind = 'tmdl'").createOrReplaceTempView("model_files")
    return spark.sql("SELECT regexp_extract(path, '[^/]+$', 0) AS file, kind, name FROM extract(TABLE(SELECT * FROM model_files), 'tmdl') WHERE problem = ''")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A folder of model files that Spark writes: one folder for each size of parts, its tables in one file or several."""
    at = checkpoint_folder(spark)
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_size as s")
    text = F.format_string("table T%d\n\tmeasure M%d = SUM(T%d[A])\n\tcolumn a\n\t\tdataType: int64\n", *["k"] * 3)
    p.select("s", text.alias("text")).repartition("s").write.partitionBy("s").option("maxRecordsPerFile", 10_000).text(at)
    stored.register(spark)
    return at


_STORED = """SELECT 's=' || CAST(p_size AS VARCHAR) AS folder, kind, name FROM part, (SELECT unnest(['table', 'measure', 'column']) AS kind),
LATERAL (SELECT CASE kind WHEN 'table' THEN 'T' || CAST(p_partkey AS VARCHAR) WHEN 'measure' THEN 'M' || CAST(p_partkey AS VARCHAR) ELSE 'a' END AS name)"""
_OBJECTS = ["regexp_extract(path, '^[^/]+', 0) as folder", "kind", "name"]


@query(_STORED, False)
def stored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of stored model files, read by the data source."""
    rows = spark.read.format("estate").options(extract="tmdl", include="**/*.txt").load(_stored(spark, sf_dir))
    return rows.where("problem = ''").selectExpr(*_OBJECTS)


@query(_STORED, False)
def stored_models_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the stream of the data source."""
    at = checkpoint_folder(spark)
    rows = spark.readStream.format("estate").options(extract="tmdl", include="**/*.txt", log=f"{at}/log").load(_stored(spark, sf_dir))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows").where("problem = ''").selectExpr(*_OBJECTS)


# Orders are files whose events come as a stream: each is written, every second one then edited, urgent ones removed at last.
@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS path, value FROM (SELECT o_orderkey, o_orderpriority, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['c' || CAST(o_custkey AS VARCHAR), 'new'] ELSE ['c' || CAST(o_custkey AS VARCHAR), 's' || o_orderstatus] END) AS value FROM orders) WHERE o_orderpriority NOT LIKE '1-%'",
    False,
)
def file_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of edits and removals leaves of all files' contributions."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/orders.parquet")
    reader = spark.readStream.schema(schema)
    # a stream reads folders: the table's, or the one that holds it as a file
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        o = reader.option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    else:
        o = reader.parquet(f"{sf_dir}/orders.parquet")
    even = F.col("o_orderkey") % 2 == 0
    first = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(",s"), "o_orderstatus")
    event = lambda text, seq: F.struct(text.cast("string").alias("text"), F.lit(seq).alias("seq"))
    edit = F.when(even, event(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(",new")), 2))
    gone = F.when(F.col("o_orderpriority").startswith("1-"), event(F.lit(None), 3))
    events = o.select(F.lit("r").alias("repo_key"), F.col("o_orderkey").cast("string").alias("path"), F.explode(F.array_compact(F.array(event(first, 1), edit, gone))).alias("e")).select("repo_key", "path", "e.text", "e.seq")
    at = checkpoint_folder(spark)
    writer = state.changes(events, lambda path, text: text.split(",")).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    writer.start(f"{at}/changes").awaitTermination()
    return state.present(spark.read.schema(state.CHANGES).parquet(f"{at}/changes")).select("path", "value")
