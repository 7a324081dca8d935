"""Files, scripts, models and reports, and extraction that remembers."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from tributary.operators import statements
from tributary.sources import files, models, sinks
from tributary.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def scripts(spark, *texts):
    return statements.statements(spark.createDataFrame([("r", f"{i}.sql", t) for i, t in enumerate(texts)], "repo_key string, path string, text string"))


def lineage(spark, text):
    return {(d, f"{s}.{n}") for d, s, n in rows(statements.statement_lineage(scripts(spark, text)).select("direction", "schema_name", "name"))}


def test_statement_lineage(spark):
    assert lineage(spark, "INSERT INTO mart.f SELECT * FROM [stg].[x y] s JOIN dim d ON 1=1") == {("writes", "mart.f"), ("reads", "stg.x y"), ("reads", "dbo.dim")}
    assert lineage(spark, "UPDATE a SET x = 1 FROM mart.f AS a JOIN src.b b ON a.i = b.i") == {("writes", "mart.f"), ("reads", "src.b")}
    assert lineage(spark, "WITH c AS (SELECT * FROM base.t) MERGE INTO mart.f USING c ON 1=1") == {("writes", "mart.f"), ("reads", "base.t")}
    assert lineage(spark, "SELECT * INTO #tmp FROM a.b; DELETE FROM x.y; TRUNCATE TABLE z.z") == {("reads", "a.b"), ("writes", "x.y"), ("writes", "z.z")}
    assert lineage(spark, "SELECT 'FROM no.no' AS s -- FROM no.no\n/* FROM /* no.no */ x */ FROM yes.yes") == {("reads", "yes.yes")}
    assert lineage(spark, "INSERT INTO lnk.db.dbo.t SELECT 1 FROM db2.dbo.u") == {("writes", "lnk.db.dbo.t"), ("reads", "db2.dbo.u")}
    assert lineage(spark, "EXEC sp_executesql N'INSERT INTO a.b SELECT 1'") == set()


def test_definitions_and_calls(spark):
    s = scripts(spark, "CREATE OR ALTER VIEW [s].[V] AS SELECT 1 FROM t\nGO\nCREATE TABLE t2 (a int)\ngo\nCREATE PROC p AS EXEC dbo.q; EXEC @r = w; EXECUTE AS OWNER; EXEC(@sql)")
    assert rows(statements.definitions(s).select("node_type", "schema_name", "name")) == [("gold_table", "dbo", "t2"), ("stored_proc", "dbo", "p"), ("view", "s", "v")]
    assert rows(statements.callees(s).select("name")) == [("q",), ("w",)]
    assert statements.dynamic_sql(s).count() == 1


def test_crawl_and_decode(spark, tmp_path):
    for path, raw in {"a/T.SQL": "x\r\ny".encode("utf-16"), ".git/h.sql": b"no", "archive/o.sql": b"old", "n.txt": b"no", "m.tmdl": b"\xef\xbb\xbftable T", "d/definition.pbir": b"{}", "_u.sql": b"\xffbad"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    (tmp_path / "big.sql").write_bytes(b"-" * (files.MOST_BYTES + 1))
    found, bad = files.crawl(spark, {"r": str(tmp_path)}, include=["**/*.sql", "*.tmdl"], exclude=["archive/**"])
    texts = {r.path: (r.kind, r.text) for r in files.read_files(found).collect()}
    assert texts == {"a/T.SQL": ("sql_file", "x\ny"), "m.tmdl": ("tmdl", "table T"), "d/definition.pbir": ("pbir_definition", "{}"), "_u.sql": ("sql_file", "�bad")}
    assert [(r.file, r.category) for r in bad.collect()] == [("big.sql", "file_too_large")]
    assert files.decode_text("é".encode("utf-32")) == "é"


def test_tom(spark):
    model = {"name": "Sales", "model": {"tables": [{"name": "F", "columns": [{"name": "a", "dataType": "int64", "isHidden": True}, {"name": "b", "type": "calculated", "expression": ["x", "y"]}], "measures": [{"name": "M", "expression": "SUM(F[a])"}], "partitions": [{"name": "p", "mode": "import", "source": {"type": "m", "expression": ["let", "in x"]}}]}], "relationships": [{"fromTable": "F", "fromColumn": "a", "toTable": "D", "toColumn": "k", "isActive": False}]}}
    t = models.tom(spark.createDataFrame([("r", "x/Sales.bim", json.dumps(model)), ("r", "bad.bim", "{oops")], "repo_key string, path string, text string"))
    assert rows(t["columns"].select("name", "data_type", "hidden", "calculated", "expression")) == [("a", "int64", True, False, None), ("b", "", False, True, "x\ny")]
    assert rows(t["partitions"].select("mode", "type", "expression")) == [("import", "m", "let\nin x")]
    assert rows(t["relationships"].select("from", "to", "active", "bidirectional")) == [("F.a", "D.k", False, False)]
    assert rows(t["measures"].select("table", "name")) == [("F", "M")] and rows(t["warnings"].select("file")) == [("bad.bim",)]


TMDL = """/// Sales facts
table 'Fact Sales'
\tmeasure Total = SUM('Fact Sales'[Amt])
\t\tformatString: 0

\tmeasure Long =
\t\t\tVAR x = 1
\t\t\tRETURN x

\tcolumn Amt
\t\tdataType: decimal
\t\tisHidden

\tpartition p = m
\t\tmode: import
\t\tsource =
\t\t\t\tlet
\t\t\t\t\tS = 1
\t\t\t\tin S
relationship r1
\tfromColumn: 'Fact Sales'.k
\ttoColumn: Dim.k
"""


def test_tmdl(spark):
    df = models.tmdl(spark.createDataFrame([("r", "t.tmdl", TMDL)], "repo_key string, path string, text string"))
    got = {(r.kind, r.name): (r.table_name, r.value, json.loads(r.properties)) for r in df.collect()}
    assert got["table", "Fact Sales"] == ("Fact Sales", "", {"description": "Sales facts"})
    assert got["measure", "Total"] == ("Fact Sales", "SUM('Fact Sales'[Amt])", {"formatString": "0"})
    assert got["measure", "Long"][1] == "VAR x = 1\nRETURN x"
    assert got["column", "Amt"][2] == {"dataType": "decimal", "isHidden": True}
    assert got["partition", "p"][1].split() == ["let", "S", "=", "1", "in", "S"] and got["partition", "p"][2]["mode"] == "import"
    assert got["relationship", "r1"][2] == {"fromColumn": "'Fact Sales'.k", "toColumn": "Dim.k"}


def field(kind, entity, name):
    return {kind: {"Expression": {"SourceRef": {"Entity": entity}}, "Property": name}}


def test_report_bindings(spark):
    visual = {"visual": {"query": [field("Measure", "F", "Total"), field("Column", "D", "k")]}, "filterConfig": {"filters": [{"field": field("Column", "D", "y")}]}}
    legacy = {"sections": [{"visualContainers": [{"config": json.dumps({"From": [{"Name": "s", "Entity": "F"}], "Select": [{"Column": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "a"}}]})}]}]}
    df = models.report_bindings(spark.createDataFrame([("r", "v", json.dumps(visual)), ("r", "l", json.dumps(legacy)), ("r", "b", "nope")], "repo_key string, path string, text string"))
    got = df.where("problem = ''").select("path", "entity", "property", "kind", "role")
    assert rows(got) == [("l", "F", "a", "column", "visual"), ("v", "D", "k", "column", "visual"), ("v", "D", "y", "column", "filter"), ("v", "F", "Total", "measure", "visual")]
    assert rows(df.where("problem <> ''").select("path")) == [("b",)]


def test_archives(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("Formulas/Section1.m", 'section S; shared A = Sql.Database("x;y", "d"); shared #"B b" = 2;')
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("Report/Layout", json.dumps({"q": field("Column", "T", "c")}).encode("utf-16-le"))
        z.writestr("DataMashup", b"\0\0\0\0head" + inner.getvalue())
    df = models.archives(spark.createDataFrame([("r", "a.pbix", outer.getvalue()), ("r", "b.pbix", b"no zip")], "repo_key string, path string, content binary"))
    assert rows(df.where("problem = ''").select("what", "name", "text")) == [("binding", "T", ""), ("expression", "A", 'Sql.Database("x;y", "d")'), ("expression", "B b", "2")]
    assert df.where("problem <> ''").count() == 1


def test_declared_models(spark):
    texts = [{"datasetReference": {"byPath": {"path": "../Sales.SemanticModel"}}}, {"datasetReference": {"byConnection": {"connectionString": "Data Source=x;Initial Catalog=\"HR\";y=1"}}}, {}]
    df = spark.createDataFrame([(str(i), json.dumps(t)) for i, t in enumerate(texts)], "path string, text string")
    assert rows(df.select("path", models.declared_model(F.col("text"), F.col("path")))) == [("0", "Sales"), ("1", "HR"), ("2", None)]


def test_m_and_dax(spark):
    m = spark.createDataFrame([(1, 'S{[Item="T",Schema="s"]} // {[Schema="n",Item="n"]}'), (2, 'Sql.Database("a","b",[Query="SELECT 1 FROM q.t#(lf) JOIN ""w"".z ON 1=1"])')], "id int, expression string")
    assert rows(models.m_sources(m).select("id", "schema_name", "name", "raw_kind")) == [(1, "s", "t", "navigation"), (2, "q", "t", "native_query"), (2, "w", "z", "native_query")]
    d = spark.createDataFrame([(1, "VAR x = [A] RETURN [B] + 'T t'[C] + U[D] & \"[no]\" -- [no]")], "id int, expression string")
    assert rows(models.dax_refs(d).select("table_name", "name")) == [("", "A"), ("", "B"), ("T t", "C"), ("U", "D")]


def test_extraction_is_remembered(spark, tmp_path):
    seen = []

    def extract(fresh):
        seen.append(fresh.count())
        return statements.statement_lineage(fresh.select("cache_key", "path", F.explode(F.split("text", ";")).alias("sql")))

    make = lambda *t: spark.createDataFrame([("r", f"{i}", x) for i, x in enumerate(t)], "repo_key string, path string, text string")
    store = str(tmp_path / "store")
    cold = rows(incremental.extract_new(make("SELECT 1 FROM a.a", "nothing"), "objects", extract, store))
    warm = rows(incremental.extract_new(make("SELECT 1 FROM a.a", "nothing"), "objects", extract, store))
    changed = rows(incremental.extract_new(make("SELECT 1 FROM b.b", "nothing"), "objects", extract, store))
    assert cold == warm and seen == [2, 0, 1] and [r[-1] for r in changed] == ["b"]


def test_a_stream_gives_the_batch_result(spark, tmp_path):
    make = spark.createDataFrame([("r", "0", "SELECT 1 FROM a.a"), ("r", "1", "SELECT 1 FROM c.c")], "repo_key string, path string, text string")
    make.write.parquet(str(tmp_path / "in"))
    extract = lambda fresh: statements.statement_lineage(fresh.select("cache_key", "path", F.col("text").alias("sql")))
    batch = rows(incremental.extract_new(make, "objects", extract, str(tmp_path / "batch")))
    q = incremental.stream(spark.readStream.schema(make.schema).parquet(str(tmp_path / "in")), "objects", extract, str(tmp_path / "stream"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "stream"))) == batch


def test_graph_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("b", "x", "code"), ("a", None, None)], "id string, name string, source_code string")
    e = spark.createDataFrame([("b", "a", "reads", "=1")], "source_id string, target_id string, edge_type string, evidence string")
    sinks.write_graph_json(n, e, str(tmp_path / "g"))
    nodes, edges = sinks.read_graph_json(spark, str(tmp_path / "g"), "id string, name string", "source_id string, target_id string, edge_type string, evidence string")
    assert {tuple(r) for r in nodes.collect()} == {("b", "x"), ("a", None)} and rows(edges) == rows(e)
    assert rows(sinks.edges_export(e)) == [("b", "a", "reads", "'=1")]
    sinks.write_csv(sinks.edges_export(e), str(tmp_path / "csv"), ["source", "target"])
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 1
