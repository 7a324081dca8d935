"""The way from a tree of files to the graph, on small repositories of every kind of file."""

import json

import pytest

from tributary.operators import roots
from tributary.plans import from_files
from tributary.sources import files, models

SQL = {
    "tables/sales.sql": "CREATE TABLE dbo.FactSales (id INT PRIMARY KEY, amount DECIMAL(10, 2) NOT NULL)\nGO\nCREATE TABLE dbo.Daily AS SELECT * FROM dbo.FactSales",
    "views/v.sql": "CREATE VIEW rep.Sales AS SELECT f.* FROM dbo.FactSales f JOIN stg.customers c ON f.id = c.id\nCREATE VIEW rep.Top AS SELECT * FROM rep.Sales",
    "procs/load.sql": "CREATE PROC etl.load AS\nSELECT * INTO #t FROM src.raw\nINSERT INTO dbo.FactSales SELECT * FROM #t JOIN sys.objects o ON 1 = 1\nEXEC etl.log",
}
TABLE = """table {name}
\tmeasure 'Total {name}' = SUM({name}[amount])

\tcolumn amount
\t\tdataType: decimal

\tpartition p = m
\t\tmode: import
\t\tsource =
\t\t\tlet
\t\t\t\tS = Sql.Database("a", "b"),
\t\t\t\tDead = S{{[Schema="rep",Item="Top"]}}[Data],
\t\t\t\tT = S{{[Schema="{schema}",Item="{item}"]}}[Data]
\t\t\tin
\t\t\t\tT
"""
FIELD = lambda entity, kind, prop: {kind: {"Expression": {"SourceRef": {"Entity": entity}}, "Property": prop}}
BI = {
    "pbi/Sales.SemanticModel/definition/tables/Facts.tmdl": TABLE.format(name="Facts", schema="rep", item="sales"),
    "pbi/Sales.SemanticModel/definition/tables/Near.tmdl": TABLE.format(name="Near", schema="dbo", item="FactSalez"),
    "pbi/Sales.SemanticModel/inner/Deep.SemanticModel/definition/tables/Facts.tmdl": TABLE.format(name="Inner", schema="nowhere", item="xyzzy"),
    "pbi/Sales.Report/definition.pbir": json.dumps({"datasetReference": {"byPath": {"path": "../Sales.SemanticModel"}}}),
    "pbi/Sales.Report/definition/report.json": json.dumps({"filterConfig": {"filters": [{"field": FIELD("Facts", "Column", "amount")}]}}),
    "pbi/Sales.Report/definition/pages/p1/page.json": json.dumps({"displayName": "First Page"}),
    "pbi/Sales.Report/definition/pages/p1/visuals/a1/visual.json": json.dumps({"name": "a1", "visual": {"query": FIELD("Facts", "Measure", "total facts")}}),
    "pbi/Sales.Report/definition/pages/p1/visuals/bad/visual.json": "{not json",
    "legacy/Old/report.json": json.dumps({"filters": "[]", "sections": [{"displayName": "S1", "visualContainers": [{"config": json.dumps({"name": "z", "q": FIELD("Near", "Column", "amount")})}, {"config": "{}"}]}]}),
    "bim/Tab.bim": json.dumps({"name": "Tab", "model": {"tables": [{"name": "Orders", "columns": [{"name": "k"}], "measures": [{"name": "N", "expression": "COUNT(orders[k])"}], "partitions": [{"name": "p", "source": {"type": "query", "query": "SELECT * FROM dbo.Daily"}}]}]}}),
    "archive/skip.sql": "CREATE TABLE no.no (i INT)",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    for path, text in {**SQL, **BI}.items():
        file = at / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return at


@pytest.fixture(scope="module")
def found(spark, tree):
    listed, bad = files.crawl(spark, {"r": str(tree)}, exclude=["archive/**"])
    assert bad.count() == 0
    return files.read_files(listed).select("repo_key", "path", "kind", "text")


def test_the_whole_way(spark, found):
    decisions = spark.createDataFrame([("pbi_table:deep.inner", None, None)], "key string, target string, signature string")
    g = from_files.estate(found, from_files.Settings(layers={"silver": {"schemas": ["stg"]}}, ignore=["etl"], decisions=decisions))
    edges = {(e.source_id, e.target_id, e.edge_type) for e in g["edges"].collect()}
    assert edges >= {
        ("gold_table:dbo.daily", "gold_table:dbo.factsales", "reads"), ("view:rep.sales", "gold_table:dbo.factsales", "reads"), ("view:rep.sales", "silver_table:stg.customers", "reads"),
        ("view:rep.top", "view:rep.sales", "reads"), ("view:rep.sales", "pbi_table:sales.facts", "feeds"), ("gold_table:dbo.factsales", "pbi_table:sales.near", "feeds"),
        ("gold_table:dbo.daily", "pbi_table:tab.orders", "feeds"), ("measure:tab.n", "pbi_table:tab.orders", "references"), ("measure:sales.total facts", "pbi_table:sales.facts", "references"),
        ("report:sales", "pbi_table:sales.facts", "visualizes"), ("report:sales", "measure:sales.total facts", "visualizes"), ("semantic_model:sales", "report:sales", "feeds"), ("report:old", "pbi_table:sales.near", "visualizes"),
    }
    ids = {n.id for n in g["nodes"].collect()}
    assert not any("etl." in i or "sys." in i or "no.no" in i or "rep.top" in t for i in ids for _, t, kind in [e for e in edges if e[2] == "feeds" and e[0] == "view:rep.top"])
    assert {"semantic_model:deep", "pbi_table:deep.inner", "bronze_table:src.raw"} <= ids
    assert {(r.key, r.target, r.method) for r in g["links"].collect()} == {
        ("pbi_table:sales.facts", "view:rep.sales", "exact"), ("pbi_table:sales.near", "gold_table:dbo.factsales", "fuzzy"), ("pbi_table:tab.orders", "gold_table:dbo.daily", "exact"), ("pbi_table:deep.inner", None, "external"),
    }
    warned = {(w.file, w.category) for w in g["warnings"].collect()}
    assert {("pbi_table:sales.near", "fuzzy_auto"), ("pbi/Sales.Report/definition/pages/p1/visuals/bad/visual.json", "report_parse")} <= warned
    assert {(e.source_id, e.target_id) for e in g["chain_edges"].collect()} == {
        ("visual:sales.p1.a1", "report_page:sales.first page"), ("visual:sales.p1.bad", "report_page:sales.first page"), ("report_page:sales.first page", "report:sales"),
        ("visual:old.s1.z", "report_page:old.s1"), ("visual:old.s1.1", "report_page:old.s1"), ("report_page:old.s1", "report:old"),
    }


def test_the_order_of_files_does_not_matter(spark, found):
    rows = lambda g, k: sorted(map(str, g[k].collect()))
    a, b = (from_files.estate(df, from_files.Settings(similar=False)) for df in (found, found.orderBy("path", ascending=False).repartition(5)))
    for k in ("nodes", "edges", "field_refs"):
        assert rows(a, k) == rows(b, k)


def test_the_nearest_root_wins(spark):
    paths = ["a/b/c/f.x", "a/b/f.x", "a/f.x", "f.x", "ab/f.x"]
    f = spark.createDataFrame([("r", p, 1) for p in paths] + [("q", "a/f.x", 2)], "repo_key string, path string, n int")
    r = spark.createDataFrame([("r", "a", "A"), ("r", "a/b/c", "C"), ("r", "a/b/c/f.x", "file"), ("r", "b", "B")], "repo_key string, root string, owner string")
    assert {(x.path, x.root, x.owner, x.n) for x in roots.nearest(f, r).collect()} == {("a/b/c/f.x", "a/b/c", "C", 1), ("a/b/f.x", "a", "A", 1), ("a/f.x", "a", "A", 1)}
    top = spark.createDataFrame([("r", "", "top")], "repo_key string, root string, owner string")
    assert roots.nearest(f, top).count() == 5


def test_legacy_reports_give_pages_visuals_and_filters():
    tree = {"filters": json.dumps([FIELD("T", "Column", "a")]), "sections": [{"name": "n", "filters": json.dumps([FIELD("T", "Column", "b")]), "visualContainers": [{"config": json.dumps({"name": "v", "x": FIELD("U", "Measure", "m")})}]}]}
    assert models.legacy_fields(tree) == [("", "", "T", "a", "column", "filter"), ("n", "", "T", "b", "column", "filter"), ("n", "v", "U", "m", "measure", "visual")]
    assert models.legacy_fields({}) == []
