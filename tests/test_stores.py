"""Files, stores and sinks: round trips, tolerance, and searches against brute force."""

import difflib
import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tributary.operators import linking, quality
from tributary.sources import baseline, catalog, decisions, files, models, sinks


def test_decisions_round_trip(spark, tmp_path):
    path = str(tmp_path / "links.json")
    rows, warnings = decisions.read_decisions(spark, path)
    assert rows.count() == warnings.count() == 0
    new = spark.createDataFrame([("b", "view:s.v", "manual", "sig"), ("a \"q\"", None, "external", None)], "key string, target string, method string, signature string")
    assert decisions.write_decisions(new, path)
    doc = json.load(open(path))
    assert doc == {"version": 1, "mappings": {"a \"q\"": {"method": "external", "target": None}, "b": {"method": "manual", "source_signature": "sig", "target": "view:s.v"}}}
    assert list(doc["mappings"]) == sorted(doc["mappings"])
    back, warnings = decisions.read_decisions(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, new.collect())) and warnings.count() == 0
    more = spark.createDataFrame([("b", None, "external", None), ("c", "x", "manual", "s")], "key string, target string, method string, signature string")
    assert decisions.write_decisions(decisions.merged_decisions(back, more), path)
    assert {r.key: r.target for r in decisions.read_decisions(spark, path)[0].collect()} == {"a \"q\"": None, "b": None, "c": "x"}
    assert not decisions.put_text(spark, "x", "/proc/no/such/file.json")


@pytest.mark.parametrize(("text", "keys", "warned"), [("not json", 0, 1), ("[1]", 0, 1), ('{"version": 2, "mappings": {}}', 0, 1), ('{"version": 1, "mappings": [1]}', 0, 1), ('{"version": 1}', 0, 0), ('{"version": 1, "mappings": {"a": {"target": "t", "method": "manual"}, "b": 5}}', 1, 1)])
def test_unusable_decisions_only_warn(spark, tmp_path, text, keys, warned):
    path = tmp_path / "links.json"
    path.write_text(text)
    rows, warnings = decisions.read_decisions(spark, str(path))
    assert (rows.count(), warnings.count()) == (keys, warned)
    assert {w.category for w in warnings.collect()} <= {"cache_invalid"}


def test_best_candidates_are_those_of_every_comparison(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh._") for _ in range(rng.randint(0, 14)))
    items, candidates = sorted({word() for _ in range(25)}), sorted({word() for _ in range(80)})
    i = spark.createDataFrame([(x, x) for x in items], "key string, needle string")
    c = spark.createDataFrame([(x, x) for x in candidates], "target string, qualified string")
    got = {}
    for r in linking.best_candidates(i, c, 10).collect():
        got.setdefault(r.key, []).append((r["rank"], r.target, round(r.score, 9)))
    for x in items:
        scored = sorted(((-difflib.SequenceMatcher(None, x, y).ratio(), y) for y in candidates))[:10]
        assert sorted(got[x]) == [(k + 1, y, round(-s, 9)) for k, (s, y) in enumerate(scored)]
    every = {(x, y): difflib.SequenceMatcher(None, x, y).ratio() for x in items for y in candidates}
    near = {(r.key, r.target): r.score for r in linking.fuzzy_scores(i, c, 0.6).collect()}
    assert near == pytest.approx({k: v for k, v in every.items() if v >= 0.6})


def test_lookup_by_rarest_piece(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    nodes = spark.createDataFrame([(f"t:{n}", n.upper(), "s") for n in names], "id string, name string, schema_name string")
    asked = sorted({"".join(rng.choice("abcs.t:") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"zz", "zzzz"})
    got = {}
    for r in quality.match_nodes(nodes, spark.createDataFrame([(q,) for q in asked], "query string")).collect():
        got.setdefault(r.query, set()).add(r.id)
    for q in asked:
        by_id = {f"t:{n}" for n in names if f"t:{n}" == q}
        by_name = {f"t:{n}" for n in names if q in (n, f"s.{n}")}
        assert got.get(q, set()) == (by_id or by_name or {f"t:{n}" for n in names if q in f"t:{n}" or q in f"s.{n}"}), q


def test_graph_file_and_baselines(spark, tmp_path):
    nodes = spark.createDataFrame([("view:a.b", "view", "b"), ("t:\"x\\y", "gold_table", "x"), ("measure:m", "measure", "m")], "id string, node_type string, name string")
    edges = spark.createDataFrame([("view:a.b", "measure:m", "feeds", "e"), ("measure:m", "view:a.b", "references", "")], "source_id string, target_id string, edge_type string, evidence string")
    path = str(tmp_path / "graph")
    assert sinks.publish(lambda at: sinks.write_lines(sinks.canonical_json(nodes, edges), at, ["part", "ord"]), path, spark, False)
    whole = "".join(p.read_text() for p in sorted((tmp_path / "graph").glob("part-*")))
    doc = json.loads(whole)
    assert list(doc["nodes"]) == sorted(doc["nodes"]) and len(doc["edges"]) == 2 and doc["nodes"]['t:"x\\y']["name"] == "x"
    n, e = sinks.read_canonical(spark, path, "id string, node_type string, name string", "source_id string, target_id string, edge_type string, evidence string")
    assert sorted(map(tuple, n.select("id", "node_type", "name").collect())) == sorted(map(tuple, nodes.collect())) and sorted(map(tuple, e.select(*edges.columns).collect())) == sorted(map(tuple, edges.collect()))
    # a blocked run, and one that fails, leave the old generation
    assert not sinks.publish(lambda at: None, path, spark, True)
    with pytest.raises(ZeroDivisionError):
        sinks.publish(lambda at: 1 / 0, path, spark, False)
    assert "".join(p.read_text() for p in sorted((tmp_path / "graph").glob("part-*"))) == whole
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "graph.json").write_text(whole)
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=n", "-c", "user.email=e@e", "commit", "-qm", "graph"]):
        subprocess.run(["git", "-C", str(repo), *args], check=True)
    (repo / "graph.json").write_text("{}")
    for n, e in (baseline.from_commit(spark, str(repo), "HEAD", "graph.json"),):
        assert {r.id for r in n.collect()} == set(doc["nodes"]) and e.count() == 2
    assert baseline.from_file(spark, str(repo / "graph.json"))[0].count() == 0
    with pytest.raises(ValueError):
        baseline.from_commit(spark, str(repo), "--output=x", "graph.json")


def test_catalog_lists(spark, tmp_path):
    good = {"version": 1, "dependencies": [{"object": {"schema": "s", "name": "A"}, "references": {"schema": "T", "name": "B", "database": "D", "type": "TABLE"}}, {"object": {"schema": "s", "name": "A"}, "references": {"schema": None, "name": "C"}}, {"object": {"schema": "s", "name": "A"}, "references": {"schema": "x", "name": "q", "type": "SEQUENCE_OBJECT"}}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text('{"version": 9, "dependencies": []}')
    (tmp_path / "c.json").write_text("no")
    entries, warnings = catalog.read_dependencies(spark, [str(tmp_path / f"{x}.json") for x in "abc"])
    assert entries.count() == 3 and {w.category for w in warnings.collect()} == {"catalog_dependencies_unreadable"} and warnings.count() == 2
    nodes = spark.createDataFrame([("1", "s", "a"), ("2", "d.t", "b"), ("3", "z", "c")], "id string, schema_name string, name string")
    edges = spark.createDataFrame([("3", "1")], "source_id string, target_id string")
    assert {tuple(r) for r in catalog.catalog_gaps(entries, nodes, edges).collect()} == {("1", "d.t.b")}
    assert catalog.catalog_gaps(entries, nodes, edges, ["t"]).count() == 0


def test_files_are_read_through_spark(spark, tmp_path):
    for name, raw in (("a b.sql", b"SELECT 1\r\n"), ("_x+[1].sql", "ä".encode("utf-16")), ("out/old.sql", b"no"), ("é%20.sql", b"SELECT 2")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    found, _ = files.crawl(spark, {"r": str(tmp_path)}, exclude=["out/**"])
    got = {r.path: r.text for r in files.read_files(found).collect()}
    assert got == {"a b.sql": "SELECT 1\n", "_x+[1].sql": "ä", "é%20.sql": "SELECT 2"}


def test_m_and_dax_texts(spark):
    m = {
        "bound": ('let Sch = "sales", Itm = "orders", #"My Src" = Sql.Database("a", "b"), T = #"My Src"{[Schema=Sch, Item=Itm]}[Data] in T', {("sales", "orders", "navigation")}),
        "comma": ('S{[Schema="dbo",Item="Fact, x"]}', {("dbo", "fact, x", "navigation")}),
        "native": ('Value.NativeQuery(Sql.Database("s", "d"), "SELECT * FROM nat.q x JOIN ""ext"".z ON 1=1", null)', {("nat", "q", "native_query"), ("ext", "z", "native_query")}),
        "option": ('let q = "SELECT * FROM bb.cc", S = Sql.Database("s", "d", [Query=q]) in S', {("bb", "cc", "native_query")}),
        "model": ('AnalysisServices.Database("powerbi://x", "Up Model")', {("", "Up Model", "as_model")}),
        "lake": ('Lakehouse.Contents(null){[Id="w1"]}[Data]{[Name="T9"]}[Data]', {("w1", "t9", "lakehouse")}),
        "static": ('#table({"a"}, {{1}})', {("", "", "static")}),
        "none": ('Web.Contents("x") // {[Schema="no",Item="no"]}', set()),
        "long": ('let a = "' + "x" * 1_000_000 + '", S = {[Schema="s",Item="t"]} in S', {("s", "t", "navigation")}),
        "doubled": ('let a = "' + '""' * 50_000 + '", S = {[Schema="s",Item="t"]} in S', {("s", "t", "navigation")}),
    }
    rows = models.m_sources(spark.createDataFrame([(k, x) for k, (x, _) in m.items()], "k string, expression string")).collect()
    for k, (_, want) in m.items():
        assert {(r.schema_name, r.name, r.raw_kind) for r in rows if r.k == k} == want, k
    dax = [("a", "m", "VAR dim = 1 RETURN SUMX('O''Neil', [a--b]) + COUNTROWS(Sales) + dim + 'My Sales'[x]"), ("b", "m", '"' + "x" * 1_000_000 + '" & [z]'), ("c", "m", " " * 300_000 + "T[c]")]
    d = spark.createDataFrame(dax, "k string, model string, expression string")
    assert {(r.k, r.table_name, r.name) for r in models.dax_refs(d).collect()} == {("a", "", "a--b"), ("a", "My Sales", "x"), ("b", "", "z"), ("c", "T", "c")}
    known = spark.createDataFrame([("m", "O'Neil"), ("m", "sales"), ("m", "Dim"), ("m", "My"), ("n", "Sales")], "model string, table_name string")
    assert {(r.k, r.table_name) for r in models.dax_tables(d, known).collect()} == {("a", "O'Neil"), ("a", "sales")}
    fenced = "table T\n\tmeasure M = ```\n\t\t\tSUM(x)\n\t\t\t  + 1\n\t\t```\n\t\tformatString: 0\n\tcolumn c\n\t\tdataType: int64\n"
    assert [(k, n, v) for k, _, n, v, _ in models.tmdl_objects(fenced)] == [("table", "T", ""), ("measure", "M", "SUM(x)\n  + 1"), ("column", "c", "")]


def test_quoted_names_keep_their_case(spark):
    df = spark.range(1).select(F.lit("[A.b].[C d]").alias("x"))
    from tributary.functions.names import original_name

    assert df.select(original_name(F.col("x")).alias("n")).collect()[0].n == "C d"


def test_the_index_compares_few_pairs_and_loses_none(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop_") for _ in range(rng.randint(3, 9)))
    names = sorted({f"{word()}.{word()}_{word()}" for _ in range(700)})
    changed = lambda t: "".join(c if rng.random() > 0.06 else rng.choice("xyz") for c in t)
    needles = [changed(rng.choice(names)) for _ in range(40)] + ["", "q", names[0], "zzzz"]
    i = spark.createDataFrame([(f"k{n}", t) for n, t in enumerate(needles)] + [("null", None)], "key string, needle string")
    c = spark.createDataFrame([(f"t{n:04d}", t) for n, t in enumerate(names)] + [("t9", ""), ("t99", None)], "target string, qualified string")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    every = {(f"k{n}", t.target): ratio(needle, t.qualified) for n, needle in enumerate(needles) for t in c.collect() if t.qualified is not None}
    for k in (1, 4):
        want = {}
        for n in range(len(needles)):
            mine = sorted(((-s, t) for (key, t), s in every.items() if key == f"k{n}"))[:k]
            want.update({(f"k{n}", r + 1): (t, -s) for r, (s, t) in enumerate(mine)})
        got = {(r.key, r["rank"]): (r.target, r.score) for r in linking.best_candidates(i, c, k).collect()}
        assert got == want
    assert linking.compared_pairs(i, c, 1).count() < 0.1 * len(every)
    for least in (0.6, 0.7, 0.92):
        assert {(r.key, r.target): r.score for r in linking.fuzzy_scores(i, c, least).collect()} == {p: s for p, s in every.items() if s >= least}


def test_ids_of_any_length_are_read_back(spark, tmp_path):
    ids = ["a" * 2500, "b" * 4500, 'q"\\' * 300_000, "c" * 1_000_000]
    n = spark.createDataFrame([(i, "view") for i in ids], "id string, node_type string")
    e = spark.createDataFrame([(ids[0], ids[3], "reads", "")], "source_id string, target_id string, edge_type string, evidence string")
    sinks.write_lines(sinks.canonical_json(n.withColumn("source_code", F.lit("")), e), str(tmp_path / "g"), ["part", "ord"])
    nodes, edges = sinks.read_canonical(spark, str(tmp_path / "g"), "id string, node_type string", "source_id string, target_id string, edge_type string, evidence string")
    assert {r.id for r in nodes.collect()} == set(ids) and [(r.source_id, r.target_id) for r in edges.collect()] == [(ids[0], ids[3])]


def test_a_store_survives_a_crash_at_each_step(spark, tmp_path):
    path = tmp_path / "d.json"
    assert decisions.put_text(spark, "one", str(path)) and path.read_text() == "one"
    path.rename(tmp_path / "d.json.old")  # a crash after the old file was put aside
    decisions.settle(spark, str(path))
    assert path.read_text() == "one"
    (tmp_path / "d.json.old").write_text("one")  # a crash before the old file was removed
    path.write_text("two")
    assert decisions.put_text(spark, "three", str(path)) and path.read_text() == "three" and not (tmp_path / "d.json.old").exists()
    (tmp_path / "sub").mkdir()
    assert not decisions.put_text(spark, "x", str(tmp_path / "d.json" / "under")) and path.read_text() == "three"
