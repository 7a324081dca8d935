"""Work that must not grow faster than the input: how many rows the steps of operators make."""

import difflib

import pandas as pd

from pyspark.sql import functions as F

from tributary.functions import masks
from tributary.llm import chat
from tributary.operators import closure, diff, graph, linking, pages, partitions, quality, reports, roots, statements, trace
from tributary.plans import build, build_queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_filters_pair_with_models_not_with_tables(spark, monkeypatch):
    tables = spark.range(200).selectExpr("'e' as entity", "cast(id as string) as table_id", "concat('m', cast(id % 2 as string)) as model")
    filters = spark.range(50).selectExpr("cast(id as string) as source_id", "id as report", "case when id = 0 then 'one' else 'e' end as entity", "'x' as property", "'column' as kind", "'page' as scope")
    one = spark.createDataFrame([("one", "t", "m9"), ("one", "t", "m9")], "entity string, table_id string, model string")
    none = spark.createDataFrame([], "model string, name string, measure_id string")
    seen, single = [], reports._single
    monkeypatch.setattr(reports, "_single", lambda pairs, by: seen.append(pairs.count()) or single(pairs, by))
    refs, warnings = reports.filter_fields(filters, tables.unionByName(one), none, spark.createDataFrame([(1, "m0")], "report long, model string"))
    assert max(seen) <= 50 * 2
    assert [tuple(r) for r in refs.select("report", "target").collect()] == [(0, "t")]
    assert {r[0] for r in warnings.select("message").collect()} == {"page filter e.x may mean tables of 200 models"}


def test_ancestry_walks_no_node_s_other_children(spark, monkeypatch):
    flow = spark.range(40).selectExpr("'hub' as up", "concat('r', cast(id as string)) as down").union(spark.sql("select 'top', 'hub'"))
    roots = flow.where("up = 'hub'").select(flow["down"].alias("root"))
    walked = []
    monkeypatch.setattr(pages, "closure", lambda *a, **k: walked.append(k) or closure.closure(*a, **k))
    got = rows(pages.ancestry(flow, roots))
    assert got == sorted([(f"r{i}", "hub", 1, f"r{i}") for i in range(40)] + [(f"r{i}", "top", 2, "hub") for i in range(40)])
    assert walked == [{"parents": True}]  # parents come with the walk, not from a join with all children of each node


def test_pieces_that_no_query_has_are_not_moved(spark, monkeypatch):
    nodes = spark.range(300).selectExpr("concat('n:', cast(id as string)) as id", "concat('Name ', cast(id * 7 as string)) as name", "'Some.Schema' as schema_name")
    queries = spark.createDataFrame([("AME 21",), ("n:5",), ("zzzz",), ("",), ("9",)], "query string")
    kept, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df: kept.append(cut(df)) or kept[-1], raising=False)
    got = rows(quality.match_nodes(nodes, queries))
    full = {f"n:{i}": (f"name {i * 7}", f"some.schema.name {i * 7}") for i in range(300)}
    want = [("n:5", "n:5")] + [(q, i) for q in ("AME 21", "9") for i, names in full.items() if any(q.lower() in t for t in (i, *names))]
    assert got == sorted(want)
    pieces = max((df.count() for df in kept if "gram" in df.columns and "full" in df.columns), default=10**9)
    assert pieces < 300 * 12  # of about 300 * 40


def test_long_conversations_are_checked_whole(monkeypatch):
    """A template that marks the first turn of long conversations only rewrites history, however long the texts are."""
    monkeypatch.setattr(chat, "HELD", 10)
    late = lambda turns: ("LONG " if len(turns) > 18 else "") + chat.template(turns)
    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(20)]
    r = chat.Rendered(turns, late)
    assert r.rewrites == 1 and r.text == late(turns)


def test_digests_are_checked_whole(monkeypatch):
    """The same for digests: whole prefixes are rendered, those of turns in the file too, and a rewritten history is told."""
    monkeypatch.setattr(chat, "HELD", 50)
    seen = []

    def late(turns):
        seen.append(len(turns))
        return (["LONG "] if len(turns) > 18 else []) + list(chat.pieces(turns))

    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k} \ud800<|") for k in range(20)]
    got, plain = chat.digest_row(iter(turns), late), chat.digest_row(iter(turns))
    assert {1, 2, 4, 8, 16, 20} <= set(seen)
    assert got[-1] == 1 and got[4] == len("".join(late(turns))) == plain[4] + 5
    assert got[:4] == plain[:4] and plain[-1] == 0


def test_files_are_not_broadcast_to_their_roots(spark):
    """The planner takes exploded paths for small; neither they nor their folders may go through the driver."""
    files = spark.range(50).selectExpr("'r' as repo_key", "concat('a/m', cast(id % 5 as string), '.x/d/', cast(id as string), '.tmdl') as path", "repeat('t', 100) as text")
    top = spark.range(5).selectExpr("'r' as repo_key", "concat('a/m', cast(id as string), '.x') as root", "cast(id as string) as owner")
    got = roots.nearest(files, top)
    assert {(r.path, r.root) for r in got.collect()} == {(f"a/m{i % 5}.x/d/{i}.tmdl", f"a/m{i % 5}.x") for i in range(50)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_column_trace_reads_its_flow_once(spark):
    """However many rounds a trace takes, and hops in each."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        read.add(1)
        return x

    flow = spark.range(5).selectExpr("concat('n', cast(id + 1 as string)) as up", "concat('n', cast(id as string)) as down").repartition(1).withColumn("up", counted("up"))
    nodes = spark.range(6).selectExpr("concat('n', cast(id as string)) as id").selectExpr("id", "id as name", "id as qualified")
    own = spark.range(5).selectExpr("concat('n', cast(id as string)) as node_id", "'c' as col", "concat('n', cast(id + 1 as string), '.c') as source")
    got = trace.column_sources(spark.createDataFrame([("n0", "c")], "root string, col string"), own, own.where("false"), flow, nodes)
    assert rows(got) == [("n0", "c", "n5.c")]
    assert read.value <= 5


def test_names_of_few_other_characters_are_not_looked_up(spark, monkeypatch):
    """Numbered names share nearly all characters and pairs; their index is for what is further away only."""
    names = [f"rep.v{n}" for n in range(300)] + ["rep.v", "other.name", ""]
    needles = [f"rep.v{n}x" for n in range(100, 120)] + ["othr.nome", "rep.v120", "a" * 40, ""]
    i = spark.createDataFrame([(f"k{n}", t) for n, t in enumerate(needles)], "key string, needle string")
    c = spark.createDataFrame([(f"t{n:03d}", t) for n, t in enumerate(names)], "target string, qualified string")
    looked_up, meeting = [], linking._meeting
    monkeypatch.setattr(linking, "_meeting", lambda wanted, *a: looked_up.extend(r.key for r in wanted.collect()) or meeting(wanted, *a))
    got = sorted((r.key, r["rank"], r.target, r.score) for r in linking.best_candidates(i, c, 2).collect())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    best = lambda t: sorted((-ratio(t, q), f"t{n:03d}") for n, q in enumerate(names))[:2]
    assert got == sorted((f"k{n}", r + 1, t, -s) for n, needle in enumerate(needles) for r, (s, t) in enumerate(best(needle)))
    assert {"k20", "k22"} <= set(looked_up) <= {"k20", "k22", "k23"}


def test_nodes_and_warnings_need_no_links(spark, monkeypatch):
    """What a query of the graph does not return is not made for it."""

    def not_needed(*a, **k):
        raise AssertionError("not needed")

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(reports, "shown_fields", not_needed)
    monkeypatch.setattr(partitions, "attach", not_needed)
    monkeypatch.setattr(linking, "ladder", not_needed)
    assert build_queries.build_nodes(spark, sf).where("node_type = 'view'").count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    monkeypatch.undo()
    monkeypatch.setattr(statements, "statement_lineage", not_needed)
    monkeypatch.setattr(statements, "owners", not_needed)
    monkeypatch.setattr(linking, "ladder", not_needed)
    assert build_queries.build_warnings(spark, sf).where("category = 'dynamic_sql'").count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_entities_of_one_table_need_no_pairs(spark, monkeypatch):
    """Only bindings whose entity several tables have are paired with models; what the others settle still counts for them."""
    tables = spark.createDataFrame([("Sales", "a.Sales", "a"), ("Date", "a.Date", "a"), ("Date", "b.Date", "b"), ("Own", "x.own", "X"), ("own", "x.own", "x")], "entity string, table_id string, model string")
    shown = spark.createDataFrame([(f"v{n}", r, e, "p", k, "shown") for n, (r, e, k) in enumerate([("r1", "Sales", "measure"), ("r1", "Date", "column"), ("r2", "Date", "column"), ("r3", "Date", "column"), ("r4", "Own", "column"), ("r4", "Gone", "column")])], "source_id string, report string, entity string, property string, kind string, role string")
    measures = spark.createDataFrame([("a", "P", "m:a.p")], "model string, name string, measure_id string")
    paired, resolve = [], reports.resolve_bindings
    monkeypatch.setattr(reports, "resolve_bindings", lambda b, *a: paired.extend(r.entity for r in b.collect()) or resolve(b, *a))
    refs, left, drawn = reports.shown_fields(shown, tables, measures, spark.createDataFrame([("r2", "b")], "report string, model string"))
    assert set(paired) == {"Date"}
    assert rows(refs.select("source_id", "target", "kind")) == [("v0", "a.Sales", "measure"), ("v0", "m:a.p", "measure"), ("v1", "a.Date", "column"), ("v2", "b.Date", "column"), ("v4", "x.own", "column")]
    assert rows(left.select("source_id", "entity")) == [("v3", "Date"), ("v5", "Gone")]
    assert rows(drawn) == [("r1", "a"), ("r2", "b"), ("r4", "X"), ("r4", "x")]


def test_equal_statements_are_folded_once(monkeypatch):
    """Scripts repeat what they set, run and print; a batch folds each such statement once."""
    folded, fold = [], masks._folded
    monkeypatch.setattr(masks, "_folded", lambda m: folded.append(m) or fold(m))
    given = ["set nocount on", None, "select a from t"] * 50
    got = masks.sql_folded.func(pd.Series(given)).tolist()
    assert got == [fold(m) for m in given] and len(folded) == 3


def test_references_and_edges_meet_in_small_parts(spark):
    """Neither may names that columns are made of go through the driver, nor a task hold what a block of a file gives."""
    names = spark.range(40).selectExpr("id", "'m' as model", "concat('t', cast(id % 3 as string)) as table_name", "concat('N', cast(id as string)) as name")
    refs = names.selectExpr("id + 100 as source_id", "model", "case when id % 2 = 0 then '' else upper(table_name) end as table_name", "lower(name) as name")
    links = pages.measure_links(refs, names, names.where("id % 5 = 0"))
    assert rows(links) == [(i + 100, i) for i in range(40) if i % 2 == 0 or i % 5]
    edges = spark.range(40).selectExpr("cast(id as string) as source_id", "cast((id + 3) % 40 as string) as target_id", "id as ord")
    kept = spark.range(20).selectExpr("cast(id as string) as id")
    inside = graph.subgraph(kept, edges, kept.union(kept))[1]
    assert rows(inside) == sorted((str(i), str(i + 3), i) for i in range(17))
    for made in (links, inside):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "REPARTITION_BY_NUM" in plan


def test_a_walk_moves_neither_its_steps_nor_what_it_met(spark, monkeypatch):
    """Steps that two graphs share are there once, and joins take them and all that was met as they lie, round after round."""
    old = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y"), ("c", "e")]
    new = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "x"), ("d", "f")]
    seeds = [("a", "baseline"), ("a", "current"), ("c", "current"), ("x", "baseline"), ("gone", "current")]
    flow = lambda edges: spark.createDataFrame(edges, "up string, down string")
    steps, laid, met = [], closure.laid, []
    monkeypatch.setattr(closure, "laid", lambda *a, **k: steps.append(laid(*a, **k)) or steps[-1])

    class Kept(closure.Laid):
        def add(self, df):
            met.append(df._jdf.queryExecution().executedPlan().toString())
            return super().add(df)

    monkeypatch.setattr(closure, "Laid", Kept)
    got = rows(diff.impact_map(spark.createDataFrame(seeds, "seed string, side string"), flow(old), flow(new)))
    want = set()
    for seed, side in seeds:
        edges, front, seen = old if side == "baseline" else new, {seed}, {seed}
        while front:
            front = {b for a, b in edges if a in front} - seen
            seen |= front
        want |= {(seed, node) for node in seen - {seed}}
    assert got == sorted(want)
    assert [s.count() for s in steps] == [8]
    # the front by where it is, and what it meets by root and node, in these tests' few parts once more
    assert len(met) > 3 and all(plan.count("Exchange") <= 3 for plan in met[1:])


def test_a_trace_finds_names_once_and_walks_to_no_end(spark, monkeypatch):
    """Whatever its rounds, a trace moves its flow once, and columns in which it ends are never in its front."""
    nodes = [("v", "V", "rep.V"), ("a1", "T", "s.T"), ("a0", "T", "x.T"), ("b", "B", "s.B"), ("c", "C", "s.C")]
    flow = [("a1", "v"), ("p", "v"), ("a0", "p"), ("b", "a1"), ("b", "a0"), ("c", "b"), ("a1", "b")]
    own = [("v", "k", "t.k"), ("v", "k", "s.t.k"), ("v", "k", "plain"), ("a0", "k", "s.b.k"), ("b", "k", "c.z"), ("b", "k", "s.t.k"), ("b", "k", "no.where.k"), ("c", "y", None)]
    loaded = [("v", "k", "s.c.k"), ("a1", "k", "b.k"), ("a1", "k", "b.y")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    near, made, met = trace._near, [], []
    monkeypatch.setattr(trace, "_near", lambda *a: made.append(near(*a)) or made[-1])

    class Kept(trace.Laid):
        def add(self, df):
            met.append({(r.node, r.col) for r in df.select("node", "col").collect()})
            return super().add(df)

    monkeypatch.setattr(trace, "Laid", Kept)
    maps = "node_id string, col string, source string"
    roots = [("v", "K"), ("c", "y"), ("c", "none"), ("zz", "k")]
    got = rows(trace.column_sources(frame(roots, "root string, col string"), frame(own, maps), frame(loaded, maps), frame(flow, "up string, down string"), frame(nodes, "id string, name string, qualified string")))
    # t is a0 (of a0 and a1, two and one steps away), s.t is a1; both lead to b, which goes on to c.z, an end, and back to a1
    assert got == [("c", "none", "s.C.none"), ("c", "y", "s.C.y"), ("v", "K", "no.where.k (unresolved node)"), ("v", "K", "s.B.y"), ("v", "K", "s.C.z")]
    assert len(made) == 1 and met == [{("v", "k"), ("c", "y"), ("c", "none"), ("zz", "k")}, {("a0", "k"), ("a1", "k")}, {("b", "k")}, set()]


def test_links_and_nodes_are_not_broadcast(spark, monkeypatch):
    """Sides that look small when packed are many in one plan of the graph of files; none may go through the driver."""
    plans, real = [], {m: m.cut for m in (build, linking)}
    for m in real:
        monkeypatch.setattr(m, "cut", lambda df, m=m: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real[m](df))
    sql = spark.range(30).selectExpr("concat('view:rep.v', id) as id", "'view' as node_type", "concat('v', id) as name", "'rep' as schema_name", "'f' as source_file")
    sources = spark.range(40).selectExpr("concat('t', id) as table_id", "'rep' as schema_name", "case when id < 20 then concat('v', id) else concat('v', id - 20, 'x') end as name", "'m' as raw_kind", "'h' as expression_hash")
    tables = spark.range(40).selectExpr("concat('t', id) as table_id", "'m' as model")
    links = build.link(sources, tables, sql, build.Links(similar=True))
    plans.append(links._jdf.queryExecution().executedPlan().toString())
    assert {(r.key, r.target, r.method) for r in links.where("method = 'exact'").collect()} == {(f"t{i}", f"view:rep.v{i}", "exact") for i in range(20)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans if "least" not in p and "LocalLimit" not in p and "TakeOrdered" not in p)


def test_a_listing_moves_its_paths_once_a_level(spark, monkeypatch):
    """What was met lies where it was met, and the lines move once, to their root."""
    plans = []

    class Kept(pages.Laid):
        def add(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().add(df)

    monkeypatch.setattr(pages, "Laid", Kept)
    flow = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "a"), ("b", "a"), ("d", "b"), ("c", "d")], "up string, down string")
    got = pages.ancestry_listing(flow, flow.where("down = 'r'").select(flow["down"].alias("root")))
    lines = [("r", 1, 0, "a", ""), ("r", 2, 1, "b", ""), ("r", 3, 2, "d", ""), ("r", 4, 3, "c", ""), ("r", 5, 1, "c", "shown above"), ("r", 6, 0, "b", "shown above")]
    assert [r[:3] for r in rows(got)] == [r[:3] for r in lines]
    assert {(r.node, r.indent, r.note) for r in got.collect()} == {("a", 0, ""), ("b", 1, ""), ("d", 2, ""), ("c", 3, ""), ("c", 1, ""), ("b", 0, "shown above")}
    assert len(plans) == 6 and all(plan.count("Exchange") <= 3 for plan in plans[1:])
    assert got.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
