"""Operators on small graphs, against plain Python, and whatever the order of rows."""

import difflib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators import bindings, closure, diff, graph, layering, linking, quality


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def bfs(edges, root, down=True, depth=None):
    seen, front, out, level = {root}, {root}, {}, 0
    while front and (depth is None or level < depth):
        level += 1
        front = {b if down else a for a, b in edges if (a if down else b) in front} - seen
        seen |= front
        out.update(dict.fromkeys(front, level))
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=25), depth=st.sampled_from([None, 1, 2]), down=st.booleans())
def test_closure_is_a_breadth_first_search(spark, edges, depth, down):
    flow = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "up string, down string")
    roots = spark.createDataFrame([("0",), ("5",), ("99",)], "root string")
    want = sorted((r, n, d) for r in ("0", "5", "99") for n, d in bfs([(str(a), str(b)) for a, b in edges], r, down, depth).items())
    assert rows(closure.closure(flow, roots, "down" if down else "up", depth)) == want


def test_merges_do_not_depend_on_row_order(spark):
    rng = random.Random(1)
    edges = [(rng.choice("ab"), rng.choice("cd"), rng.choice(["reads", "writes"]), rng.choice(["", "x", "y", "z"]), k) for k in range(40)]
    want = {}
    for s, t, k, e, _ in edges:
        want[s, t, k] = want.get((s, t, k)) or e
    schema = "source_id string, target_id string, edge_type string, evidence string, ord bigint"
    for n in (1, 5):
        rng.shuffle(edges)
        assert rows(graph.edge_dedup(spark.createDataFrame(edges, schema).repartition(n))) == sorted((*k, v) for k, v in want.items())


def test_stub_gives_way_to_the_view(spark):
    n = spark.createDataFrame([("gold_table:s.v", "gold_table", "V", "s", ""), ("view:s.v", "view", "v", "s", "f.sql"), ("gold_table:s.t", "gold_table", "t", "s", "")], "id string, node_type string, name string, schema_name string, source_file string")
    e = spark.createDataFrame([("p", "gold_table:s.v", "reads", "", 2), ("p", "view:s.v", "reads", "late", 3), ("view:s.v", "gold_table:s.v", "reads", "self", 1)], "source_id string, target_id string, edge_type string, evidence string, ord bigint")
    assert rows(graph.rename_ends(e, graph.stub_redirects(n))) == [("p", "view:s.v", "reads", "late")]


def test_pruning_rules(spark):
    cases = [("sys", "f", True), ("a.sys", "f", True), ("db_owner", "f", True), ("dbx", "f", True), ("keep", "f", False), ("other.keep", "f", False), ("other.keep", "", True), ("junk", "f", True), ("", "f", False)]
    n = spark.createDataFrame([(str(i), "view", s, f) for i, (s, f, _) in enumerate(cases)] + [("m", "measure", "sys", "f")], "id string, node_type string, schema_name string, source_file string")
    e = spark.createDataFrame([("4", "5", "reads", ""), ("4", "0", "reads", "")], "source_id string, target_id string, edge_type string, evidence string")
    kept, edges = layering.prune_schemas(n, e, ["junk"], ["keep"])
    assert {r.id for r in kept.collect()} == {str(i) for i, c in enumerate(cases) if not c[2]} | {"m"}
    assert rows(edges) == [("4", "5", "reads", "")]


def test_similarity_is_the_matchers(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd.") for _ in range(rng.randint(1, 12)))
    needles, candidates = sorted({word() for _ in range(25)}), sorted({word() for _ in range(25)})
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    items = spark.createDataFrame([(a, a) for a in needles], "key string, needle string")
    targets = spark.createDataFrame([(c, c) for c in candidates], "target string, qualified string")
    for least in (0.3, 0.6):
        got = linking.fuzzy_scores(items, targets, least)
        assert {(r.key, r.target): r.score for r in got.collect()} == {(a, c): ratio(a, c) for a in needles for c in candidates if ratio(a, c) >= least}
    best = {r.key: r for r in linking.best_and_runner_up(linking.best_candidates(items, targets)).collect()}
    for a in needles:
        order = sorted(candidates, key=lambda c: (-ratio(a, c), c))
        assert (best[a].target, best[a].score, best[a].runner_up) == (order[0], ratio(a, order[0]), ratio(a, order[1]))


def test_ladder_never_guesses(spark):
    items = spark.createDataFrame([(k, "s1") for k in ("cached", "changed", "external", "exact", "rule", "fuzzy", "tie", "pending", "none")], "key string, signature string")
    decisions = spark.createDataFrame([("cached", "t0", "s1"), ("changed", "t0", "old"), ("external", None, "s1")], "key string, target string, signature string")
    pair = lambda r: spark.createDataFrame(r, "key string, target string")
    fuzzy = spark.createDataFrame([("fuzzy", "t3", 0.95, 0.9), ("tie", "t3", 0.95, 0.95), ("pending", "t3", 0.7, 0.1), ("none", "t3", 0.2, 0.1)], "key string, target string, score double, runner_up double")
    got = {r.key: (r.target, r.method) for r in linking.ladder(items, decisions, pair([("exact", "t1"), ("cached", "t9")]), pair([("rule", "t2")]), fuzzy).collect()}
    assert got == {
        "cached": ("t0", "cache"), "changed": (None, "review"), "external": (None, "external"), "exact": ("t1", "exact"), "rule": ("t2", "rule"),
        "fuzzy": ("t3", "fuzzy"), "tie": (None, "pending"), "pending": (None, "pending"), "none": (None, "unresolved"),
    }


def test_two_passes_of_bindings(spark):
    b = spark.createDataFrame([("r1", "Sales"), ("r1", "Date"), ("r2", "Date"), ("r3", "Date"), ("r4", "Gone")], "report string, entity string")
    t = spark.createDataFrame([("Sales", "a.Sales", "a"), ("Date", "a.Date", "a"), ("Date", "b.Date", "b")], "entity string, table_id string, model string")
    declared = spark.createDataFrame([("r2", "b")], "report string, model string")
    got = bindings.resolve_bindings(b, t, declared)
    assert rows(got.select("report", "entity", "table_id", "step")) == [("r1", "Date", "a.Date", 2), ("r1", "Sales", "a.Sales", 1), ("r2", "Date", "b.Date", 1)]
    left = rows(bindings.unresolved_rollup(b, t, got))
    assert left == [("r3", "Date", "ambiguous_visual_binding", 1, "a,b"), ("r4", "Gone", "unmatched_visual_entity", 1, "")]


def test_node_diff_is_null_safe(spark):
    schema = "id string, name string, note string"
    old = spark.createDataFrame([("a", "x", None), ("b", "x", None), ("c", None, "n")], schema)
    new = spark.createDataFrame([("a", "x", None), ("b", "x", "now"), ("d", "y", None)], schema)
    assert rows(diff.node_diff(old, new, ["name", "note"])) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_every_category_has_one_severity():
    every = quality.ERRORS + quality.WARNINGS + quality.INFOS
    assert len(every) == len(set(every)) and set(quality.OMISSIONS) | set(quality.STRICT) <= set(every)


def test_gates(spark):
    w = spark.createDataFrame([(c,) for c in ("file_unreadable", "identity_collision", "dynamic_sql", "tmdl_parse", "fuzzy_auto")], "category string")
    of = lambda g: {r.category for r in quality.gate_failures(w, g).collect()}
    assert of("default") == {"file_unreadable", "identity_collision"}
    assert of("strict") == {"file_unreadable", "identity_collision", "dynamic_sql", "tmdl_parse"}
    assert of("lenient") == {"file_unreadable", "identity_collision", "tmdl_parse"}


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("**/*.sql", "a.sql", True), ("**/*.sql", "x/y/A.SQL", True), ("a/**/b.sql", "a/b.sql", True), ("a/**/b.sql", "a/x/y/b.sql", True), ("archive/**", "archive/x.sql", True), ("archive/**", "x/archive.sql", False), ("f[ab].sql", "fb.sql", True), ("f[!ab].sql", "fb.sql", False), ("f?.sql", "f.sql", False)],
)
def test_globs(spark, glob, path, fits):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(F.col("p").rlike(names.glob_regex(glob)).alias("x")).collect()[0].x is fits


def test_ancestries_are_listed_as_a_walk_lists_them(spark):
    import random

    from tributary.operators import pages

    rng = random.Random(9)
    up = {k: sorted({f"n{rng.randrange(k):02d}" for _ in range(rng.randint(0, 3))}) for k in range(1, 26)}
    flow = [(u, f"n{k:02d}") for k, us in up.items() for u in us]
    of = {f"n{k:02d}": us for k, us in up.items()}
    want = []
    for root in of:
        lines, expanded = [], set()

        def walk(node, depth):
            above = of.get(node, [])
            if above and node in expanded:
                lines.append((depth, node, "shown above"))
                return
            lines.append((depth, node, ""))
            expanded.add(node)
            for u in above:
                walk(u, depth + 1)

        for u in of[root]:
            walk(u, 0)
        want += [(root, n + 1, *line) for n, line in enumerate(lines)]
    df = spark.createDataFrame(flow, "up string, down string")
    roots = spark.createDataFrame([(r,) for r in of], "root string")
    got = sorted((r.root, r.line, r.indent, r.node, r.note) for r in pages.ancestry_listing(df, roots, 60).collect())
    assert got == sorted(want)
    shallow = {(r.root, r.line): (r.indent, r.node) for r in pages.ancestry_listing(df, roots, 2).collect()}
    assert max(i for i, _ in shallow.values()) == 1


def test_a_listing_writes_each_object_of_an_ancestry_once(spark, monkeypatch):
    from tributary.operators import pages
    from tributary.plans.session import cut

    rows = []

    def counted(df):
        rows.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(pages, "cut", counted)
    # a chain with a loop at its end, whose last objects come from each other
    flow = [(f"n{k + 1:02d}", f"n{k:02d}") for k in range(9)] + [("n08", "n09")]
    df = spark.createDataFrame(flow, "up string, down string")
    got = [r.node for r in pages.ancestry_listing(df, df.where("down = 'n00'").selectExpr("down as root")).orderBy("line").collect()]
    assert got == [f"n{k:02d}" for k in range(1, 10)] + ["n08"]
    # the steps, and the root and nine objects above it
    assert sum(rows) == len(flow) + 10


def test_nodes_without_a_file_are_nobodys_seeds(spark):
    from tributary.operators import diff

    nodes = lambda rows: spark.createDataFrame(rows, "id string, source_file string")
    old, new = nodes([("a", "f"), ("b", "f"), ("c", ""), ("e", "h")]), nodes([("a", "g"), ("c", ""), ("d", "f"), ("e", "h")])
    files = spark.createDataFrame([("f",), ("",), ("f",)], "path string")
    assert sorted(map(tuple, diff.file_seeds(files, old, new).collect())) == [("a", "current"), ("b", "baseline"), ("d", "current")]


def test_edges_of_both_graphs_are_no_difference(spark):
    edges = lambda rows: spark.createDataFrame(rows, "source_id string, target_id string, edge_type string")
    old = edges([("a", "b", "reads"), ("a", "b", "reads"), (None, "b", "reads"), ("a", "c", "reads")])
    new = edges([("a", "b", "reads"), (None, "b", "reads"), ("a", "b", "feeds"), ("a", "b", "feeds")])
    assert sorted(map(tuple, diff.edge_diff(old, new).collect())) == [("a", "b", "feeds", "added"), ("a", "c", "reads", "removed")]


def test_columns_of_one_place_merge_alike_in_any_order(spark):
    rows = [("t", "a", "int", 1), ("t", "A", "text", 1), ("t", "b", "int", 1), ("t", "B", "date", 1), ("t", "c", "int", 0)]
    got = set()
    for order in (rows, rows[::-1]):
        merged = graph.column_merge(spark.createDataFrame(order, "node_id string, name string, data_type string, ord long").coalesce(1))
        got.add(str([(c["name"], c["data_type"]) for c in merged.collect()[0]["columns"]]))
    assert got == {str([("c", "int"), ("A", "text"), ("B", "date")])}


def test_columns_are_traced_through_writers_and_near_names(spark):
    from tributary.operators import trace

    frame = lambda rows, schema: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schema.split()))
    nodes = frame([("v", "v", "rep.v"), ("t", "Tab", "dbo.Tab"), ("p", "p", "etl.p"), ("s1", "src", "a.src"), ("s2", "src", "b.src"), ("far", "far", "z.far")], "id name qualified")
    flow = frame([("t", "v"), ("p", "t"), ("s1", "p"), ("s2", "p"), ("far", "s1"), ("v", "t")], "up down")
    own = frame([("v", "c", "dbo.tab.x"), ("v", "c", "gone.q"), ("v", "loop", "tab.loop")], "node_id col source")
    loaded = frame([("t", "x", "src.k"), ("t", "x", "b.src.k"), ("t", "x", "z.far.k"), ("t", "loop", "v.loop"), ("v", "c", "never.used")], "node_id col source")
    roots = frame([("v", "C"), ("v", "loop"), ("v", "plain")], "root col")
    got = {(r.col, r.source) for r in trace.column_sources(roots, own, loaded, flow, nodes).collect()}
    assert got == {("C", "a.src.k"), ("C", "b.src.k"), ("C", "z.far.k (unresolved node)"), ("C", "gone.q (unresolved node)"), ("plain", "rep.v.plain")}
