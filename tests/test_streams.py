"""Keyed state of files, table functions of SQL, and the listing of folders."""

import json
import time

import pytest

from tributary.sources import files, functions, models, stored
from tributary.streaming import state

TMDL = "table T\n\tmeasure M = SUM(T[a])\n\tcolumn a\n"
FIELD = {"Column": {"Expression": {"SourceRef": {"Entity": "T"}}, "Property": "a"}}


def test_edits_and_removals_leave_what_a_fresh_run_gives(spark, tmp_path):
    events, calls = tmp_path / "events", tmp_path / "calls"
    events.mkdir()
    calls.mkdir()

    def extract(path, text):
        (calls / f"{path}-{abs(hash(text))}-{len(list(calls.iterdir()))}").write_text("")
        return text.split()

    batches = [
        [("a", "x y", 1), ("b", "x", 1), ("c", "z z z", 1), ("a", "old", 0)],
        [("a", "y w", 2), ("b", None, 2), ("d", "q", 1), ("gone", None, 1)],
        [("b", "x", 3), ("c", "z z z", 2), ("d", None, 2), ("d", "q r", 3), ("e", "", 1)],
    ]
    texts: dict[str, str] = {}
    for n, batch in enumerate(batches):
        (events / f"{n}.json").write_text("\n".join(json.dumps({"repo_key": "r", "path": p, "text": t, "seq": s}) for p, t, s in batch))
        stream = spark.readStream.schema("repo_key string, path string, text string, seq long").json(str(events))
        writer = state.changes(stream, extract).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        writer.start(str(tmp_path / "out")).awaitTermination()
        for p, t, _ in sorted(batch, key=lambda e: e[2]):
            texts.pop(p, None)
            if t is not None:
                texts[p] = t
        got = {(r.path, r.value) for r in state.present(spark.read.schema(state.CHANGES).parquet(str(tmp_path / "out"))).collect()}
        assert got == {(p, w) for p, t in texts.items() for w in t.split()}, n
    # c came again unchanged and was not read again
    assert len([c for c in calls.iterdir() if c.name.startswith("c-")]) == 1



def test_files_share_keys_of_the_state_and_are_forgotten_one_by_one(spark, tmp_path):
    (tmp_path / "events").mkdir()

    def run(n, rows):
        (tmp_path / "events" / f"{n}.json").write_text("\n".join(json.dumps({"repo_key": "r", "path": p, "text": t, "seq": 1}) for p, t in rows))
        stream = spark.readStream.schema("repo_key string, path string, text string, seq long").json(str(tmp_path / "events"))
        writer = state.changes(stream, lambda path, text: text.split(), "6 seconds", buckets=2).writeStream.format("parquet")
        query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        got = {(r.path, r.value) for r in state.present(spark.read.schema(state.CHANGES).parquet(str(tmp_path / "out"))).collect()}
        return got, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1]

    every = [(f"f{n}", f"x{n} y") for n in range(40)]
    first, keys = run(0, every)
    assert first == {(p, v) for p, t in every for v in t.split()} and keys <= 2
    time.sleep(7)
    second, _ = run(1, every[:30])
    # both keys had events, and the files without one are gone
    assert second == {(p, v) for p, t in every[:30] for v in t.split()}


BIM = {"model": {"tables": [{"name": "T", "columns": [{"name": "a", "dataType": "int64"}], "measures": [{"name": "M", "expression": ["SUM(", "T[a])"]}], "partitions": [{"name": "p", "mode": "import", "source": {"type": "m", "expression": "let x in x"}}]}], "relationships": [{"name": "r", "fromTable": "T", "fromColumn": "a", "toTable": "U", "toColumn": "b"}]}}
FILES = {
    "bim": [("m.bim", json.dumps(BIM)), ("bad.bim", "[]")],
    "tmdl": [("a.tmdl", TMDL), ("empty.tmdl", "")],
    "pbir_visual": [("v.json", json.dumps({"visual": FIELD})), ("bad.json", "{")],
    "pbir_page": [("p.json", json.dumps({"filterConfig": {"f": FIELD}}))],
    "pbir_report": [("r.json", "[]")],
    "report_json_legacy": [("o.json", json.dumps({"sections": [{"name": "s", "visualContainers": [FIELD]}]})), ("n.json", "3")],
    "pbix": [("x.pbix", b"no archive")],
}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_table_functions_give_the_rows_of_the_frames(spark, kind):
    column = "content binary" if kind == "pbix" else "text string"
    df = spark.createDataFrame([("r", p, t) for p, t in FILES[kind]], f"repo_key string, path string, {column}")
    functions.register(spark)
    df.createOrReplaceTempView("some_files")
    got = sorted(map(str, spark.sql(f"SELECT * FROM extract(TABLE(some_files), '{kind}')").collect()))
    assert got == sorted(map(str, functions.extracted(df, kind).collect())) and set(FILES) == set(functions.EXTRACTORS)
    assert len([p for p, _ in FILES[kind] if p.startswith(("bad", "n", "x"))]) == sum("Error" in r or "BadZipFile" in r for r in got)


def test_model_files_in_json_give_the_rows_of_the_other_form(spark):
    assert [r[:4] for r in models.bim_objects(json.dumps(BIM))] == [("table", "T", "T", ""), ("column", "T", "a", ""), ("measure", "T", "M", "SUM(\nT[a])"), ("partition", "T", "p", "let x in x"), ("relationship", "", "r", "")]
    assert json.loads(models.bim_objects(json.dumps(BIM))[-1][4]) == {"fromColumn": "T.a", "toColumn": "U.b"}
    # the frames of the fixed schema see the same objects
    tom = models.tom(spark.createDataFrame([("r", "m.bim", json.dumps(BIM))], "repo_key string, path string, text string"))
    assert {(k, r.table, r.name) for k in ("column", "measure", "partition") for r in tom[f"{k}s"].collect()} == {r[:3] for r in models.bim_objects(json.dumps(BIM)) if r[0] in ("column", "measure", "partition")}


def test_a_source_reads_the_same_rows_in_batches_and_as_a_stream(spark, tmp_path):
    root, out = tmp_path / "repo", tmp_path / "out"
    for path, text in {"m/a.tmdl": TMDL, "m/b.tmdl": TMDL.replace("T", "U"), "skip/c.tmdl": TMDL, "m/no.sql": "SELECT 1", ".h/d.tmdl": TMDL}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "m" / "gone.tmdl").symlink_to(root / "nothing")
    stored.register(spark)
    options = {"extract": "tmdl", "repo_key": "r", "include": "**/*.tmdl", "exclude": "skip/**", "bin_files": "1", "log": str(tmp_path / "log")}
    batch = lambda at=str(root): spark.read.format("estate").options(**options).load(at)

    def streamed(**more):
        writer = spark.readStream.format("estate").options(**options, **more).load(str(root)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        writer.start(str(out)).awaitTermination()
        return sorted(map(tuple, spark.read.schema(batch().schema).parquet(str(out)).collect()), key=str)

    rows = sorted(map(tuple, batch().collect()), key=str)
    assert batch().rdd.getNumPartitions() == 3 and {(r[1], r[2]) for r in rows} == {("m/a.tmdl", ""), ("m/b.tmdl", ""), ("m/gone.tmdl", "file_unreadable")}
    frame = spark.createDataFrame([("r", "m/a.tmdl", TMDL), ("r", "m/b.tmdl", TMDL.replace("T", "U"))], "repo_key string, path string, text string")
    assert {r for r in rows if not r[2]} == set(map(tuple, functions.extracted(frame, "tmdl").collect()))
    assert sorted(map(tuple, batch(f"file://{root}").collect()), key=str)[:3] == rows[:3]
    assert [(r.file, r.category) for r in stored.problems(batch(), "tmdl_parse").collect()] == [("m/gone.tmdl", "tmdl_parse")]
    assert streamed() == rows and streamed() == rows  # nothing changed, so nothing comes again
    (root / "m" / "e.tmdl").write_text("table E\n")
    (root / "m" / "b.tmdl").unlink()
    assert [r for r in streamed() if r not in rows] == [("r", "m/e.tmdl", "", "table", "E", "E", "", "{}")]
    assert len(list((tmp_path / "log").glob("*.json"))) == 2
    with pytest.raises(Exception, match="extract is one of"):
        spark.read.format("estate").option("extract", "nothing").load(str(root)).collect()
    assert spark.read.format("estate").options(extract="tmdl", include="*.none").load(str(root)).count() == 0


def test_edits_and_removals_of_a_folder_reach_the_state(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    stored.register(spark)

    def run():
        events = spark.readStream.format("estate").option("log", str(tmp_path / "log")).load(str(root)).where("problem = ''")
        writer = state.changes(events, lambda path, text: text.split()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        writer.start(str(tmp_path / "out")).awaitTermination()
        return {(r.path, r.value) for r in state.present(spark.read.schema(state.CHANGES).parquet(str(tmp_path / "out"))).collect()}

    (root / "a").write_text("x y")
    (root / "b").write_text("z")
    assert run() == {("a", "x"), ("a", "y"), ("b", "z")}
    (root / "a").write_text("x other")
    (root / "b").unlink()
    (root / "c").write_text("w")
    assert run() == {("a", "x"), ("a", "other"), ("c", "w")}


def test_bins_keep_their_bounds():
    held = [stored.File(str(k), "", size, 0, "") for k, size in enumerate([5, 5, 20, 1, 1, 1])]
    assert [[f.size for f in b.held] for b in stored.bins(held, 10, 2)] == [[5, 5], [20], [1, 1], [1]]
    assert stored.bins([], 10, 2) == []


def test_table_functions_refuse_unknown_kinds(spark):
    functions.register(spark)
    with pytest.raises(Exception, match="second argument"):
        spark.sql("SELECT * FROM extract(TABLE(SELECT 'r' AS repo_key, 'p' AS path, 't' AS text), 'nothing')").collect()


def test_folders_are_listed_level_by_level(spark, tmp_path):
    for path in ("a/b/c/d/e.sql", "a/x.sql", "top.sql", "skip/y.sql", ".h/z.sql", "rep/R.Report/definition.pbir", "rep/R.Report/q.sql"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / "a" / "out.sql").symlink_to("/etc/hostname")
    (tmp_path / "a" / "lost.sql").symlink_to(tmp_path / "nothing")
    (tmp_path / "a" / "loop").symlink_to(tmp_path / "a")
    paths = lambda found: {r.path for r in found[0].collect()}
    both = files.crawl(spark, {"r": str(tmp_path)}, exclude=["skip/**"])
    assert paths(both) == {"a/b/c/d/e.sql", "a/x.sql", "top.sql", "rep/R.Report/definition.pbir", "rep/R.Report/q.sql"}
    assert {(r.file, r.category) for r in both[1].collect()} == {("a/out.sql", "symlink_escape"), ("a/lost.sql", "file_unreadable")}
    assert paths(files.crawl(spark, {"r": str(tmp_path)}, folders={"r": ["a/b"]})) == {"a/b/c/d/e.sql"}
    assert paths(files.crawl(spark, {"r": str(tmp_path)}, include=["*.none"], folders={"r": ["rep"]})) == {"rep/R.Report/definition.pbir"}
    assert paths(files.crawl(spark, {"r": str(tmp_path)}, include=["top.*"])) == {"top.sql", "rep/R.Report/definition.pbir"}
    by_uri = files.crawl(spark, {"r": f"file://{tmp_path}"}, include=["**/*.sql"], exclude=["skip/**"])
    assert {"a/b/c/d/e.sql", "top.sql"} <= paths(by_uri)
    assert {r.text for r in files.read_files(by_uri[0].where("path = 'top.sql'")).collect()} == {"x"}
    assert {e[0]: e[2] for e in files.entries(f"mock://{tmp_path}", "")} == {"": False}  # no such file system: one row with the problem
    gone = files.crawl(spark, {"r": str(tmp_path / "absent")})
    assert gone[0].count() == 0 and [r.category for r in gone[1].collect()] == ["folder_unreadable"]


def test_texts_with_nul_are_reported(spark):
    df = spark.createDataFrame([("a.sql", "x\0y"), ("b.sql", "xy"), ("c.sql", None)], "path string, text string")
    assert [(r.file, r.category) for r in files.unreadable(df).collect()] == [("a.sql", "encoding_unreadable")]


def test_partition_types_are_kept(spark):
    text = "table T\n\tpartition p = calculated\n\t\tsource = SUMMARIZE(F)\n"
    rows = models.tmdl(spark.createDataFrame([("r", "t.tmdl", text)], "repo_key string, path string, text string")).where("kind = 'partition'").collect()
    assert [(r.value, json.loads(r.properties)["type"]) for r in rows] == [("SUMMARIZE(F)", "calculated")]


def test_removed_files_leave_the_memo(spark, tmp_path):
    from pyspark.sql import functions as F

    from tributary.streaming import incremental

    def extract(f):
        return f.select("cache_key", "path", F.explode(F.split("text", " ")).alias("value"))

    frame = lambda rows: spark.createDataFrame([("r", p, t) for p, t in rows], "repo_key string, path string, text string")
    store = str(tmp_path / "memo")
    before, after = frame([("a", "x y"), ("b", "z"), ("c", "w")]), frame([("a", "x y"), ("c", "v")])
    rows = lambda df: {(r.path, r.value) for r in df.collect()}
    assert rows(incremental.extract_new(before, "s", extract, store)) == {("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")}
    assert rows(incremental.extract_new(after, "s", extract, store)) == {("a", "x"), ("a", "y"), ("c", "v")}
    incremental.forget_removed(after, "s", store)
    assert rows(spark.read.parquet(store)) == {("a", "x"), ("a", "y"), ("c", "v")} and spark.read.parquet(store + "_keys").count() == 2
    counts = incremental.memo_counts(before, "s", store).collect()[0]
    assert (counts.hits, counts.misses) == (1, 2)
    assert rows(incremental.extract_new(before, "s", extract, store)) == {("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")}
    incremental.forget_removed(before, "t", str(tmp_path / "none"))
