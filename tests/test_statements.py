"""Statement patterns over masks: names, quotes, comments, lists and texts of any length."""

import pytest

from tributary.functions import masks
from tributary.operators import statements

CASES = [
    ("INSERT INTO [a;b].[t] SELECT * FROM x.y", {("writes", "a;b", "t"), ("reads", "x", "y")}),
    ("SELECT [O'Brien] FROM x.y WHERE [it's] = 1", {("reads", "x", "y")}),
    ("SELECT [a--b] FROM x.y", {("reads", "x", "y")}),
    ("DELETE a FROM m.t a JOIN m.u b ON a.i = b.i", {("writes", "m", "t"), ("reads", "m", "u")}),
    ("DELETE m.t WHERE x = 1", {("writes", "m", "t")}),
    ("DELETE FROM m.t WHERE i IN (SELECT i FROM m.u)", {("writes", "m", "t"), ("reads", "m", "u")}),
    ("SELECT * FROM x.y a, x.z b WHERE a.i = b.i", {("reads", "x", "y"), ("reads", "x", "z")}),
    ("SELECT TRIM('x' FROM c), EXTRACT(YEAR FROM d) FROM q.r", {("reads", "q", "r")}),
    ("SELECT * FROM OPENROWSET(BULK 'f', SINGLE_CLOB) AS r", set()),
    ("SELECT * FROM dbo.fn_x(1) f, STRING_SPLIT('a', ',') s", {("reads", "dbo", "fn_x")}),
    ("SELECT 1 /* a /* FROM no.no */ FROM no.no */ FROM k.m -- FROM no.no", {("reads", "k", "m")}),
    ("WITH q AS (SELECT * FROM base.p) UPDATE c SET a = 1 FROM mart.o c JOIN q ON 1 = 1", {("writes", "mart", "o"), ("reads", "base", "p")}),
    ("MERGE INTO d.t AS t USING (SELECT * FROM s.u) AS s ON t.i = s.i WHEN MATCHED THEN UPDATE SET a = 1 WHEN NOT MATCHED THEN INSERT (a) VALUES (1)", {("writes", "d", "t"), ("reads", "s", "u")}),
    ("SELECT a INTO #tmp FROM [my db].[dbo].[T.x] t CROSS APPLY dbo.fn(t.i) f", {("reads", "my db.dbo", "t.x"), ("reads", "dbo", "fn")}),
    ("FETCH NEXT FROM cur INTO @a\nSELECT 1 FROM c.d", {("reads", "c", "d")}),
    ("TRUNCATE TABLE w.x", {("writes", "w", "x")}),
    ("SELECT * FROM a.b LEFT JOIN [order] o ON 1 = 1 WHERE EXISTS (SELECT 1 FROM c.d)", {("reads", "a", "b"), ("reads", "dbo", "order"), ("reads", "c", "d")}),
    ("INSERT INTO s.t SELECT * FROM s.t JOIN s.u ON 1 = 1", {("writes", "s", "t"), ("reads", "s", "u")}),
    ("SELECT '" + "x" * 1_000_000 + "' FROM k.l", {("reads", "k", "l")}),
    ("SELECT '" + "''" * 100_000 + "' FROM k.l", {("reads", "k", "l")}),
    ("SELECT 1 " + " " * 300_000 + "FROM k.l", {("reads", "k", "l")}),
    ("SELECT 1 /*" + "x" * 1_000_000 + "*/ FROM k.l", {("reads", "k", "l")}),
    ("SELECT 'open FROM no.no", set()),
    ("", set()),
]


def test_statements_read_and_write_what_they_name(spark):
    df = spark.createDataFrame([("r", str(k), sql) for k, (sql, _) in enumerate(CASES)] + [("r", "null", None)], "repo_key string, path string, text string")
    rows = statements.statement_lineage(statements.statements(df)).collect()
    got = {str(k): {(r.direction, r.schema_name, r.name) for r in rows if r.path == str(k)} for k in range(len(CASES))}
    for k, (sql, want) in enumerate(CASES):
        assert got[str(k)] == want, sql[:80]


def test_batches_and_semicolons_part_only_in_code(spark):
    text = "SELECT ';' FROM a.b; SELECT 1 FROM [c;d].e\nGO\n/*\nGO\n*/ SELECT 2 FROM f.g -- ; \n go \nSELECT '\nGO\n' FROM h.i"
    df = spark.createDataFrame([("r", "p", text)], "repo_key string, path string, text string")
    rows = statements.statement_lineage(statements.statements(df)).collect()
    assert {(r.batch, r.stmt, r.schema_name, r.name) for r in rows} == {(0, 0, "a", "b"), (0, 1, "c;d", "e"), (1, 0, "f", "g"), (2, 0, "h", "i")}


@pytest.mark.parametrize(("text", "want"), [("a 'b''c' d", "a '   ''" + "' d"), ("x -- y\nz", "x     \nz"), ("[a;b]", "[a" + chr(0xE03B) + "b]"), ("/* a /* b */ c */x", " " * 17 + "x"), ("'open", "'   n"), (None, None)])
def test_blanked_texts_keep_their_length(text, want):
    got = masks._masked(text, masks._SQL, True, '["', False, True)
    assert got is None if text is None else len(got) == len(text)
    if text and not text.startswith(("'open", "a '")):
        assert got == want


def test_dynamic_sql_calls_and_definitions(spark):
    texts = ["EXEC sp_executesql N'x'", "EXEC @rc = dbo.[My Proc] 1; EXECUTE AS USER = 'x'; exec other", "CREATE OR ALTER VIEW s.V AS SELECT TOP (3) * FROM a.b", "CREATE FUNCTION F() RETURNS TABLE AS RETURN (SELECT 1 AS a)", "CREATE TRIGGER tr ON a.b AFTER INSERT AS SELECT 1", "CREATE TABLE #t (a INT)"]
    df = statements.statements(spark.createDataFrame([("r", str(k), t) for k, t in enumerate(texts)], "repo_key string, path string, text string"))
    assert [r.file for r in statements.dynamic_sql(df).collect()] == ["0"]
    assert {(r.path, r.schema_name, r.name) for r in statements.callees(df).collect()} == {("1", "dbo", "my proc"), ("1", "dbo", "other")}
    assert {(r.path, r.node_type, r.object_kind, r.name, r.display_name) for r in statements.definitions(df).collect()} == {("2", "view", "", "v", "V"), ("3", "view", "inline_tvf", "f", "F"), ("4", "stored_proc", "trigger", "tr", "tr")}
    assert [r.file for r in statements.star_views(df).collect()] == ["2"]


MORE = [
    ("DELETE TOP (5) FROM x.t", {("writes", "x", "t")}),
    ("DELETE TOP (5) PERCENT FROM x.t", {("writes", "x", "t")}),
    ("INSERT OVERWRITE TABLE a.t SELECT * FROM b.u", {("writes", "a", "t"), ("reads", "b", "u")}),
    ("INSERT INTO TABLE a.t SELECT 1", {("writes", "a", "t")}),
    ("SELECT * FROM db..tab", {("reads", "db", "tab")}),
    ("SELECT * FROM a.b WHERE x IS DISTINCT FROM y.z AND x IS NOT DISTINCT FROM w.v", {("reads", "a", "b")}),
    ("CREATE TRIGGER g ON x.y AFTER INSERT, UPDATE AS INSERT INTO l.m SELECT * FROM inserted i JOIN deleted d ON i.k = d.k", {("writes", "l", "m")}),
    ("SELECT * FROM x.y WITH (NOLOCK), x.z", {("reads", "x", "y"), ("reads", "x", "z")}),
    ("SELECT * FROM x.y AS a WITH (NOLOCK, INDEX(i)), x.z b WITH (NOLOCK) JOIN q.r ON 1 = 1", {("reads", "x", "y"), ("reads", "x", "z"), ("reads", "q", "r")}),
    ("SELECT * FROM a.b x JOIN c.d y ON y.k = LEFT(x.k, 2) AND y.z = CASE WHEN x.q = 1 THEN 1 ELSE 2 END, e.f z", {("reads", "a", "b"), ("reads", "c", "d"), ("reads", "e", "f")}),
    ("SELECT * FROM (a.b INNER JOIN c.d ON b.k = d.k)", {("reads", "a", "b"), ("reads", "c", "d")}),
    ("SELECT * FROM ((a.b JOIN c.d ON 1 = 1) LEFT JOIN e.f ON 1 = 1), g.h", {("reads", "a", "b"), ("reads", "c", "d"), ("reads", "e", "f"), ("reads", "g", "h")}),
    ("SELECT * FROM (SELECT * FROM a.b) d, t.u", {("reads", "a", "b"), ("reads", "t", "u")}),
    ("SELECT * FROM (VALUES (1, 2), (3, 4)) v (a, b), t.u", {("reads", "t", "u")}),
    ("SELECT (SELECT max(a) FROM i.j) AS m, x FROM k.l WHERE z IN (SELECT q FROM m.n, o.p)", {("reads", "i", "j"), ("reads", "k", "l"), ("reads", "m", "n"), ("reads", "o", "p")}),
    ("WITH a AS (SELECT * FROM r.s), b (x) AS (SELECT * FROM a JOIN t.u ON 1 = 1) SELECT * FROM b, a", {("reads", "r", "s"), ("reads", "t", "u")}),
    ("CREATE TABLE c.d (k INT REFERENCES e.f (k) ON DELETE CASCADE ON UPDATE NO ACTION, CONSTRAINT x FOREIGN KEY (k) REFERENCES e.f (k) ON DELETE CASCADE, m INT)", set()),
    ("GRANT SELECT ON a.b TO x, y", set()),
    ("REVOKE SELECT ON a.b FROM bob", set()),
    ("IF UPDATE(k) UPDATE x.y SET a = 1 FROM x.y JOIN p.q ON 1 = 1", {("writes", "x", "y"), ("reads", "p", "q")}),
    ("SELECT * FROM s.t FOR SYSTEM_TIME AS OF '2020', u.v TABLESAMPLE (10 PERCENT), w.x", {("reads", "s", "t"), ("reads", "u", "v"), ("reads", "w", "x")}),
    ("SELECT * FROM s.t PIVOT (SUM(a) FOR b IN ([c], [d])) AS p, u.v", {("reads", "s", "t"), ("reads", "u", "v")}),
    ("MERGE TOP (3) INTO a.b AS t USING c.d AS s ON t.i = s.i WHEN MATCHED THEN DELETE OUTPUT deleted.i INTO e.f", {("writes", "a", "b"), ("writes", "e", "f"), ("reads", "c", "d")}),
    ("SELECT a FROM [x].[from] f JOIN \"y\".\"on\" o ON f.[join] = o.[select]", {("reads", "x", "from"), ("reads", "y", "on")}),
    ("SET NOCOUNT ON DELETE FROM x.y", {("writes", "x", "y")}),
    ("SET IDENTITY_INSERT a.b ON UPDATE x.y SET a = 1", {("writes", "x", "y")}),
    ("UPDATE t SET a = 1", {("writes", "dbo", "t")}),
    ("SELECT * FROM a.b PRINT 'x', y", {("reads", "a", "b")}),
    ("SELECT " + "(" * 5000 + "SELECT 1 FROM a.b" + ")" * 5000 + " FROM c.d", {("reads", "a", "b"), ("reads", "c", "d")}),
    ("SELECT " + ", ".join(f"c{k}" for k in range(100_000)) + " FROM a.b", {("reads", "a", "b")}),
]


def test_folding_neither_loses_nor_invents_tables(spark):
    df = spark.createDataFrame([("r", str(k), sql) for k, (sql, _) in enumerate(MORE)], "repo_key string, path string, text string")
    rows = statements.statement_lineage(statements.statements(df)).collect()
    for k, (sql, want) in enumerate(MORE):
        assert {(r.direction, r.schema_name, r.name) for r in rows if r.path == str(k)} == want, sql[:80]


OWNERS = {
    "two": ("CREATE TABLE a.t (id int); CREATE VIEW b.v AS SELECT * FROM c.u", {("view:b.v", "reads", "u")}),
    "views": ("CREATE VIEW b.v AS SELECT * FROM c.u\nCREATE VIEW b.w AS SELECT * FROM c.x; CREATE VIEW b.z AS SELECT * FROM b.w", {("view:b.v", "reads", "u"), ("view:b.w", "reads", "x"), ("view:b.z", "reads", "w")}),
    "proc": ("CREATE VIEW b.q AS SELECT * FROM c.o; CREATE PROC p AS CREATE TABLE #t (a int); INSERT INTO d.e SELECT * FROM f.g; CREATE TABLE h.i (a int); DELETE FROM h.i", {("view:b.q", "reads", "o"), ("stored_proc:dbo.p", "writes", "e"), ("stored_proc:dbo.p", "reads", "g"), ("stored_proc:dbo.p", "writes", "i")}),
    "loose": ("CREATE VIEW b.y AS SELECT 1 AS a; INSERT INTO k.l SELECT * FROM m.n", {(None, "writes", "l"), (None, "reads", "n")}),
    "batch": ("CREATE PROC p2 AS SELECT * FROM a1.b1\nGO\nSELECT * FROM a2.b2", {("stored_proc:dbo.p2", "reads", "b1"), (None, "reads", "b2")}),
}


def test_statements_belong_to_their_own_object_or_the_body_around_them(spark):
    from tributary.functions.names import make_id
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("r", k, sql) for k, (sql, _) in OWNERS.items()], "repo_key string, path string, text string")
    stmts = statements.statements(df)
    made = statements.definitions(stmts).withColumn("id", make_id(F.col("node_type"), F.col("schema_name"), F.col("name")))
    rows = statements.owners(made, statements.statement_lineage(stmts)).collect()
    for k, (_, want) in OWNERS.items():
        assert {(r.owner, r.direction, r.name) for r in rows if r.path == k} == want, k


def test_columns_of_wide_tables_take_linear_time(spark):
    import time

    wide = "CREATE TABLE a.b (" + ", ".join(f"c{k} DECIMAL(10, 2) DEFAULT (f(1, (2)))" for k in range(8000)) + ") WITH (X = HASH(c1))"
    stmts = statements.statements(spark.createDataFrame([("r", "p", wide)], "repo_key string, path string, text string"))
    began = time.time()
    rows = statements.table_columns(stmts).collect()
    assert len(rows) == 8000 and {r.data_type for r in rows} == {"DECIMAL(10,2)"} and time.time() - began < 15
