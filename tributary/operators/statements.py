"""Lineage from SQL texts by patterns, in column expressions over a mask of the text.

A text is masked once (``functions.masks``) and split at GO lines, semicolons and the headers of what it creates. Each
statement is then folded: every parenthesis goes to a line of its own and keywords are marked, so a clause is what stands
between two marks, however deep its neighbours nest. It never guesses: names of common table expressions and aliases,
temporary tables, variables, cursors, the row sets of triggers and built-in row sources are no tables, a FROM inside a
function or of IS DISTINCT FROM lists none, and statements that build their SQL at run time only give a warning. No
pattern repeats a group without a possessive bound, so texts of any length match.

A statement belongs to the object whose header it carries; behind the header of what has a body (procedure, trigger,
function) all statements up to the next such header or the end of the batch belong to that (``owners``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import KEY, sql_folded, sql_mask, unmasked
from ..functions.names import normalize_identifier, qualify, qualified_parts

_LETTER = r"A-Za-z_@#\x{80}-\x{2FFF}\x{3001}-\x{DFFF}\x{F900}-\x{FFEF}"
_PART = rf'(?:\[[^\]]*+\]|"[^"]*+"|[{_LETTER}][{_LETTER}0-9$]*+)'
_NAME = rf"{_PART}(?:\s*+\.\s*+{_PART}){{0,3}}"
#: A keyword of code: not a part of a name.
_KEY = rf'(?<![\[".{_LETTER}0-9$])'
_HEADER = r"CREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?(?:TABLE|VIEW|PROC(?:EDURE)?|FUNCTION|TRIGGER)\s"
# Words that are no table where one may stand, and the row sets of a trigger.
NO_NAMES = """after all and as begin by case cascade distinct else end exists for from go group having in index inner into is join key left like no not null of on or
order outer over overwrite percent procedure right select set statistics table then to top trigger union values view when where with""".split()
ROW_SETS = ["inserted", "deleted"]

# On folded statements: a name is what holds no blank, sign or parenthesis (quoted names are single words there).
_RAW = rf"[^\s\d,()=<>+*/'%|&!~^;:.{KEY}-][^\s,()=<>+*/'%|&!~^;:{KEY}-]*+"
_TOP = r"(?:top ?\(\d++\) ?(?:percent )?)?"
#: What is written stands behind these.
_WRITES = rf"{KEY}(?:(?:insert|merge|update) {_TOP}(?:overwrite )?(?:table )?|into (?:table )?|delete {_TOP}(?:from )?|truncate (?:table )?)({_RAW})"
#: What may hold tables, up to the next mark: lists, and what goes on behind a list's first comma.
_LISTS = rf"{KEY}(?:(?:from|using|join|apply|clone of)\b|on [^{KEY}\n,]*+,|with ?\(\d++\) ?,|(?:tablesample|(?:un)?pivot) ?\([^{KEY}\n,]*+,|for system_time[^{KEY}\n,]*+,)([^{KEY}\n]*+)"
_ELEMENT = rf"^ ?({_RAW})( ?\()?+(?:\d++\))?(?: (?:as )?({_RAW}))?"
_CTES = rf"(?:{KEY}with (?:recursive )?|, ?)({_RAW}) ?(?:\(\d++\) ?)?as (?:not )?(?:materialized )?\("


def statements(files: DataFrame) -> DataFrame:
    """(repo_key, path, batch, stmt, sql): masked statements of each file (…, text), split at GO lines, semicolons and headers."""
    batch = F.posexplode(F.split(F.col("mask"), r"(?im)^[ \t]*+GO[ \t]*+\r?$")).alias("batch", "part")
    b = files.select("repo_key", "path", sql_mask("text").alias("mask")).select("repo_key", "path", batch)
    return b.select("repo_key", "path", "batch", F.posexplode(F.split("part", rf"(?i);|(?<=[^\s;])\s++(?={_HEADER})")).alias("stmt", "sql")).where("trim(sql) <> ''")


def _found(sql: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(sql, F.lit("(?i)" + pattern), F.lit(group))


#: The procedure that runs a text.
RUNS_TEXT = "sp_executesql"


def _bare(name: Column) -> Column:
    return ~F.contains(name, F.lit("."))


def statement_lineage(stmts: DataFrame) -> DataFrame:
    """Rows (…, direction, schema_name, name) of what each statement reads and writes; reads of its own target are dropped."""
    keys = [c for c in stmts.columns if c != "sql"]
    # no filter on what the fold gives: it would be pushed below and the fold run twice
    folded = stmts.select(*keys, sql_folded("sql").alias("__f"))
    skipped = _dynamic("__f") | F.col("__f").rlike(f"^{KEY}(?:grant|deny|revoke) ")
    all_of = lambda pattern: F.regexp_extract_all("__f", F.lit(pattern), F.lit(1))
    found = folded.select(*keys, F.when(~skipped, F.struct(all_of(_WRITES).alias("w"), F.split(F.array_join(all_of(_LISTS), ","), ",").alias("e"), all_of(_CTES).alias("c"))).alias("__x"))

    piece = lambda x, k: F.regexp_extract(x, _ELEMENT, k)
    read = F.transform("__x.e", lambda x: F.struct(piece(x, 1).alias("raw"), (piece(x, 2) != "").alias("call"), piece(x, 3).alias("alias")))
    found = found.select(*keys, "__x.w", F.array_union("__x.c", F.array(*map(F.lit, ROW_SETS))).alias("none"), F.filter(read, lambda x: x["raw"] != "").alias("r"))
    # aliases that are no words of the syntax, and what each stands for
    named = F.filter("r", lambda x: ~x["call"] & (x["alias"] != "") & ~x["alias"].isin(NO_NAMES) & ~_no_table(x["raw"]))
    found = found.select(*keys, "w", "none", "r", named.alias("named"))

    def meant(raw: Column) -> Column:
        """The table that a written name means: what its alias stands for, or itself."""
        at = F.array_position("named.alias", raw)
        return F.when(_bare(raw) & (at > 0), F.try_element_at("named.raw", at.cast("int"))).otherwise(raw)

    outside = lambda x: ~(_no_table(x) | (_bare(x) & F.array_contains("none", x)))
    whole = lambda x: F.regexp_replace(F.when(_bare(x), F.concat(F.lit("dbo."), x)).otherwise(x), '["\\[\\]]', "")
    tables = lambda raws: F.array_distinct(F.transform(F.filter(raws, outside), lambda x: F.struct(whole(x).alias("key"), x.alias("raw"))))
    real = F.filter("r", lambda x: ~_bare(x["raw"]) | ~(x["call"] | F.array_contains("named.alias", x["raw"])))
    both = found.select(*keys, tables(F.transform("w", meant)).alias("w"), tables(F.transform(real, lambda x: x["raw"])).alias("r"))
    # by key, so that one table that is written in several ways counts once
    once = lambda direction, xs, but: F.transform(F.array_except(F.transform(xs, lambda x: x["key"]), but), lambda k: F.struct(F.lit(direction).alias("direction"), F.element_at(xs, F.array_position(F.transform(xs, lambda x: x["key"]), k).cast("int"))["raw"].alias("raw")))
    rows = both.select(*keys, F.explode(F.concat(once("writes", F.col("w"), F.array().cast("array<string>")), once("reads", F.col("r"), F.col("w.key")))).alias("e"))
    return rows.select(*keys, "e.direction", qualify(unmasked(F.col("e.raw"))).alias("q")).select(*keys, "direction", "q.schema_name", "q.name")


def _no_table(raw: Column) -> Column:
    return raw.rlike("^[#@]") | (_bare(raw) & raw.isin(NO_NAMES))


def _dynamic(folded: str) -> Column:
    """Whether a folded statement runs a text: EXEC of a parenthesis, or the procedure that does so."""
    return F.col(folded).rlike(rf"{KEY}exec(?:ute)? ?\(|(?:^|[\s.=\[]){RUNS_TEXT}(?:[\s\]]|$)")


def owners(made: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (repo_key, path, batch, stmt, …) with ``owner`` and ``owner_type``, null where a statement belongs to nothing.

    As of each statement of a batch, the last header before it of what has a body is carried forward; without one, the
    statement's own header counts. Only ids travel: headers ``made`` (…, id, node_type) and rows are put in one order.
    """
    batch, extra = ["repo_key", "path", "batch"], [c for c in rows.columns if c not in ("repo_key", "path", "batch", "stmt")]
    body = F.col("node_type") == "stored_proc"
    heads = made.select(*batch, "stmt", F.when(body, F.struct("id", "node_type")).alias("__body"), F.when(~body, F.struct("id", "node_type", "stmt")).alias("__own"), F.lit(0).alias("__k"))
    heads = heads.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra])
    every = heads.unionByName(rows.withColumn("__k", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy(*batch).orderBy("stmt", "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = every.select("*", F.last("__body", True).over(so_far).alias("__b"), F.last("__own", True).over(so_far).alias("__o")).where("__k = 1")
    own = F.when(F.col("__o.stmt") == F.col("stmt"), F.struct("__o.id", "__o.node_type"))
    return seen.withColumn("__w", F.coalesce("__b", own)).select(*batch, "stmt", *extra, F.col("__w.id").alias("owner"), F.col("__w.node_type").alias("owner_type"))


def unmasked_name(raw: Column) -> Column:
    """A name as written, blanks around its dots removed; dots inside its quoted parts do not part it."""
    return unmasked(F.regexp_replace(raw, r"\s*+\.\s*+", "."))


def _runs_text(mask: str) -> Column:
    """The same on a mask: a call by parenthesis, or the procedure's name as a word or a name's last part."""
    word = rf'(?:^|[\s.="\[]){RUNS_TEXT}(?:[\s"\]]|$)'
    return F.lower(mask).rlike(rf"(?:^|[^\w.$#@\[\"])exec(?:ute)?\s*+\(|{word}")


def dynamic_sql(stmts: DataFrame) -> DataFrame:
    """Warnings for statements that build their SQL at run time."""
    return stmts.where(_runs_text("sql")).select(F.col("path").alias("file"), F.lit("SQL built at run time is not traced").alias("message"), F.lit("dynamic_sql").alias("category"))


def callees(stmts: DataFrame) -> DataFrame:
    """(…, schema_name, name) of procedures that a statement executes, once each."""
    keys = [c for c in stmts.columns if c != "sql"]
    found = F.array_distinct(F.transform(F.filter(_found(F.col("sql"), rf"{_KEY}EXEC(?:UTE)?\s+(?!AS\b)(?:@\w++\s*+=\s*+)?({_NAME})"), lambda x: ~x.startswith("@")), lambda x: qualify(unmasked_name(x))))
    return stmts.where(~_runs_text("sql")).select(*keys, F.explode(found).alias("q")).select(*keys, "q.schema_name", "q.name")


_CREATE = rf"(?i){_KEY}CREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?(TABLE|VIEW|PROC(?:EDURE)?|FUNCTION|TRIGGER)\s+({_NAME})"


def definitions(stmts: DataFrame) -> DataFrame:
    """(…, node_type, object_kind, schema_name, name, display_name) of what statements create; temporary tables are left out.

    A function that returns the rows of one SELECT is a view, as are views; what has a body is a stored procedure.
    """
    keys = [c for c in stmts.columns if c != "sql"]
    kind, name = F.upper(F.regexp_extract("sql", _CREATE, 1)), F.regexp_extract("sql", _CREATE, 2)
    inline = F.col("sql").rlike(r"(?i)\breturns\s+table\s+(?:with\s+\w++\s+)?as\s+return\b")
    d = stmts.where(kind != "").select(*keys, kind.alias("k"), inline.alias("inline"), unmasked_name(name).alias("raw"))
    node_type = F.when(F.col("k") == "TABLE", "gold_table").when((F.col("k") == "VIEW") | ((F.col("k") == "FUNCTION") & F.col("inline")), "view").otherwise("stored_proc")
    object_kind = F.when(F.col("k") == "FUNCTION", F.when(F.col("inline"), "inline_tvf").otherwise("scalar_function")).when(F.col("k") == "TRIGGER", "trigger").otherwise("")
    d = d.select(*keys, node_type.alias("node_type"), object_kind.alias("object_kind"), qualify(F.col("raw")).alias("q"), F.trim(F.regexp_replace(F.element_at(qualified_parts(F.col("raw")), -1), '[\\[\\]"]', "")).alias("display_name"))
    return d.select(*keys, "node_type", "object_kind", "q.schema_name", "q.name", "display_name").where("name not like '#%' and name not like '@%'")


def star_views(stmts: DataFrame) -> DataFrame:
    """Info rows for views that select all columns, whose columns are therefore unknown."""
    star = F.col("sql").rlike(rf"(?i){_KEY}CREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?VIEW\b[\s\S]*?\bSELECT\s+(?:(?:DISTINCT|TOP\s*+\([^()]*+\))\s+)?(?:{_PART}\s*+\.\s*+)?\*")
    return stmts.where(star).select(F.col("path").alias("file"), F.lit("a view selects all columns").alias("message"), F.lit("select_star_view").alias("category"))


#: A parenthesis with up to four levels inside.
_GROUP = r"\([^()]*+\)"
for _ in range(4):
    _GROUP = rf"\((?:[^()]++|{_GROUP})*+\)"
_COLUMN = rf"^\s*+({_PART})\s++({_PART}(?:\s*+\([^()]*+\))?)([\s\S]*)$"


def table_columns(stmts: DataFrame) -> DataFrame:
    """(…, schema_name, name, pos, column, data_type, nullable, constraints) of CREATE TABLE statements.

    Constraints are primary_key (at the column or the table), unique, identity and default; a key column is not nullable.
    """
    keys = [c for c in stmts.columns if c != "sql"]
    head = rf"(?i)^\s*+CREATE\s+TABLE\s+({_NAME})\s*+\(((?:[^()]++|{_GROUP})*+)\)"
    t = stmts.select(*keys, F.regexp_extract("sql", head, 1).alias("raw"), F.regexp_extract("sql", head, 2).alias("body")).where("raw <> '' and raw not like '#%' and raw not like '@%'")
    # a definition is what no comma outside of parentheses parts; each is one match, so the cost is linear
    rows = t.select(*keys, "raw", F.posexplode(F.regexp_extract_all("body", F.lit(rf"((?:[^,()]++|{_GROUP})++)"), F.lit(1))).alias("pos", "part"))
    own = ~F.col("part").rlike(r"(?i)^\s*+(?:constraint|primary\s+key|unique|foreign\s+key|check|index|period)\b")
    keyed = F.regexp_extract("part", r"(?i)\bprimary\s+key\b[^()]*+\(([^()]*+)\)", 1)
    table_key = rows.where(~own & (keyed != "")).select(*keys, "raw", F.transform(F.split(keyed, ","), lambda x: normalize_identifier(F.regexp_replace(unmasked(x), r"(?i)\s+(?:asc|desc)\s*$", ""))).alias("key"))
    c = rows.where(own & F.col("part").rlike("(?i)" + _COLUMN)).join(table_key, [*keys, "raw"], "left")
    piece = lambda k: F.regexp_extract("part", "(?i)" + _COLUMN, k)
    c = c.select(*keys, "raw", "pos", "key", piece(1).alias("n"), piece(2).alias("d"), piece(3).alias("rest"))
    name = F.trim(F.regexp_replace(unmasked(F.col("n")), '^[\\["]|[\\]"]$', ""))
    is_key = F.col("rest").rlike(r"(?i)\bprimary\s+key\b") | F.coalesce(F.array_contains("key", F.lower(name)), F.lit(False))
    has = lambda pattern, label: F.when(F.col("rest").rlike(rf"(?i)\b{pattern}\b"), F.lit(label))
    constraints = F.array_compact(F.array(F.when(is_key, "primary_key"), has("unique", "unique"), has("identity", "identity"), has("default", "default")))
    nullable = ~(is_key | F.col("rest").rlike(r"(?i)\bnot\s+null\b"))
    c = c.select(*keys, qualify(unmasked_name(F.col("raw"))).alias("q"), "pos", name.alias("column"), F.upper(F.regexp_replace(unmasked(F.col("d")), r"[\[\]\s]+", "")).alias("data_type"), nullable.alias("nullable"), constraints.alias("constraints"))
    return c.select(*keys, "q.schema_name", "q.name", "pos", "column", "data_type", "nullable", "constraints")
