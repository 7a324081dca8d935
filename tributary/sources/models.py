"""Model and report files as rows: TOM JSON, TMDL, report JSON, report archives, M sources and DAX references.

JSON with a known shape goes through ``from_json``; what has no fixed shape is read by a small function for one file
inside ``mapInPandas``. A file that cannot be read gives a warning row and nothing else.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import dax_mask, m_mask, m_reached, sql_mask, unmasked
from ..operators.statements import statement_lineage
from .files import MOST_MEMBER

_COLUMN = "struct<name: string, dataType: string, isHidden: boolean, type: string, expression: string, description: string>"
_TOM = f"""name string, model struct<
 tables: array<struct<name: string, description: string, isHidden: boolean, columns: array<{_COLUMN}>, measures: array<struct<name: string, expression: string, description: string>>,
  partitions: array<struct<name: string, mode: string, source: struct<type: string, expression: string, query: string>>>>>,
 relationships: array<struct<name: string, fromTable: string, fromColumn: string, toTable: string, toColumn: string, isActive: boolean, crossFilteringBehavior: string>>>"""


def expression_text(c: Column) -> Column:
    """An expression, which may be a JSON list of lines."""
    lines = F.from_json(c, "array<string>")
    return F.when(c.startswith("["), F.coalesce(F.array_join(lines, "\n"), c)).otherwise(c)


def tom(files: DataFrame) -> dict[str, DataFrame]:
    """tables, columns, measures, partitions, relationships and warnings of model files (repo_key, path, text)."""
    m = files.withColumn("j", F.from_json("text", _TOM, {"mode": "PERMISSIVE"})).withColumn("model", F.coalesce("j.name", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)))
    good = m.where("j.model is not null")
    t = good.select("repo_key", "path", "model", F.explode("j.model.tables").alias("t")).where("t.name is not null")
    key = ["repo_key", "path", "model", F.col("t.name").alias("table")]
    r = good.select("repo_key", "path", "model", F.explode("j.model.relationships").alias("r"))
    return {
        "tables": t.select(*key, F.coalesce("t.description", F.lit("")).alias("description")),
        "columns": t.select(*key, F.posexplode("t.columns").alias("pos", "c")).select("repo_key", "path", "model", "table", "pos", "c.name", F.coalesce("c.dataType", F.lit("")).alias("data_type"), F.coalesce("c.isHidden", F.lit(False)).alias("hidden"), (F.col("c.type") == "calculated").eqNullSafe(True).alias("calculated"), expression_text(F.col("c.expression")).alias("expression")),
        "measures": t.select(*key, F.explode("t.measures").alias("m")).select("repo_key", "path", "model", "table", "m.name", expression_text(F.col("m.expression")).alias("expression")),
        "partitions": t.select(*key, F.explode("t.partitions").alias("p")).select("repo_key", "path", "model", "table", "p.name", F.coalesce("p.mode", F.lit("")).alias("mode"), F.coalesce("p.source.type", F.lit("")).alias("type"), expression_text(F.coalesce("p.source.expression", "p.source.query")).alias("expression")),
        "relationships": r.select("repo_key", "path", "model", F.concat_ws(".", "r.fromTable", "r.fromColumn").alias("from"), F.concat_ws(".", "r.toTable", "r.toColumn").alias("to"), F.coalesce("r.isActive", F.lit(True)).alias("active"), (F.col("r.crossFilteringBehavior") == "bothDirections").eqNullSafe(True).alias("bidirectional")),
        "warnings": m.where("j.model is null").select(F.col("path").alias("file"), F.lit("no model in this file").alias("message"), F.lit("bim_parse").alias("category")),
    }


def _rows(files: DataFrame, schema: str, read: Callable[[dict], list[tuple]], columns: list[str]) -> DataFrame:
    """One file at a time through ``read``; a failure becomes a row with the error in ``problem``."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    out += [(row["repo_key"], row["path"], "", *r) for r in read(row)]
                except Exception as problem:  # one bad file gives one row
                    out.append((row["repo_key"], row["path"], f"{type(problem).__name__}: {problem}"[:300], *[None] * len(names)))
            yield pd.DataFrame(out, columns=["repo_key", "path", "problem", *names])

    return files.select("repo_key", "path", *columns).mapInPandas(run, f"repo_key string, path string, problem string, {schema}")


_HEAD = re.compile(r"^(\t*| *)(table|column|measure|partition|relationship|expression)\s+('(?:[^']|'')*'|[^\s=]+)\s*(?:=\s*(.*))?$")


FENCE = "```"


def unquoted(name: str) -> str:
    return name[1:-1].replace("''", "'") if name[:1] == "'" else name


def tmdl_objects(text: str) -> list[tuple]:
    """(kind, table, name, value, properties as JSON) of one TMDL text, by indentation.

    The value is what follows '=': the rest of the line, or the deeper indented lines below, without their indent.
    """
    out: list[list] = []
    table, current, depth, block, doc, fenced = "", None, 0, False, [], False
    for line in text.split("\n"):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if fenced:  # until the closing fence, or what stands no deeper than the object where there is none
            if bare == FENCE or (bare and indent <= fence_depth):
                fenced = False
                if bare == FENCE:
                    continue
            else:
                current[3].append(line)
                continue
        if block and (not bare or indent > depth + 1):
            current[3].append(line)
            continue
        if not bare:
            continue
        block = False
        if bare.startswith("///"):
            doc.append(bare[3:].strip())
            continue
        head = _HEAD.match(line)
        if head:
            kind, name, value = head[2], unquoted(head[3]), head[4]
            table = name if kind == "table" else table if kind in ("column", "measure", "partition") else ""
            current, depth = [kind, table, name, [value] if value else [], {"description": " ".join(doc)} if doc else {}], indent
            if kind == "partition" and value:
                current[4]["type"] = value.strip()
            out.append(current)
            block, doc = value is not None, []
            if value and value.strip() == FENCE:
                current[3], block, fenced, fence_depth = [""], False, True, indent
        elif current is not None and indent > depth:
            key, sep, value = bare.partition(":")
            equals = re.match(r"^(source|expression)\s*=\s*(.*)$", bare)
            if equals:
                current[3] = [equals[2]] if equals[2] else []
                block = True
                depth = indent - 1
                if equals[2].strip() == FENCE:
                    current[3], block, fenced, fence_depth = [""], False, True, indent
            elif sep:
                current[4][key.strip()] = value.strip()
            else:
                current[4][bare] = True
        doc = []
    dedented = lambda lines: "\n".join(x.strip("\n") for x in _dedent(lines)).strip("\n ")
    return [(k, t, n, dedented(v), json.dumps(p, sort_keys=True)) for k, t, n, v, p in out]


def _dedent(lines: list[str]) -> list[str]:
    deep = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()] or [0]
    return [x.strip() if i == 0 else x[min(deep) :] for i, x in enumerate(lines)]


def tmdl(files: DataFrame) -> DataFrame:
    """(…, kind, table_name, name, value, properties) of every TMDL file."""
    return _rows(files, "kind string, table_name string, name string, value string, properties string", lambda r: tmdl_objects(r["text"]), ["text"])


def bim_objects(text: str) -> list[tuple]:
    """(kind, table, name, value, properties as JSON) of one model file in JSON, as ``tmdl_objects`` gives them."""
    model = json.loads(text, strict=False)["model"]
    lines = lambda x: "\n".join(x) if isinstance(x, list) else x or ""
    out: list[tuple] = []

    def add(kind: str, table: str, x: dict, value, taken: tuple[str, ...], **more) -> None:
        props = {k: v for k, v in x.items() if k not in ("name", *taken) and isinstance(v, str | int | float | bool)}
        out.append((kind, table, x.get("name") or "", lines(value), json.dumps({**props, **more}, sort_keys=True)))

    for t in model.get("tables") or []:
        add("table", t["name"], t, "", ())
        for kind in ("column", "measure"):
            for x in t.get(f"{kind}s") or []:
                add(kind, t["name"], x, x.get("expression"), ("expression",))
        for x in t.get("partitions") or []:
            source = x.get("source") or {}
            add("partition", t["name"], x, source.get("expression") or source.get("query"), (), type=source.get("type") or "")
    for x in model.get("relationships") or []:
        ends = {end: f"{x.get(f'{end[:-6]}Table')}.{x.get(end)}" for end in ("fromColumn", "toColumn")}
        add("relationship", "", x, "", ("fromTable", "toTable", "fromColumn", "toColumn"), **ends)
    return out


# The keys under which a report names what a field reference is.
_KINDS = {"Measure": "measure", "Column": "column", "HierarchyLevel": "column", "Aggregation": "column"}


def bindings_of(tree, role: str = "visual") -> list[tuple[str, str, str, str]]:
    """(entity, property, kind, role) of every reference in a report's JSON, in order of appearance, once each."""
    out: dict[tuple, None] = {}

    def entity_of(x, aliases) -> str:
        while isinstance(x, dict):
            ref = x.get("SourceRef")
            if isinstance(ref, dict):
                return ref.get("Entity") or aliases.get(ref.get("Source"), "")
            x = x.get("Expression")
        return ""

    def walk(x, role, aliases) -> None:
        if isinstance(x, str) and x[:1] in "{[" and len(x) > 1:
            try:
                x = json.loads(x)
            except ValueError:
                return
        if isinstance(x, list):
            for y in x:
                walk(y, role, aliases)
        elif isinstance(x, dict):
            named = {f["Name"]: f["Entity"] for f in x.get("From", []) if isinstance(f, dict) and "Name" in f and "Entity" in f} if isinstance(x.get("From"), list) else {}
            aliases = {**aliases, **named}
            for key, y in x.items():
                if key in _KINDS and isinstance(y, dict) and isinstance(y.get("Property"), str) and (e := entity_of(y, aliases)):
                    out[e, y["Property"], _KINDS[key], role] = None
                walk(y, "filter" if key in ("filterConfig", "filters") else role, aliases)

    walk(tree, role, {})
    return list(out)


def report_bindings(files: DataFrame) -> DataFrame:
    """(…, entity, property, kind, role) of report, page and visual files, JSON inside JSON strings included."""
    return _rows(files, "entity string, property string, kind string, role string", lambda r: bindings_of(json.loads(r["text"], strict=False)), ["text"])


def legacy_fields(tree: dict) -> list[tuple[str, str, str | None, str | None, str | None, str | None]]:
    """(page, visual, entity, property, kind, role) of a report of the older kind: of each section's visuals, known by their
    place if they have no name, and, without a visual, of a section's and the report's filters. A visual without fields
    gives one row without them."""
    out: list[tuple] = [("", "", *b) for b in bindings_of(tree.get("filters"), "filter")]
    for n, section in enumerate(tree.get("sections") or []):
        page = section.get("displayName") or section.get("name") or str(n)
        out += [(page, "", *b) for b in bindings_of(section.get("filters"), "filter")]
        for k, visual in enumerate(section.get("visualContainers") or []):
            config = visual.get("config")
            config = json.loads(config, strict=False) if isinstance(config, str) else config
            name = (config.get("name") if isinstance(config, dict) else None) or str(k)
            out += [(page, name, *b) for b in bindings_of(visual)] or [(page, name, None, None, None, None)]
    return out


def legacy_reports(files: DataFrame) -> DataFrame:
    """(…, page, visual, entity, property, kind, role) of report.json files of the older kind."""
    return _rows(files, "page string, visual string, entity string, property string, kind string, role string", lambda r: legacy_fields(json.loads(r["text"], strict=False)), ["text"])


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    info = archive.getinfo(name)
    if info.file_size > MOST_MEMBER:
        raise ValueError(f"{name} is larger than {MOST_MEMBER} bytes")
    return archive.read(name)


def archive_rows(raw: bytes) -> list[tuple]:
    """(what, name, property, kind, role, text) of a report archive: its layout's bindings and its M section."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        out = []
        if "Report/Layout" in z.namelist():
            layout = json.loads(_member(z, "Report/Layout").decode("utf-16-le").lstrip("﻿"), strict=False)
            out += [("binding", e, p, k, r, "") for e, p, k, r in bindings_of(layout)]
        if "DataMashup" in z.namelist():
            mashup = _member(z, "DataMashup")
            begin = mashup.find(b"PK\x03\x04")
            if begin >= 0:
                with zipfile.ZipFile(io.BytesIO(mashup[begin:])) as inner:
                    section = next((n for n in inner.namelist() if n.endswith("Section1.m")), None)
                    if section:
                        text = _member(inner, section).decode("utf-8-sig", "replace")
                        out += [("expression", n.strip('#"'), "", "", "", body.strip()) for n, body in re.findall(r'shared\s+(#"[^"]+"|\w+)\s*=\s*((?:"(?:[^"]|"")*"|[^;"])*);', text)]
        return out


def archives(files: DataFrame) -> DataFrame:
    """Rows of report archives (repo_key, path, content binary)."""
    return _rows(files, "what string, name string, property string, kind string, role string, text string", lambda r: archive_rows(bytes(r["content"])), ["content"])


def declared_model(text: Column, path: Column) -> Column:
    """The model that a report's definition names: by path (its folder's name) or by connection (initial catalog)."""
    by_path = F.regexp_extract(F.get_json_object(text, "$.datasetReference.byPath.path"), r"([^/\\]+?)(?i:\.SemanticModel)?/?$", 1)
    by_connection = F.regexp_extract(F.get_json_object(text, "$.datasetReference.byConnection.connectionString"), r"(?i)initial catalog\s*=\s*\"?([^;\"]+)", 1)
    return F.coalesce(F.nullif(by_path, F.lit("")), F.nullif(by_connection, F.lit("")))


#: Characters of a name in a mask: word characters, dots, and what stands for others inside quotes.
_WORD = r"[\w.\x{80}-\x{FFFF}]"
# Functions that open a lake, the library and the ending of others, keys of what lies there, tables in the text.
LAKES, LAKE_LIBRARY, WAREHOUSE, LAKE_KEYS = ["Lakehouse.Contents"], "Fabric.", ".Warehouse", ["Name", "Id"]
WRITTEN_OUT = ["Table.FromRows", "#table", "Json.Document"]
_VALUE = rf'("[^"]*+"|#"[^"]*+"|{_WORD}++)'


def _literal(value: Column, names: Column, values: Column) -> Column:
    """The text of a quoted value, or of the one that a ``let`` name is bound to; null if it is neither."""
    bound = F.try_element_at(values, F.array_position(names, value).cast("int"))
    text = F.when(value.startswith('"'), F.substring(value, F.lit(2), F.length(value) - 2)).when((value != "") & (F.array_position(names, value) > 0), bound)
    return F.replace(unmasked(text), F.lit('""'), F.lit('"'))


def m_sources(partitions: DataFrame, text_col: str = "expression") -> DataFrame:
    """(…, schema_name, name, raw_kind) of what an M expression reads, each source once; steps that its result does not need
    read nothing.

    Kinds: navigation (records with Schema and Item, as text or as names bound in the ``let``), native_query (tables of
    the SQL in Value.NativeQuery or in a Query option, which may be bound too), as_model (another model, alone), and, only
    where none of these is there, lakehouse (the last two Name or Id values) and static (tables written out in M).
    """
    keys = partitions.columns
    bind = rf'(?<![\w.\[\x{{80}}-\x{{FFFF}}])(#"[^"]*+"|{_WORD}++)\s*+=\s*+"([^"]*+)"'
    m = partitions.withColumn("__m", m_reached(m_mask(F.col(text_col))))
    m = m.withColumns({"__names": F.regexp_extract_all("__m", F.lit(bind), F.lit(1)), "__values": F.regexp_extract_all("__m", F.lit(bind), F.lit(2))})
    value = lambda record, key: _literal(F.regexp_extract(record, rf"(?:^|[,\s])(?:{key})\s*+=\s*+{_VALUE}", 1), F.col("__names"), F.col("__values"))
    made = lambda schema, name, kind: F.struct(F.lower(schema).alias("schema_name"), F.lower(name).alias("name"), F.lit(kind).alias("raw_kind"))
    records = F.regexp_extract_all("__m", F.lit(r"\{\s*+\[([^\[\]{}]*+)\]\s*+\}"), F.lit(1))
    full = lambda x: x["schema_name"].isNotNull() & x["name"].isNotNull()
    navigation = F.filter(F.transform(records, lambda r: made(value(r, "Schema"), value(r, "Item"), "navigation")), full)
    called = lambda name: rf"(?<![\w.#]){name}\s*+\("
    argument = r"(?:[^(),]++|\([^()]*+\))"
    queries = F.regexp_extract_all("__m", F.lit(rf"{called('Value.NativeQuery')}{argument}++,\s*+{_VALUE}"), F.lit(1))
    options = F.flatten(F.transform(F.regexp_extract_all("__m", F.lit(rf"{called('Sql.Databases?')}([^()]*+)\)"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(rf"(?<!\w)Query\s*+=\s*+{_VALUE}"), F.lit(1))))
    sql = F.filter(F.transform(F.concat(queries, options), lambda q: F.replace(_literal(q, F.col("__names"), F.col("__values")), F.lit("#(lf)"), F.lit("\n"))), lambda x: x.isNotNull())
    opened = F.regexp_extract("__m", rf"{called('AnalysisServices.Database')}([^()]*+)\)", 1)
    model = F.try_element_at(F.regexp_extract_all(opened, F.lit('"([^"]*+)"'), F.lit(1)), F.lit(2))
    functions = F.regexp_extract_all("__m", F.lit(rf"(#?{_WORD}++)\s*+\("), F.lit(1))
    fields = F.regexp_extract_all("__m", F.lit(r'(\w++)\s*+=\s*+"[^"]++"'), F.lit(1)), F.regexp_extract_all("__m", F.lit(r'\w++\s*+=\s*+"([^"]++)"'), F.lit(1))
    lake = F.transform(F.filter(F.arrays_zip(fields[0].alias("key"), fields[1].alias("value")), lambda f: f["key"].isin(*LAKE_KEYS)), lambda f: unmasked(f["value"]))
    in_lake = F.exists("__functions", lambda f: f.isin(*LAKES) | f.startswith(LAKE_LIBRARY) | f.endswith(WAREHOUSE)) & (F.size("__lake") > 0)
    static = F.arrays_overlap("__functions", F.array(*map(F.lit, WRITTEN_OUT)))
    m = m.withColumns({"__nav": navigation, "__sql": sql, "__model": F.coalesce(unmasked(model), F.lit("")), "__lake": lake, "__functions": functions})
    other = F.when(in_lake, F.array(made(F.when(F.size("__lake") > 1, F.element_at("__lake", -2)).otherwise(""), F.element_at("__lake", -1), "lakehouse"))).when(static, F.array(made(F.lit(""), F.lit(""), "static")))
    direct = F.when(F.col("__model") != "", F.array(F.struct(F.lit("").alias("schema_name"), F.col("__model").alias("name"), F.lit("as_model").alias("raw_kind")))).when(F.size("__nav") > 0, F.array_distinct("__nav")).when(F.size("__sql") == 0, other)
    m = cut_columns(m, keys, {"__direct": direct, "__sql": F.col("__sql")})
    found = m.select(*keys, F.explode("__direct").alias("x")).select(*keys, "x.*")

    q = m.select(*keys, F.posexplode("__sql").alias("__q", "sql")).withColumn("sql", sql_mask("sql"))
    native = statement_lineage(q).where("direction = 'reads'").select(*keys, "schema_name", "name", F.lit("native_query").alias("raw_kind"))
    return found.unionByName(native).distinct()


def cut_columns(df: DataFrame, keys: list[str], made: dict[str, Column]) -> DataFrame:
    """The keys and some made columns; the rest goes."""
    return df.select(*keys, *[c.alias(name) for name, c in made.items()])


_DAX_NAME = r"(?:'[^']*+'|[\w.\x{80}-\x{DFFF}\x{F900}-\x{FFFF}]++)"


def dax_refs(expressions: DataFrame, text_col: str = "expression") -> DataFrame:
    """(…, table_name, name): ``T[x]`` and ``'T t'[x]`` with their table, bare ``[x]`` with an empty one, once each."""
    marked = F.regexp_replace(dax_mask(F.col(text_col)), r"(?i)\b(return|var|in|not|and|or)(\s*+\[)", "$1 ;$2")  # after these a bracket is bare
    begin = r"(?<![\w.'\x{80}-\x{DFFF}\x{F900}-\x{FFFF}])"
    found = lambda group: F.regexp_extract_all(marked, F.lit(rf"{begin}({_DAX_NAME}|)\s*+\[([^\]]*+)\]"), F.lit(group))
    pairs = F.explode(F.array_distinct(F.arrays_zip(found(1).alias("t"), found(2).alias("n")))).alias("p")
    r = expressions.select(*expressions.columns, pairs)
    table_name = F.replace(unmasked(F.regexp_replace("p.t", "^'|'$", "")), F.lit("''"), F.lit("'"))
    return r.select(*expressions.columns, table_name.alias("table_name"), F.replace(unmasked(F.col("p.n")), F.lit("]]"), F.lit("]")).alias("name")).distinct()


def dax_tables(expressions: DataFrame, tables: DataFrame, text_col: str = "expression") -> DataFrame:
    """(…, table_name) of the model's tables (model, table_name) that an expression (…, model) names, in quotes or bare.

    A name that the expression binds by VAR is no table, nor is what is called as a function.
    """
    keys = expressions.columns
    e = expressions.withColumn("__d", dax_mask(F.col(text_col)))
    shadow = F.transform(F.regexp_extract_all("__d", F.lit(r"(?i)\bvar\s+(\w++)\s*+="), F.lit(1)), lambda x: F.lower(x))
    no_columns = F.regexp_replace("__d", r"\[[^\]]*+\]", " ")
    quoted = F.transform(F.regexp_extract_all(no_columns, F.lit("'([^']*+)'"), F.lit(1)), lambda x: F.lower(F.replace(unmasked(x), F.lit("''"), F.lit("'"))))
    bare = F.transform(F.regexp_extract_all(F.regexp_replace(no_columns, "'[^']*+'", " "), F.lit(r"(?<![\w.'])([A-Za-z_\x{80}-\x{DFFF}][\w\x{80}-\x{DFFF}]*+)(?!\s*+\()"), F.lit(1)), lambda x: F.lower(x))
    words = F.array_distinct(F.concat(quoted, F.filter(bare, lambda x: ~F.array_contains("__shadow", x))))
    w = e.withColumn("__shadow", shadow).select(*keys, F.explode(words).alias("__w"))
    known = tables.select("model", "table_name", F.lower("table_name").alias("__w")).distinct()
    return w.join(known, ["model", "__w"]).select(*keys, "table_name").distinct()
