"""Column functions of the engine's own library: identifiers, ids, hashes, escapes, and file kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of input files, each with the pattern of its path (tried in this order).
FILE_KINDS = [
    ("sql_file", r"(?i)\.sql$"),
    ("tmdl", r"(?i)\.tmdl$"),
    ("bim", r"(?i)\.bim$"),
    ("pbix", r"(?i)\.pbix$"),
    ("pbir_definition", r"(?i)(^|/)definition\.pbir$"),
    ("pbir_visual", r"definition/pages/[^/]+/visuals/[^/]+/visual\.json$"),
    ("pbir_page", r"definition/pages/[^/]+/page\.json$"),
    ("pbir_report", r"(^|/)definition/report\.json$"),
    ("report_json_legacy", r"(?i)^(?!(?:.*/)?(?-i:definition)/)(?:.*/)?report\.json$"),
]

#: Edge types whose data flow runs from target to source.
AGAINST = ("reads", "references", "visualizes")


def normalize_identifier(c: Column) -> Column:
    """Lower case, without brackets, quotes and backticks, trimmed."""
    return F.lower(F.trim(F.regexp_replace(c, "[\\[\\]\"'`]", "")))


def make_id(node_type: Column, schema: Column, name: Column) -> Column:
    """``type:schema.name``, or ``type:name`` where the schema is empty."""
    s, n = normalize_identifier(F.coalesce(schema, F.lit(""))), normalize_identifier(name)
    return F.concat(node_type, F.lit(":"), F.when(s != "", F.concat(s, F.lit("."), n)).otherwise(n))


def display(display_name: Column, name: Column) -> Column:
    """The original spelling, or the name where there is none."""
    return F.coalesce(F.nullif(display_name, F.lit("")), name)


def qualified_parts(raw: Column) -> Column:
    """Parts of a dotted name, empty ones left out: cut at the dots that no bracket and no pair of double quotes encloses."""
    return F.filter(F.split(raw, r'\.(?![^\[\]]*+\])(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'), lambda x: x != "")


def qualify(raw: Column, default_schema: str = "dbo") -> Column:
    """``struct<schema_name, name>``: the last part is the name, all before it the schema."""
    p = F.transform(qualified_parts(raw), normalize_identifier)
    schema = F.when(F.size(p) > 1, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ".")).otherwise(F.lit(default_schema))
    return F.struct(schema.alias("schema_name"), F.try_element_at(p, F.lit(-1)).alias("name"))


def original_name(raw: Column) -> Column:
    """The last part in its original case."""
    return F.trim(F.regexp_replace(F.try_element_at(qualified_parts(raw), F.lit(-1)), "[\\[\\]\"'`]", ""))


def slug(node_id: Column, node_type: Column) -> Column:
    """A file name: unsafe characters to single dashes, at most 80 characters, and 8 digits of the id's SHA-1."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(node_id), "[^a-z0-9_-]", "-"), "-+", "-")
    safe = F.regexp_replace(F.left(F.regexp_replace(safe, "^[-. ]+|[-. ]+$", ""), F.lit(80)), "[-. ]+$", "")
    return F.concat(F.when(safe != "", safe).otherwise(node_type), F.lit("-"), F.left(F.sha1(node_id.cast("binary")), F.lit(8)))


def definition_hash(code: Column) -> Column:
    return F.sha2(code.cast("binary"), 256)


def cache_key(version: str, dialect: str, step: str, repo: Column, path: Column, sha: Column) -> Column:
    """The key of a remembered extraction: everything that its result depends on."""
    return F.concat_ws("\x1f", F.lit(version), F.lit(dialect), F.lit(step), F.concat_ws("/", repo, path), sha)


def csv_neutralize(c: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(c.rlike("^\\s*[=+@-]|^[\\t\\r\\n]"), F.concat(F.lit("'"), c)).otherwise(c)


def md_cell(c: Column) -> Column:
    """Text made safe for a cell of a Markdown table."""
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.trim(F.regexp_replace(F.replace(out, F.lit("|"), F.lit("\\|")), "[\\r\\n]+", " "))


def file_kind(path: Column) -> Column:
    """Kind of an input file by its path; null for files that are no input."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(FILE_KINDS):
        out = F.when(path.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """A path glob as a case-insensitive regex: ``**`` crosses folders and may be empty, ``*`` and ``?`` cross as well."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + ".*", i + (2 if glob.startswith("**", i) else 1)
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "_/ " and ord(glob[i]) < 128 else glob[i]), i + 1
    return f"(?is)^{out}$"


def glob_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path is wanted; exclusion wins, and no include pattern means all."""
    any_of = lambda globs: F.coalesce(*([F.lit(None).cast("boolean")] + [path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))] if globs else [F.lit(False)]))
    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def flow(edge_type: Column, source: Column, target: Column) -> tuple[Column, Column]:
    """(up, down) ends of an edge in the direction of the data."""
    against = edge_type.isin(*AGAINST)
    return F.when(against, target).otherwise(source), F.when(against, source).otherwise(target)


# How the tables begin that a model makes for its date columns; the rest is an id in hex digits.
DATE_TABLES = ["localdatetable_", "datetabletemplate_"]


def auto_date_entity(entity: Column) -> Column:
    """Whether a table is one of the hidden ones that a model makes for every date column."""
    low = F.lower(entity)
    of = lambda prefix: low.startswith(prefix) & (F.length(low) >= len(prefix) + 8) & (F.translate(F.substr(low, F.lit(len(prefix) + 1)), "0123456789abcdef-", "") == "")
    return F.coalesce(of(DATE_TABLES[0]) | of(DATE_TABLES[1]), F.lit(False))


def _root(path: Column, suffix: str, plain: Column) -> Column:
    marked = F.regexp_extract(path, rf"(?i)^((?:[^/]+/)*?[^/]*\.{suffix})(?:/|$)", 1)
    before = F.regexp_extract(path, r"^((?:[^/]+/)*?[^/]+)/definition/", 1)
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    first = F.element_at(F.split(path, "/"), 1)
    root = F.when(marked != "", marked).when(before != "", before).otherwise(F.when(path.contains("/"), first).otherwise(""))
    name = F.when(marked != "", F.substring(last(marked), F.lit(1), F.length(last(marked)) - len(suffix) - 1)).when(before != "", last(before)).otherwise(plain)
    return F.struct(root.alias("root"), name.alias("name"))


def model_root(path: Column) -> Column:
    """``struct<root, name>`` of the model that a file belongs to: its .SemanticModel folder, else what holds ``definition``."""
    return _root(path, "semanticmodel", F.regexp_replace(F.element_at(F.split(path, "/"), 1), r"\.[^.]*$", ""))


def report_root(path: Column) -> Column:
    """The same of a report, by its .Report folder."""
    return _root(path, "report", F.element_at(F.split(path, "/"), 1))


def shortened(code: Column, limit: int = 100_000) -> Column:
    """Source code as it is shown: its first ``limit`` characters (a display limit of the pages, 100,000 by rule)."""
    return F.left(code, F.lit(limit))


def md_text(c: Column) -> Column:
    """Text outside of tables: HTML and Markdown signs made harmless."""
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(out, r"([\\`*_\[\]])", r"\\$1")


def inline_code(c: Column) -> Column:
    """Code in a line, in as many backticks as it needs."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    n = F.when(F.size(runs) > 0, F.array_max(runs)).otherwise(0) + 1
    edge = F.when(c.startswith("`") | c.endswith("`"), F.lit(" ")).otherwise("")
    return F.concat(F.repeat(F.lit("`"), n), edge, c, edge, F.repeat(F.lit("`"), n))


def html_attribute(c: Column) -> Column:
    """A value between double quotes of HTML."""
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
