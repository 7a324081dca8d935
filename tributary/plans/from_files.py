"""From a tree of files to the linked, layered and pruned graph.

``inputs`` turns the texts of all kinds of files into the tables that ``build`` takes; ``estate`` runs the whole way: extract,
build, link, give layers, prune. Files are rows (repo_key, path, kind, text), as ``sources.files`` reads them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import make_id
from ..operators import graph, layering, quality, reports, roots
from ..sources import models
from . import build
from .session import cut


class Settings(NamedTuple):
    """What people configure: layers by schema or path, schemas left out or kept, schemas that models map to, and answers."""

    layers: dict[str, dict[str, list[str]]] = {}
    ignore: list[str] = []
    include: list[str] = []
    mappings: DataFrame | None = None
    decisions: DataFrame | None = None
    similar: bool = True


def _table_id(model: Column, name: Column) -> Column:
    return make_id(F.lit("pbi_table"), model, name)


def model_inputs(files: DataFrame) -> dict[str, DataFrame]:
    """tables, partitions, measures and columns of TMDL and BIM files; TMDL files go to the nearest root above them."""
    kind = lambda k: files.where(F.col("kind") == k)
    rows = cut(models.tmdl(roots.nearest(kind("tmdl"), roots.model_roots(files)).select("repo_key", "path", "text")))
    owned = roots.nearest(rows, roots.model_roots(files)).withColumnRenamed("owner", "model")
    tom = models.tom(kind("bim"))
    of = lambda k: owned.where((F.col("kind") == k) & (F.col("problem") == ""))
    both = lambda a, b: a.unionByName(b).distinct()
    prop = lambda p: F.get_json_object("properties", f"$.{p}")
    source_type = F.lower(F.coalesce(prop("type"), F.lit("m")))
    tables = both(of("table").select("model", F.col("name").alias("table_name")), tom["tables"].select("model", F.col("table").alias("table_name")))
    measures = both(of("measure").select("model", "table_name", "name", F.col("value").alias("expression")), tom["measures"].select("model", F.col("table").alias("table_name"), "name", "expression"))
    columns = both(of("column").select("model", "table_name", "name"), tom["columns"].select("model", F.col("table").alias("table_name"), "name"))
    parts = both(of("partition").select("model", "table_name", "name", source_type.alias("type"), F.col("value").alias("expression")), tom["partitions"].select("model", F.col("table").alias("table_name"), "name", "type", "expression"))
    with_id = lambda df: df.withColumn("table_id", _table_id(F.col("model"), F.col("table_name")))
    first = lambda df, *keys: df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in df.columns if c not in keys]).select(df.columns)
    # names that differ only in case are one table or measure
    return {
        "tables": first(with_id(tables), "model", "table_id").select("table_id", "model", "table_name"),
        "partitions": with_id(parts).select("table_id", "model", "name", "type", "expression"),
        "measures": first(measures.withColumn("id", make_id(F.lit("measure"), F.col("model"), F.col("name"))), "id").select("id", "model", "table_name", "name", "expression"),
        "columns": columns,
        "warnings": tom["warnings"].unionByName(rows.where("problem <> ''").select(F.col("path").alias("file"), F.col("problem").alias("message"), F.lit("tmdl_parse").alias("category"))),
    }


def _report_files(files: DataFrame) -> DataFrame:
    """Report files with their ``root`` and ``report``."""
    return cut(roots.nearest(files.where(F.col("kind").startswith("pbir") | (F.col("kind") == "report_json_legacy")), roots.report_roots(files)).withColumnRenamed("owner", "report"))


def _within(*c: Column | str) -> Column:
    return F.concat_ws(".", *c)


def _visuals(owned: DataFrame) -> DataFrame:
    """(repo_key, path, report, page, visual, file) of visual files, with their pages' names."""
    kind = lambda k: owned.where(F.col("kind") == k)
    page_key = F.regexp_extract("path", r"/?pages/([^/]+)/", 1)
    pages = kind("pbir_page").select("repo_key", "root", page_key.alias("page_key"), F.coalesce(F.get_json_object("text", "$.displayName"), page_key).alias("page"))
    visuals = kind("pbir_visual").select("repo_key", "root", "path", "report", page_key.alias("page_key"), F.coalesce(F.get_json_object("text", "$.name"), roots.last_part(roots.folder(F.col("path")))).alias("v"))
    visuals = visuals.join(pages.hint("merge"), ["repo_key", "root", "page_key"], "left")
    return visuals.select("repo_key", "path", "report", _within("report", F.coalesce("page", "page_key")).alias("page"), _within("report", "page_key", "v").alias("visual"), F.col("path").alias("file"))


def _legacy(owned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, read, visuals) of reports of the older kind: all rows, those without a problem by report, and their visuals."""
    rows = cut(models.legacy_reports(owned.where("kind = 'report_json_legacy'").select("repo_key", "path", "text")))
    read = rows.where("problem = ''").join(owned.select("repo_key", "path", "report").hint("merge"), ["repo_key", "path"])
    return rows, read, read.where("visual <> ''").select("report", _within("report", "page").alias("page"), _within("report", "page", "visual").alias("visual"), F.col("path").alias("file")).distinct()


def report_visuals(files: DataFrame) -> DataFrame:
    """(report, page, visual, file) of all visuals; nothing else is read of report files."""
    owned = _report_files(files)
    return _visuals(owned).select("report", "page", "visual", "file").unionByName(_legacy(owned)[2])


def report_inputs(files: DataFrame) -> dict[str, DataFrame]:
    """visuals (report, page, visual, file), shown, filters and declared models of report files, by their nearest root.

    Files are joined by sorting, whatever size the planner expects of texts and paths that are made of small columns.
    """
    owned = _report_files(files)
    kind = lambda *k: owned.where(F.col("kind").isin(*k))
    visuals = _visuals(owned)

    rows = cut(models.report_bindings(kind("pbir_visual", "pbir_page", "pbir_report").select("repo_key", "path", "text")))
    fields = rows.where("problem = ''").join(owned.select("repo_key", "path", "report", "kind").withColumnRenamed("kind", "file_kind").hint("merge"), ["repo_key", "path"])
    old, old_rows, visuals_of_old = _legacy(owned)
    old_visual = _within("report", "page", "visual")

    visual_id = lambda c: F.concat(F.lit("visual:"), F.lower(c))
    report_id = F.concat(F.lit("report:"), F.lower("report"))
    in_visuals = fields.where("file_kind = 'pbir_visual'").join(visuals.select("repo_key", "path", "visual").hint("merge"), ["repo_key", "path"])
    role = F.when(F.col("role") == "filter", "filter").otherwise("shown")
    shown = in_visuals.select(visual_id("visual").alias("source_id"), "report", "visual", "entity", "property", "kind", role.alias("role"))
    shown = shown.unionByName(old_rows.where("visual <> '' and entity is not null").select(visual_id(old_visual).alias("source_id"), "report", old_visual.alias("visual"), "entity", "property", "kind", role.alias("role")))
    scope = F.when(F.col("file_kind") == "pbir_page", "page").otherwise("report")
    filters = fields.where("file_kind <> 'pbir_visual' and role = 'filter'").select(report_id.alias("source_id"), "report", "entity", "property", "kind", scope.alias("scope"))
    filters = filters.unionByName(old_rows.where("visual = '' and entity is not null").select(report_id.alias("source_id"), "report", "entity", "property", "kind", F.when(F.col("page") == "", "report").otherwise("page").alias("scope")))
    declared = kind("pbir_definition").select("report", models.declared_model(F.col("text"), F.col("path")).alias("model")).where("model is not null").distinct()
    bad = rows.where("problem <> ''").select("path", "problem").unionByName(old.where("problem <> ''").select("path", "problem"))
    return {
        "visuals": visuals.select("report", "page", "visual", "file").unionByName(visuals_of_old),
        "shown": shown,
        "filters": filters,
        "declared": declared,
        "warnings": bad.select(F.col("path").alias("file"), F.col("problem").alias("message"), F.lit("report_parse").alias("category")),
    }


def inputs(files: DataFrame) -> dict[str, DataFrame]:
    """The tables that ``build.build`` takes, of files (repo_key, path, kind, text), with visuals and warnings."""
    m, r = model_inputs(files), report_inputs(files)
    scripts = files.where("kind = 'sql_file'").select("repo_key", "path", "text")
    return {"scripts": scripts, **{k: m[k] for k in ("tables", "partitions", "measures", "columns")}, **{k: r[k] for k in ("visuals", "shown", "filters", "declared")}, "warnings": m["warnings"].unionByName(r["warnings"])}


def estate(files: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """The graph of all files: nodes, edges, warnings, links (key, target, method), unresolved, field_refs, and the pages
    and visuals that reports are made of (``chain_nodes``, ``chain_edges``)."""
    s = settings or Settings()
    t = inputs(files)
    links = build.Links(s.mappings, s.decisions, s.similar)
    g = build.build(t["scripts"], t["tables"], t["partitions"], t["measures"], t["shown"], t["filters"], t["declared"], t["columns"], links)
    nodes, edges = layers(cut(g["nodes"]), cut(g["edges"]), s.layers)
    nodes, edges = layering.prune_schemas(nodes, edges, s.ignore, s.include)
    chain_nodes, chain_edges = reports.chain(t["visuals"])
    return {**g, "nodes": nodes, "edges": edges, "warnings": g["warnings"].unionByName(quality.diagnostics_rows(t["warnings"])), "chain_nodes": chain_nodes, "chain_edges": chain_edges}


def layers(nodes: DataFrame, edges: DataFrame, rules: dict[str, dict[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with tables retyped to their layer: by rule, else bronze where nothing makes a table (see
    ``layering.layer_heuristic``); views and procedures keep their type."""
    tables = nodes.where("node_type = 'gold_table'").withColumn("layer", layering.layer_rule(rules))
    loose = layering.layer_heuristic(tables, edges).withColumn("h", F.lit("bronze"))
    layer = tables.join(loose.hint("merge"), "id", "left").select("id", "schema_name", "name", F.coalesce("layer", "h", F.lit("gold")).alias("layer"))
    moved = cut(layer.where("layer <> 'gold'").select(F.col("id").alias("old"), make_id(F.concat("layer", F.lit("_table")), F.col("schema_name"), F.col("name")).alias("new"), F.concat("layer", F.lit("_table")).alias("new_type"))).hint("merge")
    typed = nodes.join(moved.select(F.col("old").alias("id"), "new_type"), "id", "left").withColumn("node_type", F.coalesce("new_type", "node_type")).drop("new_type")
    scalars = [c for c in nodes.columns if c != "id"]
    return graph.retype(typed, moved.select("old", "new"), scalars).select(*nodes.columns), graph.rename_ends(edges.withColumn("ord", F.col("evidence")), moved.select("old", "new")).select(*edges.columns)
