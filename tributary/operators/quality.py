"""Diagnostics, gates, coverage, and what nobody uses."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut, dealt

# The warning categories by severity (unknown ones are warnings), and the sets that gates look at.
ERRORS = [
    "identity_collision", "crawl_incomplete", "tmdl_parse", "bim_parse", "pbir_parse", "report_json_parse", "pbix_unreadable", "pbix_layout_parse",
    "cache_invalid", "encoding_unreadable", "proc_body_not_found", "parse_worker_error", "symlink_escape", "file_too_large", "file_unreadable",
]
WARNINGS = [
    "pbir_stray_file", "dynamic_sql", "regex_fallback", "unresolved_partition_source", "unresolved_reference", "ambiguous_visual_binding",
    "unmatched_visual_entity", "pbir_external_model", "fuzzy_auto", "cache_pruned", "cache_source_changed", "cache_source_unverified",
    "cache_key_unmatched", "cache_write_failed", "parse_cache_invalid", "pbix_opaque_model", "reviews_retired", "catalog_dependency_unparsed",
    "catalog_dependencies_unreadable", "sqlsc_declaration_mismatch", "sql_no_objects", "interactive_unavailable",
]
INFOS = ["layer_unclassified", "select_star_view", "unclassified_file"]
OMISSIONS = ["crawl_incomplete", "file_unreadable", "file_too_large", "symlink_escape"]
STRICT = ["regex_fallback", "dynamic_sql", "unresolved_partition_source", "ambiguous_visual_binding"]
STATES = ["unresolved", "missing", "partial", "unknown", "external"]
FACTS = {
    "unresolved": ["unresolved", "skipped", "partition_source_unresolved", "declared_model_unresolved", "pbix_model_opaque"],
    "missing": ["source_missing"],
    "partial": ["fuzzy_resolution", "dynamic_sql_untraced", "dax_refs_heuristic", "columns_unresolved", "cache_source_unverified"],
    "external": ["external_source"],
}


def severity_of(category: Column) -> Column:
    return F.when(category.isin(ERRORS), "error").when(category.isin(INFOS), "info").otherwise("warning")


def severity_rank(category: Column) -> Column:
    return F.when(category.isin(ERRORS), 0).when(category.isin(INFOS), 2).otherwise(1)


def severity_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy(severity_of(F.col("category")).alias("severity")).agg(F.count("*").alias("n"))


def category_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy(severity_of(F.col("category")).alias("severity"), "category").agg(F.count("*").alias("n"))


def diagnostics_rows(warnings: DataFrame) -> DataFrame:
    """Warnings with severity and rank, sorted by severity, category, file, message."""
    w = warnings.withColumns({"severity": severity_of(F.col("category")), "severity_rank": severity_rank(F.col("category"))})
    return w.orderBy("severity_rank", "category", "file", "message")


def top_files(warnings: DataFrame, n: int = 5) -> DataFrame:
    """The n files with most warnings, ties by name."""
    return warnings.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(n)


def gate_failures(warnings: DataFrame, gate: str = "default") -> DataFrame:
    """Warnings that fail the gate: omissions and identity collisions; strict adds four categories and all errors;
    lenient takes the errors."""
    c = F.col("category")
    blocked = c.isin([*OMISSIONS, "identity_collision"])
    fails = {"default": blocked, "strict": blocked | c.isin(STRICT) | c.isin(ERRORS), "lenient": c.isin(ERRORS)}[gate]
    return warnings.where(fails)


def source_coverage(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_key, n_files, state) of every declared source, those without files too."""
    n = files.groupBy("repo_key").agg(F.count("*").alias("n_files"))
    out = repos.select("repo_key").distinct().join(n, "repo_key", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    return out.withColumn("state", F.when(F.col("n_files") > 0, "scanned").otherwise("missing"))


def evidence_state(nodes: DataFrame, by: list[str]) -> DataFrame:
    """The state of the evidence of each group of nodes: the worst of what its nodes show, else complete. Facts that the
    nodes have no column for are not there."""
    has = lambda name: F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in nodes.columns else F.lit(False)
    any_of = lambda names: functools.reduce(lambda a, b: a | b, map(has, names))
    by_regex = F.coalesce(F.col("parse_quality") == "regex_fallback", F.lit(False)) if "parse_quality" in nodes.columns else F.lit(False)
    sql = F.col("node_type").isin("bronze_table", "silver_table", "gold_table", "view", "stored_proc")
    show = {state: any_of(names) for state, names in FACTS.items()} | {"unknown": (F.col("source_file") == "") & sql}
    show["partial"] = show["partial"] | by_regex
    flags = nodes.groupBy(*by).agg(*[F.coalesce(F.bool_or(show[s]), F.lit(False)).alias(s) for s in STATES])
    state = F.lit("complete")
    for s in reversed(STATES):
        state = F.when(F.col(s), F.lit(s)).otherwise(state)
    return flags.select(*by, state.alias("state"))


def identity_collisions(models: DataFrame) -> DataFrame:
    """(model, n_roots): names of models that come from more than one place; none of these may be merged."""
    n = F.count_distinct("repo_key", "root").alias("n_roots")
    return models.groupBy("model").agg(n).where("n_roots > 1")


def measure_homes(columns: DataFrame, measures: DataFrame) -> DataFrame:
    """(table_id) of tables with measures and no visible column."""
    visible = columns.where("not hidden").select("table_id")
    return measures.select("table_id").distinct().join(visible, "table_id", "left_anti")


def unused_measures(measures: DataFrame, edges: DataFrame) -> DataFrame:
    """Measures that nothing references or shows; the edge that a model feeds does not count."""
    used = edges.where("edge_type in ('references', 'visualizes')").select(F.col("target_id").alias("id"))
    return measures.join(used, "id", "left_anti")


def unused_fields(tables: DataFrame, columns: DataFrame, used_tables: DataFrame, used_columns: DataFrame, key_columns: DataFrame) -> DataFrame:
    """(table_id, name, kind): tables that no evidence uses, and of used tables the columns that none uses; relationship
    keys are never listed."""
    used = used_tables.select("table_id").unionByName(used_columns.select("table_id")).distinct()
    dead = tables.select("table_id").join(used, "table_id", "left_anti")
    spare = columns.select("table_id", "name").join(used, "table_id", "left_semi")
    spare = spare.join(used_columns.select("table_id", "name"), ["table_id", "name"], "left_anti").join(key_columns.select("table_id", "name"), ["table_id", "name"], "left_anti")
    return dead.select("table_id", F.lit("").alias("name"), F.lit("table").alias("kind")).unionByName(spare.select("table_id", "name", F.lit("column").alias("kind")))


def silent_files(files: DataFrame, nodes: DataFrame, warnings: DataFrame) -> DataFrame:
    """Files that gave neither a node nor a warning."""
    return files.join(nodes.select(F.col("source_file").alias("path")), "path", "left_anti").join(warnings.select(F.col("file").alias("path")), "path", "left_anti")


def catalog_gap(listed: DataFrame, edges: DataFrame) -> DataFrame:
    """Listed pairs (a, b) that no edge joins in either direction."""
    pair = lambda a, b: [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]
    have = edges.select(*pair("source_id", "target_id")).distinct()
    return listed.select("a", "b", *pair("a", "b")).join(have, ["x", "y"], "left_anti").select("a", "b").distinct()


def schema_votes(unresolved: DataFrame, objects: DataFrame) -> DataFrame:
    """(model, schema_name, votes): in how many unresolved names of a model each schema has an object."""
    j = unresolved.select("model", F.lower("name").alias("name")).distinct().join(objects.select("schema_name", F.lower("name").alias("name")).distinct(), "name")
    return j.groupBy("model", "schema_name").agg(F.count_distinct("name").alias("votes"))


def estate_groups(nodes: DataFrame) -> DataFrame:
    """Groups of the estate map with counters."""
    n = nodes.withColumn("group_id", group_id()).withColumn("lane", lane())
    return n.groupBy("group_id").agg(
        F.min("lane").alias("lane"),
        F.count_if(F.col("node_type").endswith("_table")).alias("n_tables"),
        F.count_if(F.col("node_type") == "view").alias("n_views"),
        F.count_if(F.col("node_type") == "stored_proc").alias("n_procs"),
        F.count_if(F.col("unresolved")).alias("n_warnings"),
    )


def group_id() -> Column:
    layer, schema = F.coalesce("layer", F.lit("none")), F.coalesce(F.nullif(F.col("schema_name"), F.lit("")), F.lit("dbo"))
    kind = F.col("node_type")
    return (
        F.when(kind == "report", F.concat(F.lit("report:"), "name"))
        .when(kind == "semantic_model", F.concat(F.lit("model:"), "name"))
        .when(kind.isin("measure", "pbi_table"), F.concat(F.lit("model:"), "schema_name"))
        .otherwise(F.concat(F.lit("sql:"), layer, F.lit(":"), schema))
    )


def lane() -> Column:
    kind, layer = F.col("node_type"), F.col("layer")
    return F.when(kind == "report", 4).when(kind.isin("semantic_model", "measure", "pbi_table"), 3).when(layer == "gold", 2).when(layer == "silver", 1).otherwise(0)


def estate_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_group, target_group, weight) in authored direction, without edges inside a group."""
    g = nodes.select("id", group_id().alias("g"))
    e = edges.join(g.select(F.col("id").alias("source_id"), F.col("g").alias("source_group")), "source_id").join(g.select(F.col("id").alias("target_id"), F.col("g").alias("target_group")), "target_id")
    return e.where("source_group <> target_group").groupBy("source_group", "target_group").agg(F.count("*").alias("weight"))


def estate_layout(groups: DataFrame) -> DataFrame:
    """Row of each group in its lane, sorted by title, and the offset that centres the lane."""
    by_title = Window.partitionBy("lane").orderBy(F.lower("group_id"), "group_id")
    sizes = groups.groupBy("lane").agg(F.count("*").alias("lane_size"))
    tallest = sizes.agg(F.max("lane_size")).scalar()
    out = groups.select("group_id", "lane", (F.row_number().over(by_title) - 1).alias("row")).join(sizes, "lane")
    return out.select("group_id", "lane", "row", ((tallest - F.col("lane_size")) / 2.0).alias("offset"))


def loaded_by(sources: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """(query, table_id, linked): tables whose sources name the queried object: in full, or by its last part where the
    query has no dot; linked if one of these sources is resolved."""
    full = sources.select("table_id", F.lower("qualified").alias("q"))
    bare = sources.select("table_id", F.lower(F.element_at(F.split("qualified", "\\."), -1)).alias("q"))
    n = names.select("query", F.lower("query").alias("q"))
    dotted = F.col("query").contains(".")
    hits = n.where(dotted).join(full, "q").unionByName(n.where(~dotted).join(bare, "q")).select("query", "table_id").distinct()
    return hits.join(links.select("table_id").distinct().withColumn("linked", F.lit(True)), "table_id", "left").select("query", "table_id", F.coalesce("linked", F.lit(False)).alias("linked"))


#: Hash values of pieces that queries mark.
HASHES = 65_536


def _grams(c: Column, size: Column) -> Column:
    """The distinct pieces of a text of a size, or none."""
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substr(c, i, size)))).otherwise(F.array())


def _holding(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id) of nodes (id, full) whose id or full name holds the query's text k, by an index of three characters.

    A query is looked up under the rarest of its pieces, so only nodes that hold this one are compared. Shorter queries are
    pieces themselves. Pieces of nodes are moved only if some query has one of the same hash value, of ``HASHES`` values.
    """
    size = F.least(F.length("k"), F.lit(3))
    looked = cut(queries.where("k <> ''").select("query", "k", F.explode(_grams(F.col("k"), size)).alias("gram")))
    sizes = [r[0] for r in looked.select(F.length("gram")).distinct().collect()]  # some of 1, 2, 3
    if not sizes:
        return looked.select("query", F.lit("").alias("id")).where("false")
    index = dealt(nodes.select("id", "full"), "id").select("id", "full", F.explode(F.array_distinct(F.concat(*[_grams(c, F.lit(s)) for s in sizes for c in (F.lower("id"), F.col("full"))]))).alias("gram"))
    bucket = F.pmod(F.xxhash64("gram"), F.lit(HASHES))
    marked = F.broadcast(looked.select(bucket.alias("b")).distinct())  # at most HASHES rows, however many queries there are
    index = cut(index.withColumn("b", bucket).join(marked, "b", "left_semi").drop("b"))
    often = index.join(looked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = looked.join(often, "gram", "left").groupBy("query", "k").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    hits = rarest.join(index, "gram").where(F.contains(F.lower("id"), F.col("k")) | F.contains("full", F.col("k")))
    return hits.select("query", "id")


def match_nodes(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id): lookup by exact id, else by exact name, else by substring; the first step with hits counts. An empty
    query has none."""
    n = nodes.select("id", F.lower("name").alias("n"), F.lower(F.concat_ws(".", "schema_name", "name")).alias("full"))
    q = queries.select("query", F.lower("query").alias("k"))
    by_id = q.join(n.select("id", F.lower("id").alias("k")), "k").select("query", "id", F.lit(1).alias("step"))
    by_name = q.join(n.select("id", F.explode(F.array_distinct(F.array("n", "full"))).alias("k")), "k").select("query", "id", F.lit(2).alias("step"))
    exact = by_id.unionByName(by_name)
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    inside = _holding(n, rest).select("query", "id", F.lit(3).alias("step"))
    every = exact.unionByName(inside)
    least = every.groupBy("query").agg(F.min("step").alias("step"))
    return every.join(least, ["query", "step"]).select("query", "id").distinct()


def diagnostics_json(warnings: DataFrame) -> DataFrame:
    """The diagnostics as JSON lines in order (ord, value): the counts by severity first, then one line for each finding."""
    w = diagnostics_rows(warnings)
    counts = severity_counts(warnings).groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"))
    head = counts.select(F.struct(F.lit(-1).alias("severity_rank"), F.lit("").alias("category"), F.lit("").alias("file"), F.lit("").alias("message")).alias("ord"), F.to_json(F.struct("severity_counts")).alias("value"))
    rows = w.select(F.struct("severity_rank", "category", "file", "message").alias("ord"), F.to_json(F.struct("category", "file", "message", "severity")).alias("value"))
    return head.unionByName(rows)


def findings_json(warnings: DataFrame) -> DataFrame:
    """One JSON line for each finding with the keys of the exchange format: rule, severity, message, file, line, object."""
    w = diagnostics_rows(warnings)
    return w.select(F.struct("severity_rank", "category", "file", "message").alias("ord"), F.to_json(F.struct(F.col("category").alias("rule"), "severity", "message", "file", F.lit(0).alias("line"), F.lit("").alias("object"))).alias("value"))


def diagnostics_markdown(warnings: DataFrame) -> DataFrame:
    """Lines (ord, value) of the diagnostics page: a table of counts, then a table of findings for each category."""
    from ..functions.names import md_cell

    rank = severity_rank(F.col("category"))
    blank = F.lit("")
    line = lambda rows, a, b, c, d, e, value: rows.select(F.struct(a.alias("part"), b.alias("rank"), c.alias("category"), d.alias("step"), e.alias("file"), F.col("__m").alias("message") if "__m" in rows.columns else blank.alias("message")).alias("ord"), value.alias("value"))
    w = warnings.select("file", F.col("message").alias("__m"), "category", rank.alias("r"), severity_of(F.col("category")).alias("severity"))
    counts, cats = w.groupBy("r", "severity").agg(F.count("*").alias("n")), w.groupBy("r", "severity", "category").agg(F.count("*").alias("n"))
    out = line(counts, F.lit(1), F.col("r"), blank, F.lit(0), blank, F.concat(F.lit("| "), "severity", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")))
    out = out.unionByName(line(cats, F.lit(2), F.col("r"), F.col("category"), F.lit(0), blank, F.concat(F.lit("### `"), "category", F.lit("` ("), F.col("n").cast("string"), F.lit(")"))))
    out = out.unionByName(line(w, F.lit(2), F.col("r"), F.col("category"), F.lit(1), F.col("file"), F.concat(F.lit("| "), md_cell(F.col("file")), F.lit(" | "), md_cell(F.col("__m")), F.lit(" |"))))
    return out
