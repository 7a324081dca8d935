"""From files to the lineage graph: extract, merge, link, fold, all as DataFrames.

What grows with the files is joined by sorting: where a plan adapts, a side counts as small by its packed bytes, and many such
sides of one plan, each unpacked in a table of the driver's memory, are more than that holds.

Input tables: ``scripts`` (repo_key, path, text) of SQL; of models ``tables`` (table_id, model, table_name), ``partitions``
(table_id, model, name, type, expression) and ``measures`` (id, model, table_name, name, expression); of reports ``shown``
(source_id, report, visual, entity, property, kind, role), ``filters`` (source_id, report, entity, property, kind, scope)
and ``declared`` (report, model). The result has ``nodes`` (id, node_type, name, schema_name, source_file), ``edges``
(source_id, target_id, edge_type, evidence), ``field_refs``, ``unresolved`` and ``warnings``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import make_id
from ..operators import graph, linking, pages, partitions, quality, reports, statements
from ..sources.models import dax_refs
from .session import cut, written

class Links(NamedTuple):
    """How sources of models find their SQL objects beyond exact names: schemas that a model maps to (model, schema_name,
    pos), people's decisions (key, target, signature), and whether similar names are tried."""

    mappings: DataFrame | None = None
    decisions: DataFrame | None = None
    similar: bool = False


_NODE = ["id", "node_type", "name", "schema_name", "source_file"]


class Parts(Mapping):
    """Tables of a graph by name; each is made when it is asked for, with the steps that it shares with others made once."""

    def __init__(self, **made: Callable[[], DataFrame]):
        self._made = {k: cache(f) for k, f in made.items()}

    def __getitem__(self, key: str) -> DataFrame:
        return self._made[key]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


def sql_graph(scripts: DataFrame) -> Parts:
    """Nodes and edges of SQL scripts: what they define, and what each defined object reads, writes and calls (see
    ``statements.owners``).

    Objects that are only named get a table without a file; such a table of a view's name is that view.
    """
    stmts = cache(lambda: cut(statements.statements(scripts)))
    made = cache(lambda: cut(statements.definitions(stmts()).withColumn("id", make_id(F.col("node_type"), F.col("schema_name"), F.col("name")))))
    lineage = cache(lambda: cut(statements.owners(made(), statements.statement_lineage(stmts())).withColumn("id", make_id(F.lit("gold_table"), F.col("schema_name"), F.col("name")))))
    every = cache(lambda: cut(_sql_nodes(made(), lineage())))
    renamed = cache(lambda: graph.stub_redirects(every()))
    return Parts(
        nodes=lambda: every().join(renamed().select(F.col("old").alias("id")).hint("merge"), "id", "left_anti").select(*_NODE),
        edges=lambda: _sql_edges(made(), lineage(), stmts(), renamed()),
        warnings=lambda: statements.dynamic_sql(stmts()).unionByName(statements.star_views(stmts())),
    )


def _sql_nodes(made: DataFrame, lineage: DataFrame) -> DataFrame:
    own = made.select("id", "node_type", "name", "schema_name", F.col("path").alias("source_file"), F.lit(0).alias("ord"))
    named = lineage.select("id", F.lit("gold_table").alias("node_type"), "name", "schema_name", F.lit("").alias("source_file"), F.lit(1).alias("ord"))
    return own.unionByName(named).groupBy("id").agg(*[F.min_by(c, F.struct("ord", "source_file")).alias(c) for c in _NODE[1:]])


def _sql_edges(made: DataFrame, lineage: DataFrame, stmts: DataFrame, renamed: DataFrame) -> DataFrame:
    calls = statements.owners(made, statements.callees(stmts)).where("owner_type = 'stored_proc'").select("owner", make_id(F.lit("stored_proc"), F.col("schema_name"), F.col("name")).alias("target_id"), "path")
    # only what has a body writes; a view or table is made of what it reads
    flow = lineage.where("owner <> id and (direction = 'reads' or owner_type = 'stored_proc')").select(F.col("owner").alias("source_id"), F.col("id").alias("target_id"), F.col("direction").alias("edge_type"), F.col("path").alias("evidence"))
    edges = flow.unionByName(calls.select(F.col("owner").alias("source_id"), "target_id", F.lit("references").alias("edge_type"), F.col("path").alias("evidence")))
    return graph.rename_ends(graph.edge_dedup(edges.withColumn("ord", F.col("evidence"))).withColumn("ord", F.col("evidence")), renamed.hint("merge")).select("source_id", "target_id", "edge_type", "evidence")


def model_graph(tables: DataFrame, parts: DataFrame, measures: DataFrame, sql_nodes: Callable[[], DataFrame], columns: DataFrame | None = None, links: Links | None = None) -> Parts:
    """Nodes and edges of semantic models: tables and measures feed their model, partitions are fed by the SQL objects of
    exactly their names or by other models, formulas reference measures and tables. Names in formulas are compared without
    case; ``sql_nodes`` gives the nodes that sources are linked to; ``columns`` (model, table_name, name) tells which qualified names are columns, which win over measures. ``links`` (key, target, method) tells the rung of each source."""
    models = tables.select("model").distinct()
    model_id = lambda c: F.concat(F.lit("semantic_model:"), F.lower(c))
    nodes = models.select(model_id("model").alias("id"), F.lit("semantic_model").alias("node_type"), F.col("model").alias("name"), F.lit("").alias("schema_name"))
    nodes = nodes.unionByName(tables.select(F.col("table_id").alias("id"), F.lit("pbi_table").alias("node_type"), F.col("table_name").alias("name"), F.col("model").alias("schema_name")))
    nodes = nodes.unionByName(measures.select("id", F.lit("measure").alias("node_type"), "name", F.col("model").alias("schema_name"))).withColumn("source_file", F.col("schema_name"))
    links = links or Links()
    found = cache(lambda: partitions.attach(parts))
    linked = cache(lambda: cut(link(found()["sources"], tables, sql_nodes(), links)))
    composite = cache(lambda: pages.composite_links(found()["models"], models))
    edge = lambda df, a, b, kind, why: df.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("edge_type"), why.alias("evidence"))

    def edges() -> DataFrame:
        refs = cut(dax_refs(measures.select(F.col("id").alias("source_id"), "model", "expression")).select("source_id", "model", "table_name", "name"))
        known = tables.select("model", "table_name", F.lit("").alias("name")).where("false") if columns is None else columns
        between = pages.measure_links(refs, measures.select("id", "model", "table_name", "name"), known)
        of_table = tables.select("model", F.lower("table_name").alias("__t"), F.col("table_id").alias("target_id"))
        named = refs.where("table_name <> ''").withColumn("__t", F.lower("table_name")).join(of_table.hint("merge"), ["model", "__t"]).select("source_id", "target_id").distinct()
        out = edge(tables.withColumn("m", model_id("model")), "table_id", "m", "feeds", F.col("model"))
        out = out.unionByName(edge(measures.withColumn("m", model_id("model")), "id", "m", "feeds", F.col("model")))
        out = out.unionByName(edge(linked().where("target is not null"), "target", "table_id", "feeds", F.concat_ws(".", "schema_name", "name")))
        out = out.unionByName(edge(composite()[0].withColumn("m", model_id("upstream")), "m", "table_id", "feeds", F.col("upstream")))
        for found_links in (partitions.calculated_links(parts, tables, measures), between, named):
            out = out.unionByName(edge(found_links, "source_id", "target_id", "references", F.lit("formula")))
        return out.distinct()

    def warnings() -> DataFrame:
        out = found()["warnings"]
        if links.similar:  # no other rung gives a link that has to be told
            fuzzy = linked().where("method = 'fuzzy'")
            out = out.unionByName(fuzzy.select(F.col("table_id").alias("file"), F.concat(F.lit("linked by similar name: "), "target").alias("message"), F.lit("fuzzy_auto").alias("category")))
        if links.decisions is not None:
            out = out.unionByName(linking.decision_warnings(linked().select("key", "signature"), links.decisions))
        return out

    def unresolved() -> DataFrame:
        named = linked().where(F.col("method").isin("unresolved", "pending", "review")).select("key", "table_id")
        return named.unionByName(composite()[1].select(F.concat_ws("#", "table_id", "upstream").alias("key"), "table_id"))

    return Parts(nodes=lambda: nodes.select(*_NODE), edges=edges, links=lambda: linked().select("key", "target", "method"), unresolved=unresolved, warnings=warnings)


def link(sources: DataFrame, tables: DataFrame, sql_nodes: DataFrame, links: Links) -> DataFrame:
    """(key, table_id, schema_name, name, signature, target, method): each source of a model table on the ladder's rungs.

    A table's only source goes by the table's id, several by id and name; the signature is that of the source's definitions.
    """
    named = sources.select("table_id", "schema_name", "name", F.concat_ws(".", F.nullif("schema_name", F.lit("")), "name").alias("qualified"), F.concat_ws("|", "raw_kind", "expression_hash").alias("definition"))
    signed = linking.source_signatures(named)
    many = named.select("table_id", "qualified").distinct().groupBy("table_id").agg(F.count("*").alias("n"))
    items = named.drop("definition").distinct().join(signed.hint("merge"), ["table_id", "qualified"]).join(many.hint("merge"), "table_id").join(tables.select("table_id", "model").distinct().hint("merge"), "table_id", "left")
    items = cut(items.withColumn("key", F.when(F.col("n") == 1, F.col("table_id")).otherwise(F.concat_ws("#", "table_id", "qualified"))))
    spark = items.sparkSession
    exact = cut(linking.exact_match(items, sql_nodes))
    rule = linking.config_rule_match(items.select("key", "model", "name"), sql_nodes, links.mappings) if links.mappings is not None else exact.where("false")
    rule = cut(rule)
    decided = links.decisions if links.decisions is not None else spark.createDataFrame([], "key string, target string, signature string")
    fuzzy = None
    if links.similar:
        left = items.join(exact.hint("merge"), "key", "left_anti").join(rule.hint("merge"), "key", "left_anti").join(decided.select("key").hint("merge"), "key", "left_anti")
        known = sql_nodes.where(F.col("node_type").isin(linking.PRECEDENCE)).select(F.col("id").alias("target"), F.regexp_replace("id", "^[^:]*:", "").alias("qualified"))
        fuzzy = linking.best_and_runner_up(linking.best_candidates(left.select("key", F.col("qualified").alias("needle")), known, 2))
    return items.join(linking.ladder(items.select("key", "signature"), decided, exact, rule, fuzzy).hint("merge"), "key").select("key", "table_id", "schema_name", "name", "signature", "target", "method")


def report_graph(shown: DataFrame, filters: DataFrame, declared: DataFrame, tables: DataFrame, measures: DataFrame) -> Parts:
    """Nodes and edges of reports, visuals and pages folded into them: what a report shows and filters on, and its models."""
    entities = cache(lambda: written(tables.select(F.col("table_name").alias("entity"), "table_id", "model")))
    named = cache(lambda: written(measures.select("model", "name", F.col("id").alias("measure_id"))))
    of_models = lambda refs: refs.join(entities().select(F.col("table_id").alias("target"), "model").hint("merge"), "target").select("report", "model").distinct()
    # visuals are folded into their report, so their ids need not travel
    seen = cache(lambda: reports.shown_fields(shown.drop("source_id", "visual"), entities(), named(), declared))
    drawn = cache(lambda: cut(seen()[2].unionByName(declared.select("report", "model")).distinct()))
    filtered = cache(lambda: reports.filter_fields(filters, entities(), named(), drawn()))
    every = cache(lambda: seen()[0].unionByName(filtered()[0].drop("source_id")))
    folded = cache(lambda: reports.fold(every(), seen()[1]))

    def edges() -> DataFrame:
        refs = written(every())
        feeds = of_models(refs).select(F.concat(F.lit("semantic_model:"), F.lower("model")).alias("source_id"), F.concat(F.lit("report:"), F.lower("report")).alias("target_id"), F.lit("feeds").alias("edge_type"), F.lit("report draws from this model").alias("evidence"))
        return reports.fold(refs, seen()[1])[0].unionByName(feeds)

    names = shown.select("report").unionByName(filters.select("report")).distinct()
    nodes = names.select(F.concat(F.lit("report:"), F.lower("report")).alias("id"), F.lit("report").alias("node_type"), F.col("report").alias("name"), F.lit("").alias("schema_name"), F.lit("").alias("source_file"))
    return Parts(nodes=lambda: nodes, edges=edges, field_refs=lambda: folded()[1], unresolved_bindings=lambda: folded()[2], warnings=lambda: filtered()[1])


def build(scripts: DataFrame, tables: DataFrame, parts: DataFrame, measures: DataFrame, shown: DataFrame, filters: DataFrame, declared: DataFrame, columns: DataFrame | None = None, links: Links | None = None) -> Parts:
    """The whole graph of all sources; what nobody asks for is not made. Where several rows share an id, the least (name, file) stays."""
    sql = sql_graph(scripts)
    model = model_graph(tables, parts, measures, lambda: sql["nodes"], columns, links)
    report = report_graph(shown, filters, declared, tables, measures)
    union = lambda key: sql[key].unionByName(model[key]).unionByName(report[key])
    return Parts(
        nodes=lambda: union("nodes").groupBy("id").agg(F.min(F.struct("name", "source_file", "node_type", "schema_name")).alias("n")).select("id", *[f"n.{c}" for c in _NODE[1:]]),
        edges=lambda: graph.edge_dedup(union("edges").withColumn("ord", F.col("evidence"))),
        warnings=lambda: quality.diagnostics_rows(union("warnings")),
        **{k: lambda k=k: report[k] for k in ("field_refs", "unresolved_bindings")},
        **{k: lambda k=k: model[k] for k in ("links", "unresolved")},
    )
