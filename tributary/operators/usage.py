"""What reports and formulas use of a model's tables and columns, with the kind of evidence, and what nothing uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_identifier
from ..plans.session import cut
from ..sources.models import dax_refs, dax_tables
from .closure import closure
from .pages import measure_links

_FOUND = "table_id", "name", "evidence"


def evidence(tables: DataFrame, formulas: DataFrame, shown: DataFrame, relationships: DataFrame, references: DataFrame) -> DataFrame:
    """(table_id, name, evidence): why a table (name '') or a column of it counts as used, each kind once.

    ``tables`` (table_id, model, table_name); ``formulas`` (model, expression, own_table, kind) of measures, calculated tables
    and calculated columns, own_table being the home of a measure or the table of a column; ``shown`` (target, property, kind)
    of reports; ``relationships`` (model, from_table, from_column, to_table, to_column); ``references`` (target_id). Kinds:
    report_table, report_column; formula_table, formula_column for names with their table; formula_name for bare names, which
    may be columns of any table of the model; calculated_column for bare names in a column of the table itself; home_table;
    reference; key for the ends of relationships, which only keep a column off the list.
    """
    t = cut(tables.select("table_id", "model", F.lower("table_name").alias("t")).distinct())
    found = lambda df, kind, name=F.lit(""): df.select("table_id", name.alias("name"), F.lit(kind).alias("evidence"))
    low = normalize_identifier(F.col("name"))
    f = cut(formulas.select("model", "expression", "own_table", "kind").distinct())
    refs = cut(dax_refs(f).select("model", F.lower("table_name").alias("t"), "name", "own_table", "kind"))
    of_report = shown.select(F.col("target").alias("table_id"), normalize_identifier(F.col("property")).alias("name"), "kind").join(t.select("table_id"), "table_id", "left_semi")
    out = found(of_report, "report_table").unionByName(found(of_report.where("kind in ('column', 'unknown')"), "report_column", F.col("name")))
    out = out.unionByName(found(dax_tables(f.select("model", "expression"), tables).select("model", F.lower("table_name").alias("t")).join(t, ["model", "t"]), "formula_table"))
    out = out.unionByName(found(refs.where("t <> ''").join(t, ["model", "t"]), "formula_column", low))
    bare = refs.where("t = ''")
    out = out.unionByName(found(bare.select("model", "name").distinct().join(t, "model"), "formula_name", low))
    home = lambda df: df.withColumn("t", F.lower("own_table")).join(t, ["model", "t"])
    out = out.unionByName(found(home(bare.where("kind = 'calculated_column'").drop("t")), "calculated_column", low))
    out = out.unionByName(found(home(f.where("kind = 'measure'").select("model", "own_table")), "home_table"))
    ends = relationships.select("model", F.explode(F.array(F.struct(F.lower("from_table").alias("t"), F.col("from_column").alias("name")), F.struct(F.lower("to_table").alias("t"), F.col("to_column").alias("name")))).alias("e")).select("model", "e.*")
    out = out.unionByName(found(ends.join(t, ["model", "t"]), "key", low))
    out = out.unionByName(found(references.select(F.col("target_id").alias("table_id")).join(t.select("table_id"), "table_id", "left_semi"), "reference"))
    return out.distinct()


def unused(tables: DataFrame, columns: DataFrame, found: DataFrame) -> DataFrame:
    """(table_id, name, kind, hidden): tables without evidence of their own or of a column, and of the others the columns
    without any; ``columns`` (table_id, name, hidden), ``found`` as ``evidence`` gives it."""
    cols = columns.select("table_id", "name", "hidden", normalize_identifier(F.col("name")).alias("__n"))
    named = found.where("name <> ''").select("table_id", F.col("name").alias("__n"), "evidence")
    live = named.where("evidence <> 'key'").select("table_id", "__n").distinct()
    alive = cols.join(live, ["table_id", "__n"], "left_semi").select("table_id").unionByName(found.where("name = ''").select("table_id")).distinct()
    dead = tables.select("table_id").distinct().join(alive, "table_id", "left_anti")
    spare = cols.join(alive, "table_id", "left_semi").join(named.select("table_id", "__n").distinct(), ["table_id", "__n"], "left_anti")
    return dead.select("table_id", F.lit("").alias("name"), F.lit("table").alias("kind"), F.lit(False).alias("hidden")).unionByName(spare.select("table_id", "name", F.lit("column").alias("kind"), F.coalesce("hidden", F.lit(False)).alias("hidden")))


def reached(shown: DataFrame, formulas: DataFrame, measures: DataFrame, columns: DataFrame) -> DataFrame:
    """(id): everything that what reports show stands on, through formulas, to the base columns.

    ``formulas`` (id, model, expression) belong to measures (id, model, table_name, name) or to columns (id, model, table_name,
    name); ``shown`` (id) are the measures and columns of visuals. References become steps once, then a frontier moves from
    the shown ones along them until nothing is new (one root for all, so a field is met once, not once for each visual).
    """
    refs = cut(dax_refs(formulas.select(F.col("id").alias("source_id"), "model", "expression")).select("source_id", "model", "table_name", "name"))
    key = lambda df: df.select("model", F.lower("table_name").alias("t"), F.lower("name").alias("n"), F.col("id").alias("target_id"))
    to_columns = refs.where("table_name <> ''").select("source_id", "model", F.lower("table_name").alias("t"), F.lower("name").alias("n")).join(key(columns), ["model", "t", "n"]).select("source_id", "target_id")
    steps = measure_links(refs, measures, columns).unionByName(to_columns)
    begin = shown.select(F.lit("").alias("up"), F.col("id").alias("down"))
    flow = begin.unionByName(steps.select(F.col("source_id").alias("up"), F.col("target_id").alias("down")))
    root = shown.sparkSession.createDataFrame([("",)], "root string")
    return closure(flow, root).select(F.col("node").alias("id")).distinct()
