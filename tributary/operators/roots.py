"""Which model or report a file belongs to: the nearest folder above it that is a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """Every folder that holds a path, the repository itself ('') first; folders by their whole path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def nearest(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (repo_key, path, …) with the ``root`` and ``owner`` of the longest root (repo_key, root, owner) above them.

    Only folders travel: each folder of files once, its own folders above it exploded and joined with the roots, so nested roots
    need no order and no pattern. Nothing is broadcast, whatever size the planner expects: texts and paths that are made of
    small columns are far longer than it can know. Files outside of all roots are left out.
    """
    held = files.select("repo_key", folder(F.col("path")).alias("__folder")).distinct()
    above = held.select("repo_key", "__folder", F.explode(ancestors(F.concat("__folder", F.lit("/")))).alias("root"))
    met = above.join(roots.select("repo_key", "root", "owner").distinct().hint("shuffle_hash"), ["repo_key", "root"])
    best = met.groupBy("repo_key", "__folder").agg(F.max_by(F.struct("root", "owner"), F.struct(F.length("root"), "owner")).alias("r"))
    at = files.withColumn("__folder", folder(F.col("path"))).join(best.select("repo_key", "__folder", "r.root", "r.owner").hint("merge"), ["repo_key", "__folder"])
    return at.select(*files.columns, "root", "owner")


def _named(root: Column, suffix: str, other: Column) -> Column:
    """The name of a root: its folder's without the suffix; at the top of a repository another name."""
    return F.when(root == "", other).otherwise(F.regexp_replace(last_part(root), rf"(?i)\.{suffix}$", ""))


def _marked(files: DataFrame, suffix: str) -> DataFrame:
    """Folders on the way to a file whose names end in the suffix."""
    above = files.select("repo_key", F.explode(ancestors(F.col("path"))).alias("root")).distinct()
    return above.where(F.lower("root").endswith(f".{suffix}"))


def model_roots(files: DataFrame) -> DataFrame:
    """(repo_key, root, owner) of the models of TMDL files: folders named .SemanticModel or .Dataset, and what holds the
    folder ``definition`` or, without one, the file model.tmdl."""
    tmdl = files.where("kind = 'tmdl'")
    marked = _marked(tmdl, "semanticmodel").unionByName(_marked(tmdl, "dataset"))
    held = tmdl.select("repo_key", F.regexp_extract("path", r"^(.*?)/?definition/", 1).alias("root")).where(F.col("path").rlike("(^|/)definition/"))
    own = tmdl.where(F.lower(last_part(F.col("path"))) == "model.tmdl").select("repo_key", folder(F.col("path")).alias("root")).where(last_part(F.col("root")) != "definition")
    roots = marked.unionByName(held).unionByName(own).distinct()
    return roots.select("repo_key", "root", _named(_named(F.col("root"), "semanticmodel", F.col("repo_key")), "dataset", F.col("repo_key")).alias("owner"))


def report_roots(files: DataFrame) -> DataFrame:
    """(repo_key, root, owner) of reports: folders named .Report, what holds a definition.pbir, a folder ``definition`` with
    pages or a report, or a report.json of the older kind."""
    f = files.where(F.col("kind").isin("pbir_definition", "pbir_visual", "pbir_page", "pbir_report", "report_json_legacy"))
    held = f.where(F.col("path").rlike("(^|/)definition/")).select("repo_key", F.regexp_extract("path", r"^(.*?)/?definition/", 1).alias("root"))
    own = f.where(F.col("kind").isin("pbir_definition", "report_json_legacy")).select("repo_key", folder(F.col("path")).alias("root"))
    roots = _marked(f, "report").unionByName(held).unionByName(own).distinct()
    return roots.select("repo_key", "root", _named(F.col("root"), "report", F.col("repo_key")).alias("owner"))
