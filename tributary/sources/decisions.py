"""The store of link decisions: a JSON file of version 1, and its rows.

Reading is tolerant: what cannot be used gives a warning and no rows. Writing replaces the file as a whole, in order of keys,
and leaves the old one where it fails. The file holds what people answered, one entry for each linked source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_ENTRY = "struct<target: string, method: string, source_signature: string>"
_ROWS = "key string, target string, method string, signature string"
_WARNING = "file string, message string, category string"


def read_decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, warnings): rows (key, target, method, signature); a missing file has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    settle(spark, path)
    none = spark.createDataFrame([], _ROWS)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return none, spark.createDataFrame([], _WARNING)
    doc = spark.read.text(path, wholetext=True).select("value", F.try_parse_json("value").alias("v"))
    kind = lambda at: F.schema_of_variant(F.try_variant_get("v", at, "variant"))
    version = F.try_variant_get("v", "$.version", "int")
    is_map = F.coalesce(kind("$.mappings").startswith("OBJECT"), F.try_variant_get("v", "$.mappings", "variant").isNull())
    problem = (
        F.when(F.col("v").isNull(), "not readable as JSON")
        .when(~kind("$").startswith("OBJECT"), "not a JSON object")
        .when(~version.eqNullSafe(F.lit(VERSION)), "unknown version")
        .when(~is_map, "mappings is not a JSON object")
    )
    doc = doc.select("value", problem.alias("problem"))
    entries = doc.where("problem is null").select(F.explode(F.from_json(F.get_json_object("value", "$.mappings"), "map<string, string>")).alias("key", "raw"))
    entries = entries.select("key", F.from_json("raw", _ENTRY).alias("e"), F.get_json_object("raw", "$.method").isNotNull().alias("good"))
    rows = entries.where("good and e is not null").select("key", "e.target", "e.method", F.col("e.source_signature").alias("signature"))
    file, category = F.lit(path), F.lit("cache_invalid")
    bad = doc.where("problem is not null").select(file.alias("file"), "problem", category.alias("category")).toDF("file", "message", "category")
    dropped = entries.where("not good or e is null").select(file.alias("file"), F.concat(F.lit("invalid entry "), "key").alias("message"), category.alias("category"))
    return rows, bad.unionByName(dropped)


def merged_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old decisions with new ones in the place of those of the same key."""
    cols = ["key", "target", "method", "signature"]
    return old.join(new.select("key"), "key", "left_anti").select(*cols).unionByName(new.select(*cols))


def write_decisions(decisions: DataFrame, path: str) -> bool:
    """Writes the decisions in order of keys, as one file beside the old one, and puts it in its place; False if that fails.

    The entries are joined by an aggregate of their JSON, so they must fit into one text (people's answers do).
    """
    spark = decisions.sparkSession
    entry = F.concat(F.to_json(F.struct("key")), F.lit("\x00"), F.to_json(F.struct("method", F.col("signature").alias("source_signature"), "target"), {"ignoreNullFields": "true"}))
    named = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat(F.lit("    "), F.regexp_extract(x, r'^\{"key":(.*)\}\x00', 1), F.lit(": "), F.element_at(F.split(x, "\x00"), -1)))
    # a null target means "outside": it must be written
    external = F.transform(named, lambda x: F.when(F.contains(x, F.lit('"target":')), x).otherwise(F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit(',"target":null}'))))
    text = decisions.groupBy().agg(F.concat(F.lit(f'{{\n  "version": {VERSION},\n  "mappings": {{\n'), F.array_join(external, ",\n"), F.lit("\n  }\n}\n")).alias("value"))
    return put_text(spark, text.collect()[0].value, path)


def put_text(spark: SparkSession, text: str, path: str) -> bool:
    """Writes a text through the file system of its path: beside the old file first; then the old file is put aside and the
    new one in its place, so that at each moment one of them is whole. ``settle`` mends what a crash in between leaves."""
    jvm = spark._jvm
    target, beside, aside = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    try:
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        settle(spark, path)
        out = fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(target) and not fs.rename(target, aside):
            return False
        if not fs.rename(beside, target):
            fs.rename(aside, target)
            return False
        fs.delete(aside, False)
        return True
    except Exception:  # locked, read-only: the caller keeps the answers and may try again
        return False


def settle(spark: SparkSession, path: str) -> None:
    """Puts a file that a crash left aside back in its place, or removes it where the new one has taken the place."""
    target, aside = (spark._jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, False)
        else:
            fs.rename(aside, target)
