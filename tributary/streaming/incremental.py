"""Incremental extraction: contributions remembered by content, new files extracted once, batches and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import cache_key
from ..sources.sinks import publish

VERSION = "1"


def keyed(files: DataFrame, step: str, dialect: str = "tsql") -> DataFrame:
    """Files (repo_key, path, text) with the key that their contribution is remembered by."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return files.withColumn("cache_key", cache_key(VERSION, dialect, step, F.col("repo_key"), F.col("path"), sha))


def _remembered(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(store) if fs.exists(path) and any(s.getPath().getName().startswith("part-") for s in fs.listStatus(path)) else None


def extract_new(files: DataFrame, step: str, extract: Callable[[DataFrame], DataFrame], store: str) -> DataFrame:
    """Contributions of all files: those under a known key are replayed, the rest extracted and appended to ``store``.

    ``extract`` gets files with ``cache_key`` and must carry it through. Files that contribute nothing are remembered by
    their key in ``store``/../keys, so they are not extracted again.
    """
    spark = files.sparkSession
    now = keyed(files, step)
    keys_path = store.rstrip("/") + "_keys"
    seen = _remembered(spark, keys_path)
    fresh = now if seen is None else now.join(seen.select("cache_key").distinct(), "cache_key", "left_anti")
    extract(fresh).write.mode("append").parquet(store)
    fresh.select("cache_key").write.mode("append").parquet(keys_path)  # last: a run that fails before extracts again
    return spark.read.parquet(store).join(now.select("cache_key").distinct(), "cache_key", "left_semi").distinct()


def forget_removed(files: DataFrame, step: str, store: str) -> None:
    """Rewrites the store without the contributions of files that are gone or changed.

    The keys are rewritten first: a run that fails in between knows fewer keys than contributions and extracts again. Each
    folder is written beside the old one and then takes its place.
    """
    spark = files.sparkSession
    present = keyed(files, step).select("cache_key").distinct()
    for path in (store.rstrip("/") + "_keys", store.rstrip("/")):
        held = _remembered(spark, path)
        if held is not None:
            publish(lambda beside, kept=held.join(present, "cache_key", "left_semi"): kept.write.mode("overwrite").parquet(beside), path, spark, False)


def memo_counts(files: DataFrame, step: str, store: str) -> DataFrame:
    """(hits, misses): how many of the files the store knows under their key, and how many it would extract."""
    now = keyed(files, step).select("cache_key")
    seen = _remembered(files.sparkSession, store.rstrip("/") + "_keys")
    known = now.select("cache_key").where("false") if seen is None else seen.select("cache_key").distinct()
    hit = now.join(known.withColumn("__hit", F.lit(True)), "cache_key", "left")
    return hit.agg(F.count_if(F.col("__hit").isNotNull()).alias("hits"), F.count_if(F.col("__hit").isNull()).alias("misses"))


def stream(files: DataFrame, step: str, extract: Callable[[DataFrame], DataFrame], store: str, checkpoint: str):
    """The same over a streaming DataFrame of files, one micro-batch at a time; returns the started query."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: extract_new(batch, step, extract, store).limit(0).count()).trigger(availableNow=True).start()
