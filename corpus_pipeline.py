"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, and piece encoding, in this order.

Each stage takes what its predecessor kept and only drops rows or changes the text; every other column goes through as it
came, whatever its name. Edge cases: a null text or one without letters has no language and goes at the first stage, so
later stages see texts with letters only; given such rows directly, the near-duplicate stage keeps them (they belong to
no class), as do the benchmark and secrets stages, and the last stage gives them no pieces. Rows without an id belong to
no class of near duplicates and stay; rows that repeat an id and a text stay or go together. Ties in a class go to the
smallest id. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontaminate, jaccard_join, language, pieces, secrets
from tributary.llm.common import cut, numbered, position


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier accepts."""
    labelled = language.labelled_part(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return language.accepted(docs, labelled)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near duplicates."""
    return jaccard_join.keep_first(docs, jaccard_join.near_duplicates(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars, where there is such a column, is counted anew."""
    if "n_chars" not in [c.lower() for c in docs.columns]:
        return secrets.redact(docs)
    by_place = numbered(secrets.redact(docs))
    text, n_chars = (position(docs, c) for c in ("text", "n_chars"))
    counted = F.length(by_place[f"__{text}"]).cast(docs.schema.fields[n_chars].dataType)
    return by_place.select(*[counted if i == n_chars else by_place[f"__{i}"] for i in range(len(docs.columns))]).toDF(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with what it has of id, language, source and length."""
    have = {c.lower() for c in docs.columns}
    return pieces.encode(docs, keep=[c for c in ("doc_id", "lang", "source", "n_chars") if c in have])


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secrets_stage),
    ("pieces", pieces_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared checkpoint folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else cut(docs)
    return docs
