"""Token counts from an exact length histogram.

Each document is encoded once and only its length leaves the task. Lengths are aggregated to a histogram (partial sums
before the shuffle), which is written to the shared checkpoint folder, since its sums read it twice; suffix sums over it
answer, for every context limit that is a length in the data: how many documents and tokens lie at or above it, how many
tokens remain if every document is truncated to it, and the share of documents that fit. Between two such lengths the truncated total is linear, so the rows answer every limit.

Suffix sums run in blocks of lengths: inside each block by a window over the block, and over the block totals (as many
rows as the longest document has blocks), so no task sorts all lengths.

Edge cases: null and empty texts have length 0. An empty table gives no rows. Special-token strings in a text are
ordinary text.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of a block of suffix sums.
BLOCK = 4096
_encodings: dict[str, object] = {}
#: Runs of blanks (Unicode White_Space) that are too long for the pattern's look-ahead.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10001,}")


def encoding(path: str):
    """The vocabulary at ``path``, read once by each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_ids(encoding, text: str) -> list[int]:
    """The ids of a text. A long run of blanks is encoded as the one piece that the pattern makes of it: all of it at the end
    of the text, else all but its last blank, which goes to what follows."""
    out, at = [], 0
    for m in LONG_BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def lengths(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, ranks: str = RANKS) -> DataFrame:
    """``n_tokens long`` of each text."""

    def per_batch(column: pa.Array) -> list[pa.Array]:
        known = encoding(ranks)
        return [pa.array([len(token_ids(known, t)) if t else 0 for t in column.to_pylist()], pa.int64())]

    return map_texts(df, text_col, df.columns if keep is None else keep, "n_tokens long", per_batch)


def histogram(counts: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """Rows (n_tokens, n_docs) of the distinct lengths."""
    return counts.groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def context_totals(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """A histogram's suffix sums: for each length as context limit, what lies at or above it and what truncation leaves."""
    h = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.expr(f"n_tokens div {block}"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("block_docs").over(all_rows).alias("all_docs"),
        F.sum("block_tokens").over(all_rows).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("tokens_after") + F.sum("tokens").over(inside)).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )
    longer, at = F.col("docs_from") - F.col("n_docs"), F.col("n_tokens")
    return h.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + at * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("share_fitting"),
        "all_docs",
        "all_tokens",
    )


def quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed."""
    want = totals.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return totals.join(F.broadcast(want), F.col("share_fitting") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return context_totals(cut(histogram(lengths(table(spark, sf_dir, "documents"), keep=[]))))
