"""Fixtures of the training-data operators: small texts with every awkward case, and plain Python helpers."""

import random
import re

LONG = 60_000


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def awkward(seed=1):
    """(doc_id, text): nulls, empty, blank, very long, repeated, tied, non-ASCII, control characters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéßü日") for _ in range(rng.randint(1, 7)))
    text = lambda n: rng.choice([" ", "  ", "\n", ", "]).join(word() for _ in range(n))
    base = text(300)
    near = base.split(" ") if " " in base else [base]
    return [
        (0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "one two three four"), (5, base), (6, base), (7, base + " tail"), (8, " ".join(near[:-1])),
        (9, "z" * LONG), (10, "ab " * 5000), (11, text(2000)), (12, "\x00\x01 null \x00 bytes"), (13, "𝄞 emoji 🙂 text"), (14, "one two three four"), (15, text(40)),
    ]


def frame(spark, rows, schema="doc_id bigint, text string"):
    """Rows as a DataFrame with further columns whose names clash with results and internals."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    clash = ["score", "labels", "id", "key", "rank", "n_words", "spans", "lang_pred", "path", "k1", "hash", "n_tokens", "ids", "kept", "start"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash if c not in df.columns])
