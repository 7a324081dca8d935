"""The corpus pipeline, stage by stage and whole, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import brute_classes
from test_documents import brute_hits, brute_language
from texts import words_of

import corpus_pipeline as cp
from tributary.llm import language, pieces, secrets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """Documents with further columns that clash with results, also in case only."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in ("score", "Rejected", "lang_pred", "items", "contaminated", "class_id", "TOKENS", "n_links", "spans")])


def rows_of(spark):
    """Some of the given texts, and awkward ones."""
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()[0]
    rows = [(r.doc_id, r.text) for r in some]
    return rows + [(9000, None), (9001, ""), (9002, "12 34"), (None, rows[0][1]), (9003, rows[1][1]), (9003, rows[1][1]), (9004, f"Here: {bench.text} end"), (9005, "the word and password=hunter2hunter2 here"), (9006, "z" * 100_000)]


def spark_free(spark, rows):
    """What each stage keeps, as lists of (doc_id, text)."""
    out = [rows]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(language.labelled_part(docs))
    labels = [brute_language(model.content, t) for _, t in rows]
    out.append([r for r, (label, score) in zip(rows, labels, strict=True) if label != "und" and score > model.narrow])
    known = [r for r in out[-1] if r[0] is not None]
    texts = {}
    for i, t in known:
        texts.setdefault((i, t), []).append((i, t))
    classes = {i: c for i, c, _ in brute_classes(list(texts))}
    out.append([r for r in out[-1] if r[0] is None or classes[r[0]] == r[0]])
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {" ".join(words_of(t)[a : a + 10]) for _, t in items for a in range(max(1, len(words_of(t)) - 9)) if words_of(t)}
    assert all(len(words_of(t)) >= 10 for _, t in items)
    hit = lambda t: any(" ".join(w[k : k + 10]) in found for w in [words_of(t)] for k in range(len(w) - 9))
    small = [t for _, t in out[-1] if t is not None and len(t) < 3000][:5]
    assert [hit(t) for t in small] == [h > 0 for _, h, _ in brute_hits(items, small, 10)]
    out.append([r for r in out[-1] if not hit(r[1])])
    out.append([(i, secrets.redacted(t)) for i, t in out[-1]])
    t = pieces.Transducer(pieces.read_pieces())
    out.append([(i, np.frombuffer(t.encode(x), "<i4").tolist()) for i, x in out[-1]])
    return out


def key(r):
    return (r[0] is None, r[0] or 0, str(r[1]))


def test_each_stage_and_the_whole(spark, tmp_path):
    rows = rows_of(spark)
    want = spark_free(spark, rows)
    docs = documents(spark, rows)
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        if k < len(cp.STAGES) - 1:
            assert docs.columns == documents(spark, rows[:1]).columns, name
            assert all(r[c] == f"own {c}" for r in got for c in docs.columns[5:]), name
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got), name
            assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want[k + 1], key=key), name
        else:
            assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want[k + 1], key=key)


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_stages_of_odd_rows_alone(spark, k):
    name, stage = cp.STAGES[k]
    empty = documents(spark, [(1, "x")]).where("false")
    assert stage(spark, empty, SF).count() == 0
    odd = documents(spark, [(1, None), (2, ""), (3, "  \n"), (None, None), (4, "one"), (4, "one")])
    got = sorted((r.doc_id or 0) for r in stage(spark, odd, SF).collect())
    assert got == ([4, 4] if name == "language" else [0, 1, 2, 3, 4, 4]) or (name == "language" and got == [])


def test_the_run_is_its_stages(spark):
    got = cp.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = spark_free(spark, [(r.doc_id, r.text) for r in docs])[-1]
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=key) == sorted(want, key=key)
    assert cp.ORACLE_SQL is None
