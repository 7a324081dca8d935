"""The quality classifier: measures against plain Python, scores against table look-ups, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from texts import awkward, frame, words_of
from tributary.llm import quality


def plain_measures(text):
    text = text or ""
    raw, words = text.encode(), words_of(text)
    count = lambda good: sum(map(good, text))
    lines = [x for x in raw.split(b"\n") if x]
    pairs = list(zip(words, words[1:]))
    stops, w, c = ".,;:'\"()-", max(1, len(words)), max(1, len(text))
    behind, at, low = 0, 0, raw.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    for x in words:
        at = low.index(x.encode(), at) + len(x.encode())
        behind += raw[at : at + 1] in (b"!", b",", b".", b":", b";", b"?")
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(len(x.encode()) for x in words) / w, sum(len(x.encode()) <= 3 for x in words) / w, sum(len(x.encode()) >= 12 for x in words) / w,
        count(lambda x: "A" <= x <= "Z") / c, count(lambda x: "0" <= x <= "9") / c, count(lambda x: 33 <= ord(x) < 127 and not (x.isalnum() or x in stops + "!?")) / c,
        count(lambda x: x in stops) / w, count(lambda x: x in "!?") / w, (len(raw) - len(text)) / c, count(lambda x: (ord(x) < 32 or ord(x) == 127) and x not in "\t\n\r") / c,
        len(lines) / w, behind / w, sum(a == b for a, b in pairs) / w, len(set(words)) / w, len(set(pairs)) / max(1, len(pairs)),
        len(set(lines)) / max(1, len(lines)), max(Counter(words).values(), default=0) / w, len(zlib.compress(raw, 1)) / max(1, len(raw)),
    ]


def test_measures_equal_plain_ones():
    texts = [t for _, t in awkward()] + ["A! b? C, d. e|f #1 23", "same same\nsame same\n\nother line", "é É ü. é", "\n\n", "x"] + [None, ""]
    got = quality.measures(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_measures(t) for t in texts], atol=1e-12)


def test_long_texts_are_measured_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "x,", "END.\n"]) for _ in range(20_000))
    whole = quality.measures(pa.array([text, "short", text[:5000]]))
    monkeypatch.setattr(quality, "PIECE", 9_000)
    cut = quality.measures(pa.array([text, "short", text[:5000]]))
    names = list(quality.FEATURES)
    for k in (names.index("lines"), names.index("distinct_lines")):  # a piece ends a line
        whole[:, k] = cut[:, k] = 0
    assert np.allclose(whole, cut, atol=1e-12)
    assert np.isfinite(quality.measures(pa.array(["z" * 100_000, "é" * 50_000]))).all()


def sample_texts(n, seed=1):
    """(id, text, label): prose, and junk of several kinds."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(5, 120))]
        kind = rng.randint(0, 7)
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            text = " ".join(w + rng.choice(["$$$", "###", "&&&"]) for w in words)
        elif kind == 2:
            text = " ".join(w for w in words[:8] for _ in range(9))
        else:
            text = " ".join(words).capitalize() + "."
        out.append((i, text, int(kind > 2)))
    return out


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    ones = (y == 1).sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_held_out_accuracy(spark):
    rows = sample_texts(1500)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 5], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, quality.fit(docs, labels), keep=["doc_id"]).collect()}
    held = [(out[i].score, q, out[i].predicted) for i, _, q in rows if i % 5 == 0]
    score, y = np.array([s for s, _, _ in held]), np.array([q for _, q, _ in held])
    assert auc(score, y) > 0.995 and np.mean([p == q for _, q, p in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in out.values())


def test_scores_are_sums_of_table_entries():
    rows = sample_texts(800, 2)
    x = quality.measures(pa.array([t for _, t, _ in rows]))
    model = quality.fitted(x, np.array([float(q) for *_, q in rows]))
    assert model.pairs
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept
        for v, edges, values in zip(row, model.edges, model.tables, strict=True):
            total += values[sum(e <= v for e in edges)]
        for i, j, a, b, values in model.pairs:
            total += values[sum(e <= row[i] for e in a), sum(e <= row[j] for e in b)]
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, 0], x[:, 1] = rng.random(4000), rng.random(4000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fitted(x, y)
    assert {(i, j) for i, j, *_ in model.pairs} >= {(0, 1)}
    assert auc(model.score(x), y) > 0.95
    assert auc(quality.Model(model.intercept, model.edges, model.tables, []).score(x), y) < 0.75


def test_tree_is_the_best_cut_each_time():
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=9), rng.random(9)
    values = quality.tree_1d(g, h, 2)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cut = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))
    assert np.allclose(values[:cut], g[:cut].sum() / (h[:cut].sum() + 1)) and np.allclose(values[cut:], g[cut:].sum() / (h[cut:].sum() + 1))
    g2, h2 = rng.normal(size=(4, 5)), rng.random((4, 5))
    four = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
    best = max((sum(g2[s].sum() ** 2 / (h2[s].sum() + 1) for s in four(i, j)), i, j) for i in range(1, 4) for j in range(1, 5))
    values, gain = quality.tree_2d(g2, h2)
    assert math.isclose(gain, best[0] - g2.sum() ** 2 / (h2.sum() + 1))
    for s in four(*best[1:]):
        assert np.allclose(values[s], g2[s].sum() / (h2[s].sum() + 1))


@pytest.mark.parametrize("labelled,scores", [([], {0.5}), ([(1, 1), (4, 1)], None), ([(1, 0), (1, 1), (None, 1), (2, None)], None)])
def test_few_labels_and_awkward_texts(spark, labelled, scores):
    docs = frame(spark, awkward() + [(None, "no id"), (5, "again"), (5, "again")])
    labels = spark.createDataFrame(labelled, "doc_id bigint, quality int")
    rows = quality.classify(docs, quality.fit(docs, labels), keep=["doc_id", "score"]).collect()
    assert len(rows) == len(awkward()) + 3 and all(0 <= r.score <= 1 for r in rows)
    assert scores is None or {r.score for r in rows} == scores
    assert quality.classify(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_the_sample_is_bounded_and_copies_do_not_move_it(spark):
    rows = sample_texts(300, 5)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(7, rows[7][1])] * 400)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] * 2, "doc_id bigint, quality int")
    model = quality.fit(docs, labels, sample_rows=120)
    again = quality.fit(docs.repartition(5), labels.repartition(3), sample_rows=120)
    assert model.intercept == again.intercept and all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))
