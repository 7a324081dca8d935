"""Codes and clusters of vectors against plain loops over Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tributary.llm import clusters, codes, vectors

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def grouped(n, size, seed=3, groups=12, spread=0.05):
    """Vectors in groups, some rows equal, one vector held by a third of the rows."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, size))
    out = centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, size))
    out[:: 3] = out[0]
    return [(i, [float(x) for x in v], i % 4 if i % 5 else None) for i, v in enumerate(out)]


def awkward_rows(size):
    return [(900_001, None, 1), (900_002, [None] * size, 1), (900_003, [math.nan] * size, 1), (900_004, [math.inf] + [0.0] * (size - 1), 2), (900_005, [1e300] * size, 2), (900_006, [], 1)]


def floor_mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows)]


def nearest(v, book):
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(book))


def plain_clusters(rows, k, rounds, size, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < 2**62 / scale for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for _ in range(rounds):
        of = [nearest(v, centres)[1] for _, v in kept]
        centres = [floor_mean([v for (_, v), o in zip(kept, of) if o == c]) if c in of else centres[c] for c in range(len(centres))]
    out = [(i, *nearest(v, centres)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, c, d, sum(e for _, e, o in out if o == c), total, sha[c]) for i, d, c in out)


def plain_codes(rows, parts, entries, rounds, size, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < 2**62 / scale for x in v)]
    first, wide = sorted(kept)[:entries], size // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [nearest(cut(v, p), book)[1] for _, v, _ in kept]
            books[p] = [floor_mean([cut(v, p) for (_, v, _), o in zip(kept, of) if o == c]) if c in of else book[c] for c in range(len(book))]
    out = [(i, [nearest(cut(v, p), books[p]) for p in range(parts)], lab) for i, v, lab in kept]
    error = lambda n: sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for _, c in n), error(n), sum(error(m) for _, m, o in out if o == lab), sha) for i, n, lab in out)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n,k", [(400, 16), (5, 16), (1, 1)])
def test_clusters_equal_plain_rounds(spark, n, k):
    rows = grouped(n, 64) + awkward_rows(64) + [(900_007, [0.5] * 63, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("cluster", F.lit("clash")).withColumn("V", F.lit(1))
    assert collected(clusters.clusters(df, k=k)) == plain_clusters(rows, k, 3, 64)


def test_clusters_of_large_components_are_exact(spark):
    rows = [(i, [float((i * 7919 + j * j) % 97) * 2.0**s for j in range(4)], 0) for s in (0, 20, 30) for i in range(100 * s, 100 * s + 9)]
    got = collected(clusters.clusters(spark.createDataFrame(rows, SCHEMA), k=4, size=4))
    want = [(i, c, *(min(x, vectors.MOST) for x in rest[:3]), rest[3]) for i, c, *rest in plain_clusters(rows, 4, 3, 4)]
    assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in want]


def test_orchard_measures_less_than_all():
    rng = np.random.default_rng(1)
    centre = rng.integers(-4000, 4000, (64, 16))
    x = centre[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 16))
    work: list[int] = []
    number, away = clusters.Orchard(centre).nearest(x, work)
    all_d = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2)
    assert (number == all_d.argmin(axis=1)).all() and (away == all_d.min(axis=1)).all()
    assert work[0] < 0.5 * all_d.size


def test_orchard_ties_go_to_the_smaller_number():
    centre = np.array([[10, 0], [0, 0], [0, 0], [10, 0], [5, 5]])
    number, away = clusters.Orchard(centre).nearest(np.array([[5, 0], [0, 0], [10, 0], [5, 3]]))
    assert number.tolist() == [0, 1, 0, 4] and away.tolist() == [25, 0, 0, 4]


@pytest.mark.parametrize("n,entries,partitions", [(700, 256, 3), (700, 16, 1), (20, 256, 4), (1, 4, 1)])
def test_codes_equal_plain_rounds(spark, n, entries, partitions):
    rows = grouped(n, 8) + awkward_rows(8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions).withColumn("code", F.lit("clash")).withColumn("ID", F.lit(1))
    rounds = 4 if n < 700 or entries < 256 else 2
    assert collected(codes.compress(df, entries=entries, rounds=rounds)) == plain_codes(rows, 4, entries, rounds, 8)


def test_codes_of_random_directions_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 2, [float(x) for x in v], i % 3) for i, v in enumerate(np.repeat(rng.normal(size=(150, 8)), 2, axis=0))]
    assert collected(codes.compress(spark.createDataFrame(rows, SCHEMA), entries=32)) == plain_codes(rows, 4, 32, 4, 8)


def test_codes_of_large_components_are_exact(spark):
    rows = [(i, [float((i * 31 + j * 17) % 53) * 2.0**s for j in range(4)], 0) for s in (0, 18, 30) for i in range(100 * s, 100 * s + 7)]
    got, want = collected(codes.compress(spark.createDataFrame(rows, SCHEMA), entries=6)), plain_codes(rows, 4, 6, 4, 4)
    assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want]
    assert [g[2] for g in got] == [min(w[2], vectors.MOST) for w in want]


def test_many_labels_are_joined_in_parts(spark, monkeypatch):
    rows = [(i, v, i % 50) for i, v, _ in grouped(200, 8)]
    monkeypatch.setattr(codes, "LABELS", 3)
    assert collected(codes.compress(spark.createDataFrame(rows, SCHEMA), entries=8)) == plain_codes(rows, 4, 8, 4, 8)


def test_trees_prune_and_assign_whole_nodes():
    rng = np.random.default_rng(2)
    centre = rng.integers(-3000, 3000, (64, 8))
    x = centre[rng.integers(0, 64, 4096)] + rng.integers(-40, 40, (4096, 8))
    x = x[codes.tree_order(x.astype(float), codes.LEAF)]
    book, points, work = codes.Book(centre), codes.Nodes(x, codes.LEAF), []
    node, entry, rows, found = codes.assign(x, points, book, work)
    want = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (codes.codes_of(x, book) == want).all()
    assert work[0] + work[1] < 0.4 * len(x) * 64
    assert (points.hi[node] - points.lo[node]).sum() > 0.2 * len(x)


def test_wider_blocks_are_cut(spark, monkeypatch):
    rows = grouped(150, 8)
    monkeypatch.setattr(codes, "BLOCK", 64)
    assert collected(codes.compress(spark.createDataFrame(rows, SCHEMA).coalesce(1), entries=8)) == plain_codes(rows, 4, 8, 4, 8)


@pytest.mark.parametrize("make", [clusters.clusters, codes.compress])
def test_empty_tables_and_tables_of_nothing_usable(spark, make):
    assert make(spark.createDataFrame([], SCHEMA)).collect() == []
    assert make(spark.createDataFrame(awkward_rows(64), SCHEMA)).collect() == []


def test_rows_without_id_take_part(spark):
    rows = grouped(60, 8) + [(None, [0.25] * 8, 1)]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA), entries=8).collect()
    assert len(got) == 61 and sum(r.vec_id is None for r in got) == 1
    assert clusters.clusters(spark.createDataFrame(rows, SCHEMA), size=8).count() == 61
