"""Centroid clustering with Orchard's search.

Vectors become integers, floor(scale * x). Centroids start as the vectors whose ids hash smallest; each round assigns
every vector to its nearest centroid and moves each centroid to the floor of its members' mean.

The nearest centroid is found by Orchard's method: each centroid has a list of the others, nearest first. A vector starts
at some centroid and goes along that one's list; where an entry is closer, it jumps to the closer one's list, and what it
has met is marked and not measured again. It stops where the list is strictly beyond twice the current distance, since by
the triangle inequality nothing beyond is closer, or as close. A whole Arrow batch takes each step together.

Only sums and counts leave a task in a round: k rows for each component, summed by Spark. The centroids (k vectors) are
all that comes to the driver and goes out again. What is assigned last is written once and read twice, for the sums over
clusters and for the result.

Edge cases: vectors that are null, of another length than ``size``, or with null or non-finite components take no part
(see ``vectors``). With fewer vectors than k there are fewer centroids. Rows without id take part; among the first
centroids they come last. Repeated rows count each; as first centroids they stand in the order of their vectors. Ties go
to the smaller number. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import cut, table

#: Vectors that take their steps together; bounds a task's scratch memory.
STEP_ROWS = 4096


class Orchard:
    """Sorted lists of neighbours of each centroid."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        k, kind = len(centres), vectors.computable(centres)
        c = centres.astype(kind)
        gap = np.array([[((a - b) ** 2).sum() for b in c] for a in c], dtype=object if kind == object else np.int64).reshape(k, k)
        order = np.array([sorted(range(k), key=lambda y: (y == i, gap[i, y], y)) for i in range(k)], np.int64).reshape(k, k)
        self.near = order[:, : k - 1]
        # a list entry y is strictly beyond twice the distance d of a vector iff gap > 4 d*d, that is ceil(gap / 4) > d*d
        self.quarter = np.array([[-(-int(gap[i, y]) // 4) for y in self.near[i]] for i in range(k)], dtype=gap.dtype).reshape(k, k - 1)
        self.sum_order = np.argsort(centres.astype(np.float64).sum(axis=1), kind="stable")
        self.sum_of = centres.astype(np.float64).sum(axis=1)[self.sum_order]

    def start(self, x: np.ndarray) -> np.ndarray:
        """A first guess: the centroid whose components' sum is closest."""
        s = x.astype(np.float64).sum(axis=1)
        at = np.clip(np.searchsorted(self.sum_of, s), 1, max(1, len(self.sum_of) - 1))
        left, right = self.sum_of[at - 1], self.sum_of[np.minimum(at, len(self.sum_of) - 1)]
        return self.sum_order[np.where(s - left <= right - s, at - 1, np.minimum(at, len(self.sum_of) - 1))]

    def nearest(self, x: np.ndarray, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid; ``work`` gets the number of distances measured."""
        kind = vectors.computable(x, self.centres)
        x, c, n = x.astype(kind), self.centres.astype(kind), len(x)
        current = self.start(x)
        away = ((x - c[current]) ** 2).sum(axis=1)
        met = np.zeros((n, len(c)), bool)
        met[np.arange(n), current] = True
        measured, at, live = n, np.zeros(n, np.int64), np.arange(n)
        while len(live) and self.near.shape[1]:
            i, p = current[live], at[live]
            on = p < self.near.shape[1]
            on[on] = (self.quarter[i[on], p[on]] <= away[live[on]]).astype(bool)
            live, i, p = live[on], i[on], p[on]
            y = self.near[i, p]
            at[live] = p + 1
            fresh = ~met[live, y]
            rows, y = live[fresh], y[fresh]
            met[rows, y] = True
            measured += len(rows)
            there = ((x[rows] - c[y]) ** 2).sum(axis=1)
            jump = (there < away[rows]) | ((there == away[rows]) & (y < current[rows]))
            jump = jump.astype(bool)
            rows = rows[jump]
            current[rows], away[rows], at[rows] = y[jump], there[jump], 0
        if work is not None:
            work.append(measured)
        return current, away


def first_centroids(rows: DataFrame, k: int, scale: int, prefix: str) -> np.ndarray:
    """The vectors of the k smallest hashes of prefix and id."""
    key = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    first = rows.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([[int(np.floor(scale * x)) for x in r.v] for r in first], np.int64)


def fit(rows: DataFrame, first: np.ndarray, scale: int, rounds: int) -> np.ndarray:
    """The centroids after ``rounds`` rounds over rows (id, v)."""
    centres = first
    for _ in range(rounds):
        orchard = rows.sparkSession.sparkContext.broadcast(Orchard(centres))  # k vectors and their lists

        def sums(batches: Iterator[pa.RecordBatch], orchard=orchard) -> Iterator[pa.RecordBatch]:
            total, k = vectors.Sums(), len(orchard.value.centres)
            for x in batches:
                for lo in range(0, x.num_rows, STEP_ROWS):
                    v = vectors.scaled(x.column("v").slice(lo, STEP_ROWS), scale)
                    number, _ = orchard.value.nearest(v)
                    total.add(0, number, np.ones(len(v), np.int64), v, k)
            yield from total.batches()

        centres = vectors.floor_means(rows.select("v").mapInArrow(sums, vectors.Sums.DDL), [centres])[0]
    return centres


def clusters(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, prefix: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), the id under its own name."""
    spark = df.sparkSession
    rows = cut(vectors.vector_rows(df, vector_col, scale, {"id": id_col}).where(F.size("v") == size))
    kind = rows.schema["id"].dataType.simpleString()
    first = first_centroids(rows, k, scale, prefix)
    if not len(first):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = fit(rows, first, scale, rounds)
    orchard = spark.sparkContext.broadcast(Orchard(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, STEP_ROWS):
                some = x.slice(lo, STEP_ROWS)
                number, away = orchard.value.nearest(vectors.scaled(some.column("v"), scale))
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(number.astype(np.int32)), vectors.capped(away)], ["id", "cluster", "distance"])

    assigned = cut(rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"))
    within = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    per = [(c, min(d, vectors.MOST), min(sum(within.values()), vectors.MOST), vectors.digest(centres[c])) for c, d in within.items()]
    per_cluster = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return assigned.join(F.broadcast(per_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 3) -> str:
    """The same rounds, unrolled: every vector against every centroid."""
    parts = [
        """WITH e AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS n, v AS c FROM e
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) <= 16
)"""
    ]
    for k in range(rounds + 1):
        near = f"""a{k} AS (
  SELECT vec_id, v, n, d FROM (
    SELECT e.vec_id, e.v, c.n, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(e.v, c.c)]) AS d FROM e, c{k} c
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, n) = 1
)"""
        parts.append(near)
        if k < rounds:
            parts.append(f"""s{k} AS (
  SELECT n, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM (SELECT n, unnest(v) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY n, i
), c{k + 1} AS (
  SELECT c.n, coalesce(x.c, c.c) AS c FROM c{k} c LEFT JOIN (
    SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM s{k} GROUP BY n
  ) x ON x.n = c.n
)""")
    return ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.n AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.n = a.n
"""


OP12_SQL = _sql()
