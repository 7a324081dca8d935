"""Vector code compression: product codes, their codebooks found by dual-tree Lloyd rounds.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts; a part's code is the number of its
codebook's nearest entry. Vectors are packed into blocks of bounded size once, each part of a block in the order of a
balanced tree, and written to the shared checkpoint folder; all rounds read these blocks.

In a round, the tree over a block's parts and the tree over the codebook's entries are descended together. A pair of nodes
is bounded by its centres' distance and both radii: what is farther from a node of parts than some entry surely is, is
pruned, and so is an entry on the far side of the plane halfway to the node's nearest entry. A node with one entry left
is assigned as a whole, by its cached sum and count. Leaves with several entries left compare whole numbers, exactly.

Only sums and counts leave a task in a round, one row for each component of the codebooks, and the codebooks (parts times
entries) come to the driver and go out with their trees. What is coded last is written once and read twice: for the sums
over labels and for the result.

Edge cases: vectors that are null or hold null or non-finite components take no part (see ``vectors``), nor do those of
another length than ``size`` (unset: the commonest length, the longer one where two are equally common), nor any if the
length is no multiple of the parts or is 0. With fewer vectors than entries, codebooks have fewer entries. Rows without id
take part and come last among the first entries; repeated rows count each. Equal entries: the lower index gets all.
Labels may be of any type that can be grouped; null ones belong together. Extra columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import cut, ranges, table

#: Vectors of a block at most, and bytes of their components.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Points of a leaf at most; entries have leaves of one.
LEAF = 32
#: Up to so many labels, their sums are sent to every task; more are joined by a shuffle, hot ones in ``SALTS`` parts.
LABELS, SALTS = 100_000, 16


def tree_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in the order of a balanced tree: each node is halved at the median of its widest component."""
    order, depth = np.arange(len(x)), 0
    while -(-len(x) // (1 << depth)) > leaf:
        edges = np.arange((1 << depth) + 1) * len(x) >> depth
        for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            mid = ((2 * k + 1) * len(x)) >> (depth + 1)
            if lo < mid < hi:
                some = x[order[lo:hi]]
                widest = int((some.max(axis=0) - some.min(axis=0)).argmax())
                order[lo:hi] = order[lo:hi][np.argpartition(some[:, widest], mid - lo)]
        depth += 1
    return order


class Nodes:
    """A balanced tree over rows in its order. Node i has the children 2i+1 and 2i+2, the rows lo..hi, a centre, a radius
    and the sum of its rows; a node whose rows are equal has no children, nor has one of the last level.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        n, depth = len(x), 0
        while -(-n // (1 << depth)) > leaf:
            depth += 1
        before = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x.astype(np.int64), axis=0)])
        real, lows, highs, sums, centres, radii = x.astype(np.float64), [], [], [], [], []
        for level in range(depth + 1):
            edges = np.arange((1 << level) + 1) * n >> level
            lo, hi = edges[:-1], edges[1:]
            total, size = before[hi] - before[lo], np.maximum(hi - lo, 1)
            centre, radius = total / size[:, None], np.zeros(len(lo))
            away = np.sqrt(((real - np.repeat(centre, hi - lo, axis=0)) ** 2).sum(axis=1))
            some = hi > lo
            radius[some] = np.maximum.reduceat(away, lo[some])
            # equal rows: the centre may be off by rounding, the rows tell
            same = some & (np.maximum.reduceat(x, lo[some], axis=0) == np.minimum.reduceat(x, lo[some], axis=0)).all(axis=1)[np.cumsum(some) - 1]
            radius[same] = 0
            for kept, new in zip((lows, highs, sums, centres, radii), (lo, hi, total, centre, radius), strict=True):
                kept.append(new)
        self.lo, self.hi, self.sum, self.centre, self.radius = (np.concatenate(k) for k in (lows, highs, sums, centres, radii))
        self.single = self.hi - self.lo == 1
        self.split = (np.arange(len(self.lo)) < (1 << depth) - 1) & (self.radius > 0) & ~self.single


class Book:
    """A codebook's distinct entries (the least number of equal ones) as a tree."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        first: dict[tuple, int] = {}
        for i, e in enumerate(entries.tolist()):
            first.setdefault(tuple(e), i)
        number = np.array(sorted(first.values()), np.int64)
        order = tree_order(entries[number].astype(np.float64), 1)
        self.number = number[order]
        self.nodes = Nodes(entries[self.number], 1) if int(np.abs(entries).max(initial=0)) < vectors.SMALL else None


def assign(x: np.ndarray, points: Nodes, book: Book, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the two trees give: nodes of points and the entry of each as a whole; single rows and the entry of each.

    ``work`` gets the numbers of node pairs bounded and of distances between rows and entries.
    """
    e, kind = book.nodes, vectors.computable(x, book.entries)
    rows_x, entries = x.astype(kind), book.entries.astype(kind)
    whole_p, whole_e, leaf_p, leaf_e, bounded = [], [], [], [], 0
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(p):
        bounded += len(p)
        away = np.sqrt(((points.centre[p] - e.centre[q]) ** 2).sum(axis=1))
        reach = points.radius[p] + e.radius[q]
        start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        size = np.diff(np.append(start, len(p)))
        surely = np.repeat(np.minimum.reduceat(away + reach, start), size)
        slack = 1e-9 * (away + reach + surely) + 1e-6
        keep = away - reach <= surely + slack
        # single entries beyond the plane halfway to the nearest single entry of the group
        alone = np.where(e.single[q], away, np.inf)
        least = np.minimum.reduceat(alone, start)
        best = np.repeat(_first_least(alone, start, size, q), size)
        near = np.repeat(least, size)
        plane = e.single[q] & np.isfinite(near) & (q != best)
        between = np.sqrt(((e.centre[q] - e.centre[best]) ** 2).sum(axis=1))
        far = away**2 - np.where(np.isfinite(near), near, 0) ** 2
        keep &= ~(plane & (far > 2 * points.radius[p] * between + 1e-9 * (away**2 + between**2) + 1e-6 * (away + between) + 1e-6))
        p, q = p[keep], q[keep]
        start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        size = np.diff(np.append(start, len(p)))
        one = np.repeat(size == 1, size) & e.single[q]
        whole_p.append(p[one])
        whole_e.append(q[one])
        widest = np.repeat(np.maximum.reduceat(np.where(e.split[q], e.radius[q], -1.0), start), size)
        open_p = points.split[p]
        split_e = ~one & e.split[q] & ((e.radius[q] >= points.radius[p]) | ~open_p)
        split_p = ~one & open_p & ~(widest >= points.radius[p])
        ended = ~one & ~open_p & ~np.repeat(np.logical_or.reduceat(e.split[q], start), size)
        leaf_p.append(p[ended])
        leaf_e.append(q[ended])
        stay = ~one & ~split_e & ~split_p & ~ended
        new_p = np.concatenate([p[stay], p[split_e], p[split_e], 2 * p[split_p] + 1, 2 * p[split_p] + 2])
        new_q = np.concatenate([q[stay], 2 * q[split_e] + 1, 2 * q[split_e] + 2, q[split_p], q[split_p]])
        there = e.hi[new_q] > e.lo[new_q]
        order = np.argsort(new_p[there], kind="stable")
        p, q = new_p[there][order], new_q[there][order]
    whole_p, whole_e, leaf_p, leaf_e = (np.concatenate(c) for c in (whole_p, whole_e, leaf_p, leaf_e))
    rows, codes, scored = [], [], 0
    start = np.flatnonzero(np.concatenate([[True], leaf_p[1:] != leaf_p[:-1]])) if len(leaf_p) else np.empty(0, np.int64)
    for lo, hi in zip(start.tolist(), np.append(start[1:], len(leaf_p)).tolist() if len(leaf_p) else [], strict=True):
        node, number = leaf_p[lo], np.sort(book.number[e.lo[leaf_e[lo:hi]]])
        a, b = points.lo[node], points.hi[node]
        some = rows_x[a : a + 1] if points.radius[node] == 0 else rows_x[a:b]
        c = entries[number]
        d = (c * c).sum(axis=1)[None, :] - 2 * (some @ c.T)  # squared distance less the row's own square
        code = number[d.argmin(axis=1)]
        scored += d.size
        rows.append(np.arange(a, b))
        codes.append(np.broadcast_to(code, b - a) if len(some) == 1 else code)
    if work is not None:
        work += [bounded, scored]
    none = np.empty(0, np.int64)
    return whole_p, book.number[e.lo[whole_e]], np.concatenate(rows) if rows else none, np.concatenate(codes) if codes else none


def _first_least(values: np.ndarray, start: np.ndarray, size: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each group, q where the group's values are least first."""
    group = np.repeat(np.arange(len(start)), size)
    order = np.lexsort((values, group))
    return q[order[start]]


def plainly(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Nearest entries in Python's integers, for components that trees in doubles cannot bound."""
    rows, book = x.astype(object), entries.astype(object)
    return np.array([min(range(len(book)), key=lambda i: (((r - book[i]) ** 2).sum(), i)) for r in rows], np.int64)


def codes_of(x: np.ndarray, book: Book) -> np.ndarray:
    """The nearest entry of each row of a block's part, which is in tree order."""
    if book.nodes is None or int(np.abs(x).max(initial=0)) >= vectors.SMALL:
        return plainly(x, book.entries)
    points = Nodes(x, LEAF)
    node, entry, rows, codes = assign(x, points, book)
    out = np.empty(len(x), np.int64)
    out[ranges(points.lo[node], points.hi[node] - points.lo[node])] = np.repeat(entry, points.hi[node] - points.lo[node])
    out[rows] = codes
    return out


def add_sums(total: vectors.Sums, part: int, x: np.ndarray, book: Book) -> None:
    """Add a block's part to the sums by entry; whole nodes by their cached sums."""
    k = len(book.entries)
    if book.nodes is None or int(np.abs(x).max(initial=0)) >= vectors.SMALL:
        total.add(part, plainly(x, book.entries), np.ones(len(x), np.int64), x, k)
        return
    points = Nodes(x, LEAF)
    node, entry, rows, codes = assign(x, points, book)
    total.add(part, entry, points.hi[node] - points.lo[node], points.sum[node], k)
    total.add(part, codes, np.ones(len(rows), np.int64), x[rows], k)


def _blocks(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """Rows (id, label, v) as blocks: ids and labels as arrays, the integers of each part in tree order, and the order."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def packed(x: pa.Table) -> pa.RecordBatch:
        v = vectors.scaled(x.column("v").combine_chunks(), scale)
        wide, edges = v.shape[1] // parts, pa.array([0, len(v)], pa.int32())
        orders = [tree_order(v[:, p * wide : (p + 1) * wide].astype(np.float64), LEAF).astype(np.int32) for p in range(parts)]
        cells = np.concatenate([v[o, p * wide : (p + 1) * wide] for p, o in enumerate(orders)])
        small = cells.astype(np.int32) if int(np.abs(cells).max()) < 2**31 else cells
        lists = [pa.ListArray.from_arrays(edges, x.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int32()), *lists, pa.array([small.tobytes()], pa.binary()), pa.array([np.concatenate(orders).tobytes()], pa.binary())], ["n", "id", "label", "cells", "order"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have, size = 0, BLOCK
        for x in batches:
            at = 0
            while at < x.num_rows:
                size = max(1, min(BLOCK, BLOCK_BYTES // (8 * len(x.column("v")[0]))))
                some = x.slice(at, size - have)
                held.append(some)
                have, at = have + some.num_rows, at + some.num_rows
                if have >= size:
                    yield packed(pa.Table.from_batches(held))
                    held, have = [], 0
        if held:
            yield packed(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"n int, id array<{kinds['id']}>, label array<{kinds['label']}>, cells binary, order binary")


def _unpacked(x: pa.RecordBatch, row: int, parts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The integers of each part of a block and their orders."""
    n, cells = x.column("n")[row].as_py(), x.column("cells")[row].as_buffer()
    order = np.frombuffer(x.column("order")[row].as_buffer(), np.int32).reshape(parts, n)
    kind = np.int32 if cells.size == 4 * n * parts * x.column("wide")[row].as_py() else np.int64
    v = np.frombuffer(cells, kind).reshape(parts, n, -1).astype(np.int64)
    return list(v), list(order)


def fit(blocks: DataFrame, first: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over the blocks."""
    books, parts = first, len(first)
    for _ in range(rounds):
        shipped = blocks.sparkSession.sparkContext.broadcast([Book(b) for b in books])  # parts x entries, and their trees

        def sums(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            total = vectors.Sums()
            for x in batches:
                for row in range(x.num_rows):
                    for part, cells in enumerate(_unpacked(x, row, parts)[0]):
                        add_sums(total, part, cells, shipped.value[part])
            yield from total.batches()

        books = vectors.floor_means(blocks.select("n", "wide", "cells", "order").mapInArrow(sums, vectors.Sums.DDL), books)
    return books


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, size: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256), the id under its own name."""
    spark = df.sparkSession
    rows = vectors.vector_rows(df, vector_col, scale, {"id": id_col, "label": label_col})
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    if size is None:
        common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
        size = common[0]["size"] if common else 0
    nothing = f"`{id_col}` {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string"
    if size == 0 or size % parts:
        return spark.createDataFrame([], nothing)
    rows, wide = rows.where(F.size("v") == size), size // parts
    start = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not start:
        return spark.createDataFrame([], nothing)
    first = np.array([[int(np.floor(scale * x)) for x in r.v] for r in start], np.int64)
    blocks = cut(_blocks(rows, parts, scale).withColumn("wide", F.lit(wide)))
    books = fit(blocks, [first[:, p * wide : (p + 1) * wide] for p in range(parts)], rounds)
    shipped = spark.sparkContext.broadcast([Book(b) for b in books])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(entries)], dtype=object)
        for x in batches:
            for row in range(x.num_rows):
                text, error = None, 0
                for book, cells, order in zip(shipped.value, *_unpacked(x, row, parts), strict=True):
                    mine, number = codes_of(cells, book), np.empty(len(order), np.int64)
                    kind = vectors.computable(cells, book.entries)
                    d = ((cells.astype(kind) - book.entries[mine].astype(kind)) ** 2).sum(axis=1)
                    away = np.empty(len(order), d.dtype)
                    number[order], away[order] = mine, d
                    text = digits[number] if text is None else text + digits[number]
                    error = error + away.astype(np.int64 if kind == np.float64 else object)
                yield pa.RecordBatch.from_arrays([x.column("id")[row].values, x.column("label")[row].values, pa.array(text, pa.string()), vectors.capped(error)], ["id", "label", "code", "error"])

    coded = cut(blocks.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    sums = cut(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(vectors.MOST).cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of"))
    if sums.count() <= LABELS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    else:
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = coded.withColumn("salt_of", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")), "left")
    digest = vectors.digest(np.concatenate([b.ravel() for b in books]))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 4) -> str:
    """The same rounds, unrolled: every part against every entry."""
    parts = [
        """WITH e AS (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT vec_id, k, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] AS v FROM e, (SELECT unnest(range(4)) AS k)
), c0 AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS n, v AS c FROM p
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY vec_id) <= 256
)"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT vec_id, k, v, n, d FROM (
    SELECT p.vec_id, p.k, p.v, c.n, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, c.c)]) AS d FROM p JOIN c{r} c ON p.k = c.k
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, k ORDER BY d, n) = 1
)""")
        if r < rounds:
            parts.append(f"""s{r} AS (
  SELECT k, n, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM (SELECT k, n, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY k, n, i
), c{r + 1} AS (
  SELECT c.k, c.n, coalesce(x.c, c.c) AS c FROM c{r} c LEFT JOIN (
    SELECT k, n, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM s{r} GROUP BY k, n
  ) x ON x.n = c.n AND x.k = c.k
)""")
    return ",\n".join(parts) + f""", b AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, n)) AS codebooks_sha256 FROM c{rounds}
), f AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(n AS INTEGER)), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, codebooks_sha256
FROM f JOIN e USING (vec_id), b
"""


OP11_SQL = _sql()
