"""Exact top-k search by inner product: cover trees over queries and data, descended together.

Vectors become integers, floor(1024 * x). The top of the data tree is made first: the nets of a cover tree over a bounded
sample (``sample`` rows of smallest hash) give at most ``cells`` centres, every vector goes to the nearest one, and each
cell's covering radius is taken over all its vectors, so the sample only affects speed. A large cell is dealt out to
blocks of bounded size. Queries are searched in their own block first; the k-th score found there is a floor under which
nothing is wanted anywhere. A query is then sent only to the blocks of cells whose bound reaches its floor.

In a block both sides get a cover tree: a node has a centre, a covering radius and, as children, a net of half that
radius, down to leaves of ``LEAF`` points, of equal points, or of single points where points lie apart. Node pairs are
descended together. For a query node (centre p, radius s) and a data node (c, r) no score exceeds
``p.c + |p| r + |c| s + r s``; a pair is pruned when this is under the worst k-th score of the query node's points, and
pairs of leaves are scored best bound first until the rest is pruned. The best k of all blocks are merged by rank.

Where nothing lies close together (random directions in many dimensions) no bound prunes, and every pair is scored.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without id.
Vectors are only compared with vectors of the same length. A query is answered once however often its row is repeated
(its least vector, if they differ), and rows of its own id are no candidates. Ties go to the smaller id. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, position, ranges, table

#: Rows of a block at most, and bytes of its vectors.
BLOCK, BLOCK_BYTES = 8192, 32 << 20
#: Queries that are searched together.
QUERIES = 4096
LEAF = 16
#: Products of integers are exact in doubles below this.
EXACT = 2.0**53


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, by a matrix product."""
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))


def net(x: np.ndarray, points: np.ndarray, radius: float) -> list[np.ndarray]:
    """Groups of points around centres that lie farther apart than the radius; a group's centre comes first."""
    groups, left = [], points
    while len(left):
        tried = left[:64]
        far = squares(x[left], x[tried]) > radius * radius * (1 + 1e-12)
        far[np.arange(len(tried)), np.arange(len(tried))] = False
        chosen: list[int] = []
        for j in range(len(tried)):
            if far[chosen, j].all():
                chosen.append(j)
        covered = ~far[:, chosen]
        mine = np.where(covered.any(axis=1), covered.argmax(axis=1), -1)
        mine[chosen] = np.arange(len(chosen))
        for c, j in enumerate(chosen):
            others = np.flatnonzero(mine == c)
            groups.append(left[np.concatenate([[j], others[others != j]])])
        left = left[mine < 0]
    return groups


class CoverTree:
    """Nodes as arrays: centre, norm, radius, the range of ``order`` that holds the node's points, and its children."""

    def __init__(self, x: np.ndarray):
        nodes, at = [np.arange(len(x))], 0
        place, radius, first, many = [0], [], [], []
        while at < len(nodes):
            points = nodes[at]
            away = np.sqrt(((x[points] - x[points[0]]) ** 2).sum(axis=1))
            radius.append(float(away.max()))
            groups = [] if len(points) <= LEAF or radius[-1] == 0 else net(x, points, radius[-1] / 2)
            first.append(len(nodes))
            many.append(len(groups))
            begin = place[at]
            for g in groups:
                nodes.append(g)
                place.append(begin)
                begin += len(g)
            at += 1
        self.radius, self.first, self.many = np.array(radius), np.array(first), np.array(many)
        self.lo = np.array(place)
        self.hi = self.lo + np.array([len(n) for n in nodes])
        self.order = np.empty(len(x), np.int64)
        for n, a, children in zip(nodes, place, many, strict=True):
            if not children:
                self.order[a : a + len(n)] = n
        self.centre = x[np.array([n[0] for n in nodes])]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def cells(self, most: int) -> np.ndarray:
        """The centres of at most ``most`` nodes that together cover everything, the widest split first."""
        have = [0]
        while True:
            wide = max((n for n in have if self.many[n] and len(have) - 1 + self.many[n] <= most), key=lambda n: self.radius[n], default=None)
            if wide is None:
                return self.centre[have]
            have.remove(wide)
            have += range(self.first[wide], self.first[wide] + self.many[wide])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; in doubles where these are exact, else in whole numbers that wrap as 64-bit ones."""
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    return np.array([[(v + 2**63) % 2**64 - 2**63 for v in r] for r in exact], dtype=object)


class Best:
    """The k best of a group of queries so far, by score, then id."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int, exact: bool):
        self.own, self.floor, self.k, self.exact = own, floor, k, exact
        self.row, self.vec, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64 if exact else object)
        self.worst = floor.copy()

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = self.own[:, None] != ids[None, :]
        if self.exact:
            ok &= scores >= self.worst[:, None]
            if len(ids) > self.k:
                least = np.partition(np.where(ok, scores, -np.inf), len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                ok &= scores >= least[:, None]
        rows, cols = np.nonzero(ok)
        row, vec, score = (np.concatenate(x) for x in zip((self.row, self.vec, self.score), (rows, ids[cols], scores[rows, cols]), strict=True))
        order = np.lexsort((vec, -score, row)) if self.exact else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], vec[i])), np.int64)
        row, vec, score = row[order], vec[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.vec, self.score = row[keep], vec[keep], score[keep]
        if self.exact:
            last = rank == self.k - 1
            self.worst[row[last]] = np.maximum(self.worst[row[last]], score[last])


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, floor: np.ndarray | None = None, tree: CoverTree | None = None, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best rows of the data that reach its floor, ties to smaller ids.

    ``work`` gets the number of node pairs that were bounded and of pairs whose score was computed.
    """
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    if not np.abs(queries).max() * np.abs(data).max() * data.shape[1] < EXACT:  # scores wrap: nothing bounds them
        best = Best(query_ids, floor, k, False)
        best.add(products(queries, data), ids)
        return query_ids[best.row], best.vec, best.score.astype(np.int64)
    d, q = tree or CoverTree(data), CoverTree(queries)
    worst, done, counts = np.empty(len(queries)), [], [0, 0]

    def children(nodes: np.ndarray) -> np.ndarray:
        return np.arange(d.first[nodes[0]], d.first[nodes[0]] + d.many[nodes[0]]) if len(nodes) == 1 else ranges(d.first[nodes], d.many[nodes])

    def limit(n: int, nodes: np.ndarray) -> np.ndarray:
        """What no score of a point of query node n and a point of each data node exceeds."""
        counts[0] += len(nodes)
        together = len(nodes) and nodes[-1] - nodes[0] + 1 == len(nodes)
        c = d.centre[nodes[0] : nodes[-1] + 1] if together else d.centre[nodes]
        p, s = q.norm[n], q.radius[n]
        return c @ q.centre[n] + p * d.radius[nodes] + d.norm[nodes] * s + d.radius[nodes] * s + 1e-9 * (p + s) * (d.norm[nodes] + d.radius[nodes]) + 1e-6

    def points(nodes: np.ndarray) -> np.ndarray:
        return d.order[ranges(d.lo[nodes], d.hi[nodes] - d.lo[nodes])]

    def leaf(n: int, nodes: np.ndarray, most: np.ndarray) -> None:
        """Scores of a query leaf with data leaves, the best bound first, until what is left is pruned."""
        mine = q.order[q.lo[n] : q.hi[n]]
        best = Best(query_ids[mine], worst[q.lo[n] : q.hi[n]], k, True)
        order = np.argsort(-most, kind="stable")
        nodes, most = nodes[order], most[order]
        size, at = np.cumsum(d.hi[nodes] - d.lo[nodes]), 0
        while at < len(nodes):
            live = most[at:] >= best.worst.min()
            if not live.any():
                break
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (64 if at == 0 else 1024), "right")))
            there = points(nodes[at:to][live[: to - at]])
            best.add(queries[mine] @ data[there].T, ids[there])
            counts[1] += len(mine) * len(there)
            at = to
        done.append((best.own[best.row], best.vec, best.score.astype(np.int64)))

    def descend(n: int, nodes: np.ndarray, most: np.ndarray) -> None:
        """Query node n and the data nodes that may matter to it: the wider ones are split, what is too low is pruned."""
        low = worst[q.lo[n] : q.hi[n]].min()
        kept, bound = [], []
        while len(nodes):
            good = most >= low
            nodes, most = nodes[good], most[good]
            split = (d.many[nodes] > 0) & ((q.many[n] == 0) | (d.radius[nodes] >= q.radius[n]))
            kept.append(nodes[~split])
            bound.append(most[~split])
            nodes = children(nodes[split]) if split.any() else nodes[:0]
            most = limit(n, nodes)
        nodes, most = np.concatenate(kept), np.concatenate(bound)
        if not q.many[n]:
            leaf(n, nodes, most)
        elif len(nodes):
            for child in range(q.first[n], q.first[n] + q.many[n]):
                descend(child, nodes, limit(child, nodes))

    # what k points at the end of the best way down score is a first floor for each query leaf
    for n in np.flatnonzero(q.many == 0).tolist():
        mine = slice(q.lo[n], q.hi[n])
        worst[mine] = floor[q.order[mine]]
        if not np.isfinite(worst[mine]).all():
            nodes = np.zeros(1, np.int64)
            while d.many[nodes].any():
                wide = d.many[nodes] > 0
                nodes = np.concatenate([nodes[~wide], children(nodes[wide])])
                counts[0] += len(nodes)
                nodes = nodes[np.argsort(-(d.centre[nodes] @ q.centre[n]), kind="stable")]
                nodes = nodes[: 1 + int(np.searchsorted(np.cumsum(d.hi[nodes] - d.lo[nodes]), k + 1))]
            there = points(nodes)
            first = Best(query_ids[q.order[mine]], worst[mine], k, True)
            first.add(queries[q.order[mine]] @ data[there].T, ids[there])
            counts[1] += len(first.own) * len(there)
            worst[mine] = first.worst
    root = np.zeros(1, np.int64)
    descend(0, root, limit(0, root))
    if work is not None:
        work += counts
    return tuple(np.concatenate(c) for c in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 3


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Vectors of one length as integer rows."""
    return np.floor(np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) * scale)


def _by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for dim in np.unique(lengths).tolist():
        yield dim, np.flatnonzero(lengths == dim)


_ASSIGNED = "id bigint, q boolean, dim int, v array<double>, cell int, away double, peak double"


def _assigned(rows: DataFrame, centres, scale: float) -> DataFrame:
    """Rows (id, q, dim, v) with the nearest centre among those of their length (-1: there is none) and the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for dim, at in _by_length(x.column("dim").to_numpy()):
                some = x.take(pa.array(at))
                v = matrix(some.column("v"), scale)
                cell, away = np.full(len(at), -1, np.int32), np.zeros(len(at))
                if dim in centres.value:
                    c = centres.value[dim]
                    cell = squares(v, c).argmin(axis=1).astype(np.int32)
                    away = np.sqrt(((v - c[cell]) ** 2).sum(axis=1))
                made = [pa.array(cell), pa.array(away), pa.array(np.abs(v).max(axis=1))]
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("id", "q", "dim", "v")] + made, ["id", "q", "dim", "v", "cell", "away", "peak"])

    return rows.mapInArrow(run, _ASSIGNED)


_TASK = "dim int, cell int, part int, is_query boolean, id bigint, v array<double>, floor double"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _searched(data: DataFrame, queries: DataFrame, k: int, scale: float) -> DataFrame:
    """The k best of each query in each block that it was sent to. A block's data come first and become a tree; queries
    follow in any number, ``QUERIES`` at a time."""
    rows = data.select("dim", "cell", "part", F.lit(False).alias("is_query"), "id", "v", F.lit(None).cast("double").alias("floor")).unionByName(queries.select("dim", "cell", "part", F.lit(True).alias("is_query"), "id", "v", "floor"))
    ordered = rows.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "is_query")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for x in batches:
            if not x.num_rows:
                continue
            keys = np.stack([x.column(c).cast(pa.int32()).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "part", "is_query")], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield tuple(keys[lo].tolist()), x.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, data, tree, exact = None, [], None, None, None, True

        def answered(x: pa.RecordBatch) -> pa.RecordBatch:
            floor = np.nan_to_num(x.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            found = search(x.column("id").to_numpy(), matrix(x.column("v"), scale), ids, data, k, floor, tree)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

        for (*block, is_query), x in blocks(batches):
            if block != key:
                key, held, ids, data, tree = block, [], None, None, None
            if not is_query:
                held.append(x)
                continue
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                ids, data, held = whole.column("id").to_numpy(), matrix(whole.column("v").combine_chunks(), scale), []
                tree = CoverTree(data)
            if ids is not None:
                for at in range(0, x.num_rows, QUERIES):
                    yield answered(x.slice(at, QUERIES))

    return ordered.mapInArrow(run, _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, cells: int = 256, sample: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of each query's k highest integer inner products."""
    spark = vectors.sparkSession
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    by_place = numbered(vectors.withColumn("__is_query", F.coalesce(is_query, F.lit(False))))
    pick = lambda c: by_place[f"__{position(vectors, c)}"]
    rows = by_place.select(pick(id_col).cast("bigint").alias("id"), pick(vector_col).cast("array<double>").alias("v"), by_place[f"__{len(vectors.columns)}"].alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite).withColumn("dim", F.size("v"))

    n, widest = rows.agg(F.count("*"), F.max("dim")).collect()[0]
    take = max(16, min(sample, BLOCK_BYTES // (8 * (widest or 1))))
    by_dim: dict[int, list] = {}
    for r in rows.select("dim", "v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(take).collect():
        by_dim.setdefault(r.dim, []).append(r.v)
    most = min(cells, max(8, n // 256))
    centres = {dim: CoverTree(np.floor(np.array(v) * scale)).cells(most) for dim, v in by_dim.items()}
    shipped = spark.sparkContext.broadcast(centres)  # at most cells centres, no larger than the sample
    assigned = cut(_assigned(rows.select("id", "q", "dim", "v"), shipped, scale).withColumn("at", F.monotonically_increasing_id()))

    # one row for each cell: size, covering radius, largest component
    cell_rows = assigned.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("peak").alias("peak")).collect()
    if not cell_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    parts = {(r.dim, r.cell): -(-r.n // max(64, min(BLOCK, BLOCK_BYTES // (8 * r.dim)))) for r in cell_rows}
    wraps = {r.dim for r in cell_rows if not max(x.peak for x in cell_rows if x.dim == r.dim) ** 2 * r.dim < EXACT}
    n_parts = F.create_map(*[x for (dim, cell), p in parts.items() for x in (F.lit(f"{dim}/{cell}"), F.lit(p))])[F.concat_ws("/", "dim", "cell")]
    data = assigned.withColumn("part", F.pmod(F.xxhash64("at"), n_parts).cast("int"))
    by_id = F.min(F.struct("dim", "v", "cell", "part"))
    queries = cut(data.where("q").groupBy("id").agg(by_id.alias("x")).select("id", "x.*", F.lit(None).cast("double").alias("floor")))
    near = cut(_searched(data.join(queries.select("dim", "cell", "part").distinct(), ["dim", "cell", "part"], "left_semi"), queries, k, scale))

    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).where(F.size("s") >= k).select(F.col("query_id").alias("id"), F.col("s")[k - 1].cast("double").alias("kth"))
    floors = queries.drop("floor").join(kth, "id", "left")
    radius: dict[int, list[tuple[int, float, int]]] = {}
    for r in cell_rows:
        radius.setdefault(r.dim, []).append((r.cell, r.radius, parts[r.dim, r.cell]))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for dim, at in _by_length(x.column("dim").to_numpy()):
                some = x.take(pa.array(at))
                v, kth = matrix(some.column("v"), scale), np.nan_to_num(some.column("kth").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                norm, own = np.sqrt((v * v).sum(axis=1)), np.stack([some.column("cell").to_numpy(), some.column("part").to_numpy()], axis=1)
                for cell, r, n_parts in radius[dim]:
                    go = np.ones(len(at), bool)
                    if cell >= 0 and dim not in wraps:
                        c = shipped.value[dim][cell]
                        c_norm = float(np.sqrt((c * c).sum()))
                        go = v @ c + norm * r + 1e-9 * norm * (c_norm + r) + 1e-6 >= kth
                    for part in range(n_parts):
                        there = pa.array(np.flatnonzero(go & ~((own[:, 0] == cell) & (own[:, 1] == part))))
                        m = len(there)
                        if m:
                            cols = [pa.array(np.full(m, k, np.int32)) for k in (dim, cell, part)] + [some.column("id").take(there), some.column("v").take(there), pa.array(np.where(np.isinf(kth), np.nan, kth)).take(there)]
                            yield pa.RecordBatch.from_arrays(cols, ["dim", "cell", "part", "id", "v", "floor"])

    elsewhere = floors.select("id", "dim", "v", "cell", "part", "kth").mapInArrow(sent, "dim int, cell int, part int, id bigint, v array<double>, floor double")
    found = near.unionByName(_searched(data, elsewhere, k, scale))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
