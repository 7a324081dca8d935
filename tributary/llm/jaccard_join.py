"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five words. Sets that are equal are one class of copies and go on as one. A class
has ``COORDINATES`` sampled tokens: of its tokens the ones that as many hash functions put first. Two sets of similarity s
share each sampled token with probability s.

A run splits the classes recursively: at a node all members are parted by one of their sampled tokens, which the run and
the depth choose. A bucket of at most ``SMALL`` classes is not split again but compared by brute force. In a larger one
every class is compared with the first. One that is very close to it ends there. Whatever is near to that one differs from the
first by no more than both differences together, and all classes within this bound are joined to the first, so nothing is lost
by it. The others are split on the next token, ``DEPTH`` times at most, or, at the last depth, compared in blocks. A pair at the threshold t meets in a run in which a class ended at depth d with probability t**d, so what each
class has missed so far is known from the depths it reached; runs are repeated for the classes that have not reached
``recall`` until none is left.

These comparisons are of sketches (the lowest byte of each sampled token) and keep a pair whose sketches agree as often
as a pair at the threshold does, less ``SLACK`` standard deviations. Kept pairs connect clusters. Inside a cluster the
full sets are compared by brute force, every pair once: a cluster of more than ``BLOCK`` classes is dealt out by bands of
set size, of which only neighbours can hold pairs at the threshold, and bands as pairs of blocks; a task returns sums and
a spanning forest, never the pairs.

Results: ``class_id``, the least id that links lead to (a connected component), and ``n_links``, how many other documents
have a similarity of at least the threshold, copies among them.

Edge cases: a document of one to four words has one token, all of its words; one without words (null, empty) is alone in
its class and has no links. Repeated rows count as copies; rows that share an id but not a text fall into one class. Null ids form no classes (null class_id, 0 links); ids are
whole numbers. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, cut, map_texts, mix, numbered, position, table, utf8, window_hashes, word_hashes
from .components import components

COORDINATES = 128
#: Classes of a bucket that is compared by brute force, and splits of a larger one at most.
SMALL, DEPTH = 2048, 6
#: Runs that all classes take part in.
RUNS = 14
#: Classes of a cluster that one task takes together.
BLOCK = 512
SLACK = 5.5
#: Parts that the comparisons with a large bucket's first class are dealt to.
SALT = 16


def near_for(threshold: float) -> float:
    """Share of agreeing sketch bytes that a pair at the threshold falls short of only by SLACK standard deviations."""
    agree = threshold + (1 - threshold) / 256
    return max(0.0, agree - SLACK * math.sqrt(agree * (1 - agree) / COORDINATES))


def same_for(near: float) -> float:
    """How near to a bucket's first class ends a class there; at low thresholds the more, so that ``beside_for`` stays over 0."""
    return max((1 + near) / 2, 1 - near / 2)


def beside_for(near: float) -> float:
    """How near to a bucket's first class whatever is near to a class that ends there must be: sketches that differ in two
    steps differ by no more than both steps together."""
    return max(0.0, same_for(near) + near - 1)


def runs_for(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with this probability if all buckets end at this depth."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def token_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct tokens of each text, one after the other, and their offsets."""
    hashes, _, _, per = word_hashes(data, off)
    n = np.diff(per)
    grams = window_hashes(hashes, size)
    sets = []
    for d, (a, k) in enumerate(zip(per[:-1].tolist(), n.tolist(), strict=True)):
        if k >= size:
            sets.append(np.unique(grams[a : a + k - size + 1]))
        elif k:
            sets.append(window_hashes(hashes[a : a + k], k)[:1] ^ U64(k))
        else:
            sets.append(np.empty(0, U64))
    return np.concatenate(sets) if sets else np.empty(0, U64), np.cumsum([0, *map(len, sets)])


def sampled(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each non-empty set, the least value of its tokens under each of COORDINATES hash functions."""
    small, first = (tokens >> U64(32)).astype(np.uint32), off[:-1]
    rng = np.random.default_rng(20)
    odd = (rng.integers(0, 2**31, COORDINATES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    shift = rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
    out, x = np.empty((len(first), COORDINATES), np.uint32), np.empty_like(small)
    for k in range(COORDINATES):
        np.bitwise_xor(small, shift[k], out=x)
        x *= odd[k]
        out[:, k] = np.minimum.reduceat(x, first)
    return out


_SIGNATURE = "k1 bigint, k2 bigint, n_tokens bigint, sampled array<int>, sketch binary"


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Identity of each document's set, its size, its sampled tokens and their sketch."""

    def per_batch(column: pa.Array) -> list[pa.Array]:
        data, off = utf8(column)
        n = len(off) - 1
        k = np.zeros((2, n), U64)
        count, least = np.zeros(n, np.int64), np.zeros((n, COORDINATES), np.uint32)
        for a, b in chunks(off):
            tokens, o = token_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
            count[a:b] = np.diff(o)
            full = np.flatnonzero(count[a:b])
            if not len(full):
                continue
            o = np.append(o[:-1][full], len(tokens))
            k[0, a + full] = np.add.reduceat(mix(tokens + U64(1)), o[:-1])
            k[1, a + full] = np.add.reduceat(mix(tokens ^ U64(0x5851F42D4C957F2D)), o[:-1])
            least[a + full] = sampled(tokens, o)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * COORDINATES, pa.int32()), pa.array(least.ravel().view(np.int32)))
        sketches = pa.array([row.tobytes() for row in least.astype(np.uint8)], pa.binary())
        return [pa.array(k[0].view(np.int64)), pa.array(k[1].view(np.int64)), pa.array(count), lists, sketches]

    return map_texts(docs.withColumnRenamed(id_col, "id"), text_col, ["id"], _SIGNATURE, per_batch)


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal bytes of pairs of sketches."""
    return (left == right).mean(axis=1)


def agreements(sketches: np.ndarray) -> np.ndarray:
    """The number of equal bytes of every two of some sketches."""
    n = len(sketches)
    out = np.zeros((n, n), np.uint8)
    for column in np.ascontiguousarray(sketches.T):
        out += column[:, None] == column[None, :]
    return out


def shared_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share; a token that only one set has is not counted on the diagonal."""
    n = len(sets)
    shared = np.zeros((n, n))
    tokens, who = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    who, column = who[keep], (np.cumsum(often) - 1)[column[keep]]
    wide = int(often.sum())
    width = min(max(256, 8_000_000 // n), wide)
    for at in range(0, wide, max(1, width)):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[who[a:b], column[a:b] - at] = 1
        shared += m @ m.T
    return shared


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    n = len(linked)
    root = np.arange(n)
    while True:  # labels fall to the least of the neighbours', then jump
        new = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def sketch_rows(column: pa.Array) -> np.ndarray:
    """Sketches of a batch as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), COORDINATES)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the keys and the edges of their groups; a group never lies in two of these tables."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])

    for x in batches:
        if not x.num_rows:
            continue
        held.append(x)
        whole = pa.Table.from_batches(held).combine_chunks()
        at = edges(whole)
        if len(at) > 2:
            last = int(at[-2])
            yield whole.slice(0, last), at[:-1]
            held = whole.slice(last).combine_chunks().to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, edges(whole)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n things the least one of its component, by the pairs (a, b): labels fall to the least, then jump."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def bucket_forest(sizes: np.ndarray, sketches: np.ndarray, edges: np.ndarray, near: float, threshold: float) -> np.ndarray:
    """For each row the least row of its component of near sketches and fitting set sizes inside its bucket, by brute
    force; rows of a bucket lie together."""
    many, pairs = np.diff(edges), []
    fits = lambda x, y: np.minimum(sizes[x], sizes[y]) >= threshold * np.maximum(sizes[x], sizes[y]) - 1e-9
    for m in np.unique(many[(many > 1) & (many <= 16)]).tolist():
        i, j = np.triu_indices(m, 1)
        begin = edges[:-1][many == m]
        step = max(1, 200_000 // len(i))
        for at in range(0, len(begin), step):
            x, y = (begin[at : at + step, None] + i).ravel(), (begin[at : at + step, None] + j).ravel()
            good = fits(x, y)
            x, y = x[good], y[good]
            good = agreement(sketches[x], sketches[y]) >= near
            pairs.append((x[good], y[good]))
    for lo, hi in zip(edges[:-1][many > 16].tolist(), edges[1:][many > 16].tolist(), strict=True):
        x, y = np.nonzero(np.triu(agreements(sketches[lo:hi]) >= near * COORDINATES, 1))
        good = fits(lo + x, lo + y)
        pairs.append((lo + x[good], lo + y[good]))
    a, b = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
    return forest(a, b, len(sizes))


_EDGE = "a bigint, b bigint"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def small_edges(members: DataFrame, near: float, threshold: float) -> DataFrame:
    """A spanning forest of what is near inside each small bucket (path, rep, n_tokens, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_groups(batches, ["path"]):
            ids, sizes = t.column("rep").to_numpy(), t.column("n_tokens").to_numpy()
            root = bucket_forest(sizes, sketch_rows(t.column("sketch")), edges, near, threshold)
            yield _edges(ids[root[root != np.arange(len(ids))]], ids[root != np.arange(len(ids))])

    ordered = members.select("path", "rep", "n_tokens", "sketch").repartition("path").sortWithinPartitions("path", "rep")
    return ordered.mapInArrow(run, _EDGE).distinct()


def compared_with_first(members: DataFrame) -> DataFrame:
    """(…, a, close) of the members (path, rep, sketch, …) of large buckets but the first one, a: how close they are to it.

    A bucket's members are dealt to ``SALT`` parts, and so is its first one."""
    first = members.groupBy("path").agg(F.min(F.struct("rep", "sketch")).alias("f")).select("path", F.col("f.rep").alias("a"), F.col("f.sketch").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    met = members.withColumn("salt", F.pmod(F.hash("rep"), F.lit(SALT))).join(first, ["path", "salt"]).where("rep <> a").drop("salt")
    kept = [c for c in met.columns if c != "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                close = agreement(sketch_rows(x.column("first")), sketch_rows(x.column("sketch")))
                yield pa.RecordBatch.from_arrays([x.column(c) for c in kept] + [pa.array(close)], [*kept, "close"])

    schema = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in kept)
    return met.mapInArrow(run, f"{schema}, close double")


def rest_edges(compared: DataFrame, near: float) -> DataFrame:
    """A spanning forest of near sketches among the classes of each bucket that do not end at its first one: those that
    are near to it without standing for it and those that are far from it are compared with the far ones, in blocks."""
    rest = compared.where(F.col("close") < same_for(near)).select("path", F.col("rep").alias("b"), "sketch", (F.col("close") < near).alias("far"))
    count = rest.groupBy("path").agg(F.count_if("far").alias("n_far"), F.count("*").alias("n")).where("n_far > 0 and n > 1")
    f_blocks, r_blocks = (F.ceil(n / BLOCK).cast("int") for n in (F.col("n_far"), F.col("n") - F.col("n_far")))
    rest = rest.join(count.select("path", f_blocks.alias("fb"), r_blocks.alias("rb")), "path")
    block = F.when(F.col("far"), F.pmod(F.hash("b"), "fb")).otherwise(F.col("fb") + F.pmod(F.hash("b"), F.greatest("rb", F.lit(1))))
    # far blocks meet all blocks, the other blocks only the far ones
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("far"), F.col("fb") + F.col("rb")).otherwise(F.col("fb")) - 1)).alias("other")
    dealt = rest.withColumn("block", block).select("*", other).select("path", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "b", "far", (F.col("block") > F.col("other")).cast("int").alias("side"), "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_groups(batches, ["path", "b1", "b2"]):
            ids, far, side, sketches = t.column("b").to_numpy(), t.column("far").to_numpy(), t.column("side").to_numpy(), sketch_rows(t.column("sketch"))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                linked = agreements(sketches[x:y]) >= near * COORDINATES
                linked &= far[x:y, None] | far[None, x:y]
                if side[x:y].any():
                    linked &= side[x:y, None] != side[None, x:y]
                root, at = roots_of(linked), np.arange(y - x)
                if (root != at).any():
                    yield _edges(ids[x:y][root[root != at]], ids[x:y][root != at])

    return dealt.repartition("path", "b1", "b2").sortWithinPartitions("path", "b1", "b2", "b").mapInArrow(run, _EDGE)


def _token(run: Column, depth: int) -> Column:
    """Which sampled token a run splits on at a depth: a different one at each depth of a run."""
    start, step = F.pmod(F.xxhash64(run, F.lit("start")), F.lit(COORDINATES)), 2 * F.pmod(F.xxhash64(run, F.lit("step")), F.lit(COORDINATES // 2)) + 1
    return F.get("sampled", F.pmod(start + depth * step, F.lit(COORDINATES)).cast("int"))


def split_runs(classes: DataFrame, sketch: DataFrame, runs: range, near: float, threshold: float) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(small, edges, missed) of some runs over classes (rep, sampled): members (path, rep) of small buckets with more than
    one class, near edges in large ones, and what each class that was split again loses by that:
    log((1 - t**d) / (1 - t))."""
    run = F.explode(F.sequence(F.lit(runs.start), F.lit(runs.stop - 1))).alias("run")
    deeper = F.array(*[_token(F.col("run"), d) for d in range(2, DEPTH + 1)]).alias("tokens")
    state = classes.select("rep", "sampled", run).select("rep", F.xxhash64("run", _token(F.col("run"), 1)).alias("path"), deeper)
    small, edges, missed = [], [], []
    for depth in range(1, DEPTH + 1):
        n = state.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        state = cut(state.join(n, "path"))
        small.append(state.where(F.col("n") <= SMALL).select("path", "rep"))
        state = state.where(F.col("n") > SMALL).drop("n")
        if state.isEmpty():
            break
        compared = cut(compared_with_first(state.join(sketch.select("rep", "sketch"), "rep")))
        edges.append(compared.where(F.col("close") >= beside_for(near)).select("a", F.col("rep").alias("b")))
        if depth == DEPTH:
            edges.append(rest_edges(compared, near))
            break
        state = compared.where(F.col("close") < same_for(near)).select("rep", "path", "tokens")
        missed.append(state.groupBy("rep").agg((F.count("*") * math.log((1 - threshold ** (depth + 1)) / (1 - threshold**depth))).alias("loss")))
        state = state.select("rep", F.xxhash64("path", F.get("tokens", F.lit(depth - 1))).alias("path"), "tokens")
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    lost = union(missed).groupBy("rep").agg(F.sum("loss").alias("loss")) if missed else classes.select("rep", F.lit(0.0).alias("loss")).where("false")
    return union(small), edges, lost


def near_edges(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(a, b) of classes (rep, n_tokens, sampled, sketch) that connect whatever may reach the threshold."""
    near, owed = near_for(threshold), math.log(1 - recall)
    sketch = classes.select("rep", "n_tokens", "sketch")
    alive, runs, found = classes.select("rep", "sampled", F.lit(0.0).alias("had")), range(0, RUNS), []
    while len(runs):
        small, edges, lost = split_runs(alive, sketch, runs, near, threshold)
        found += [small_edges(small.join(sketch, "rep"), near, threshold), *edges]
        had = F.col("had") + len(runs) * math.log(1 - threshold) + F.coalesce("loss", F.lit(0.0))
        alive = cut(alive.join(lost, "rep", "left").select("rep", "sampled", had.alias("had")).where(F.col("had") > owed))
        left = alive.agg(F.max("had")).collect()[0][0]
        runs = range(0) if left is None else range(runs.stop, runs.stop + math.ceil((owed - left) / math.log(1 - threshold**DEPTH)))
    return functools.reduce(DataFrame.unionByName, found)


def links(ids: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a group, the copies of the members linked to it, and the root of its tree in a spanning forest.

    ``across``: only pairs of members of different sides count.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    shared = np.zeros((n, n))
    if n == 2:
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        shared = shared_tokens(sets)
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if across:
        linked &= side[:, None] != side[None, :]
    return linked @ copies, ids[roots_of(linked)]


def dealt_members(cluster: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(id, copies, cluster, key, side): each cluster member once for each group of members that it meets.

    A cluster of at most BLOCK members is one group. A larger one is parted into bands of set size, so that sets of
    bands that are no neighbours differ by more than the threshold allows, and into blocks inside these.
    """
    band = F.floor(F.log(F.col("n_tokens").cast("double")) / (math.log(1 / threshold) * (1 + 1e-6))).cast("int") if threshold < 1 else F.col("n_tokens").cast("int")
    n = cluster.groupBy("root").agg(F.count("*").alias("n"))
    members = cluster.join(n, "root").join(classes.select(F.col("rep").alias("id"), "copies", "n_tokens"), "id").select("id", "copies", F.col("root").alias("cluster"), F.when(F.col("n") > BLOCK, band).otherwise(0).alias("band"))
    sizes = members.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    beside = sizes.select("cluster", F.col("band").alias("o_band"), F.col("blocks").alias("o_blocks"), F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    meets = sizes.join(beside, ["cluster", "band"]).groupBy("cluster", "band", "blocks").agg(F.collect_list(F.struct("o_band", "o_blocks")).alias("others"))
    placed = members.join(meets, ["cluster", "band"]).withColumn("block", F.pmod(F.hash("id"), "blocks")).select("id", "copies", "cluster", "band", "block", F.explode("others").alias("o"))
    placed = placed.select("id", "copies", "cluster", "band", "block", "o.o_band", F.explode(F.sequence(F.lit(0), F.col("o.o_blocks") - 1)).alias("o_block"))
    mine, its = F.struct("band", "block"), F.struct(F.col("o_band").alias("band"), F.col("o_block").alias("block"))
    return placed.select("id", "copies", "cluster", F.xxhash64(F.least(mine, its), F.greatest(mine, its)).alias("key"), F.when(mine < its, 0).when(mine > its, 1).otherwise(2).alias("side"))


def cluster_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """(id, linked, root) of cluster members, one row for each group that a member is in."""

    def per_batch(column: pa.Array) -> list[pa.Array]:
        data, off = utf8(column)
        out = []
        for a, b in chunks(off):
            tokens, o = token_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
            out += [tokens[x:y].tobytes() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
        return [pa.array(out, pa.binary())]

    groups = members.groupBy("id", "copies").agg(F.collect_list(F.struct("cluster", "key", "side")).alias("groups"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(groups, "id")
    sets = map_texts(texts, "text", ["id", "copies", "groups"], "tokens binary", per_batch)
    dealt = sets.select("id", "copies", "tokens", F.explode("groups").alias("g")).select("g.cluster", "g.key", "g.side", "id", "copies", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t, edges in whole_groups(batches, ["cluster", "key"]):
            names = np.concatenate([t.column(c).to_numpy()[:, None] for c in ("cluster", "key", "id")], axis=1)
            once = np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])  # rows that repeat an id are one member
            t, edges = t.filter(pa.array(once)), np.concatenate([[0], np.cumsum(once)])[edges]
            ids, side, copies, tokens = t.column("id").to_numpy(), t.column("side").to_numpy(), t.column("copies").to_numpy(), t.column("tokens")
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if y - x > 1:
                    sets = [np.frombuffer(r, U64) for r in tokens.slice(x, y - x).to_pylist()]
                    done.append((ids[x:y], *links(ids[x:y], side[x:y], copies[x:y], sets, bool(side[x] != 2), threshold)))
                if len(done) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done, strict=True)], ["id", "linked", "root"])
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done, strict=True)], ["id", "linked", "root"])

    ordered = dealt.repartition("cluster", "key").sortWithinPartitions("cluster", "key", "id", "tokens")
    return ordered.mapInArrow(run, "id bigint, linked bigint, root bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999999) -> DataFrame:
    """``class_id`` and ``n_links`` of each document."""
    by_place = numbered(docs)
    docs = by_place.select(by_place[f"__{position(docs, id_col)}"].cast("bigint").alias("doc_id"), by_place[f"__{position(docs, text_col)}"].cast("string").alias("text"))
    signed = cut(signatures(docs, "doc_id", "text", size))
    classes = cut(
        signed.where("n_tokens > 0 and id is not null").groupBy("k1", "k2", "n_tokens").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sampled").alias("sampled"), F.first("sketch").alias("sketch"))
    )
    cluster = cut(components(near_edges(classes, min(threshold, 1 - 1e-9), recall)))
    found = cut(cluster_links(docs, dealt_members(cluster, classes, threshold), "doc_id", "text", size, threshold))
    linked = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    roots = components(found.where("root <> id").select(F.col("root").alias("a"), F.col("id").alias("b")))
    named = classes.select("k1", "k2", "n_tokens", "rep", "copies").join(linked.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("k1", "k2", "n_tokens", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return (
        signed.select(F.col("id").alias("doc_id"), "k1", "k2", "n_tokens")
        .join(named, ["k1", "k2", "n_tokens"], "left")
        .select("doc_id", F.when(F.col("n_tokens") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"))
    )


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of which no other in the class has a smaller id; columns as they came.

    Documents without an id belong to no class and stay; rows that repeat an id stay or go together.
    """
    later = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__later")).distinct()
    by_place = numbered(docs)
    return by_place.join(later, by_place[f"__{position(docs, id_col)}"] == later["__later"], "left_anti").toDF(*docs.columns)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
