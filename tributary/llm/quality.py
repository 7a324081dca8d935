"""Quality classifier: a generalised additive model with pairwise interactions.

A text is measured by ``FEATURES``: counts of characters by class, words, lines, repeats and a compressed size, all over
the whole text. Each feature is cut into bins at quantiles of the training rows. Cyclic boosting goes round the features
many times; each visit fits a shallow tree (``LEAVES`` leaves) of the loss's gradients over the one feature's bins and adds
a small step of it to that feature's lookup table. Then the pairs of features whose best cut into four lowers the loss
most are boosted in the same way, on tables over two features' bins. A share of the rows is held back and tells which
round is the best. The score is the logistic function of the intercept and one table entry for each feature and pair, so
a batch is scored by looking up bins and adding.

Fitting reads a bounded sample: the ``sample_rows`` labelled ids of smallest hash, sent to the tasks as ids, whose texts
are measured where they lie; only measures come to the driver (``sample_rows`` rows at most, however often ids repeat).
An id labelled several times has the mean of its labels. Scoring reads every whole text and nothing else.

Edge cases: null and empty texts are measured as texts without characters and get a score. Rows without id are not held
out and teach nothing. Without labelled rows every score is 0.5; where all labels are equal, it is the same for all. A
run of over ``PIECE`` bytes without a separator counts as several words. Repeated rows give repeated rows. A kept column
with a result's name gives way to the result. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, map_texts, mix, numbered, position, powers, table, utf8, words

FEATURES = (
    "characters", "words", "word_length", "short_words", "long_words", "upper", "digits", "symbols", "stops", "shouts", "non_ascii", "controls",
    "lines", "stopped_words", "repeated_next", "distinct_words", "distinct_pairs", "distinct_lines", "commonest", "compressed",
)
PIECE = 1 << 20
BINS, PAIR_BINS, LEAVES = 32, 12, 4

# Classes of bytes: letters A-Z, digits, sentence stops, "!" and "?", other ASCII signs, control characters.
_UPPER, _DIGIT, _STOP, _SHOUT, _SYMBOL, _CONTROL = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:'\"()-"]] = _SHOUT[[ord(c) for c in "!?"]] = True
_CONTROL[:32] = _CONTROL[127] = True
_CONTROL[[9, 10, 13]] = False
_SYMBOL[33:127] = True
_SYMBOL &= ~(_UPPER | _DIGIT | _STOP | _SHOUT)
_SYMBOL[97:123] = False
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False


def _hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans by one lane of prefix sums; equal for equal contents."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values))[0][: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(len(values))[1][start] + (end - start).astype(U64))


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, how many distinct hashes it has, and how often its commonest one stands."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(h))))
    return np.bincount(o[first], minlength=n).astype(np.float64), most.astype(np.float64)


def _pieces(data: np.ndarray, lo: int, hi: int) -> list[int]:
    """Where a text's pieces of at most PIECE bytes begin: behind a separator if there is one, at a character's start else."""
    cuts = [lo]
    while hi - cuts[-1] > PIECE:
        window = data[cuts[-1] : cuts[-1] + PIECE]
        back = np.flatnonzero(window[-65536:] <= 32)
        at = cuts[-1] + (PIECE - min(65536, PIECE) + int(back[-1]) + 1 if len(back) else PIECE - 4 + int(np.flatnonzero(_STARTS[window[-4:]])[-1]))
        cuts.append(at)
    return cuts


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The measures of some texts, one row each."""
    n = len(offsets) - 1
    begins = [_pieces(data, lo, hi) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    owner = np.repeat(np.arange(n), [len(b) for b in begins])
    cuts = [c for b in begins for c in b]
    edges = np.append(np.array(cuts, np.int64), offsets[-1])
    sums = np.zeros((n, 9))
    word_h, word_o, line_h, line_o = [], [], [], []
    for lo, hi in chunks(edges, PIECE):
        part, own = data[edges[lo] : edges[hi]], owner[lo:hi]
        rel = edges[lo : hi + 1] - edges[lo]
        for k, kind in enumerate((_STARTS, _UPPER, _DIGIT, _SYMBOL, _STOP, _SHOUT, _CONTROL)):
            total = np.concatenate([[0], np.cumsum(kind[part])])
            np.add.at(sums[:, k], own, total[rel[1:]] - total[rel[:-1]])
        low, start, end, per = words(part, rel)
        of = np.repeat(own, np.diff(per))
        size = end - start
        np.add.at(sums[:, 7], of, size)
        np.add.at(sums[:, 8], of, ((end < len(part)) & np.isin(part[np.minimum(end, max(0, len(part) - 1))], [33, 44, 46, 58, 59, 63])).astype(np.int64))
        word_h.append((_hashes(low, start, end), size))
        word_o.append(of)
        breaks = np.union1d(np.flatnonzero(part == 10) + 1, rel)
        breaks = breaks[breaks <= len(part)]
        a, b = breaks[:-1], breaks[1:]
        b = np.where((b > a) & (part[b - 1] == 10), b - 1, b) if len(part) else b
        full = b > a
        line_h.append(_hashes(part, a[full], b[full]))
        line_o.append(own[np.searchsorted(rel, a[full], "right") - 1])
    wh, size, wo = np.concatenate([h for h, _ in word_h]), np.concatenate([s for _, s in word_h]), np.concatenate(word_o)
    lh, lo_ = np.concatenate(line_h), np.concatenate(line_o)
    n_words = np.bincount(wo, minlength=n).astype(np.float64)
    n_lines = np.bincount(lo_, minlength=n).astype(np.float64)
    together = wo[1:] == wo[:-1]
    n_pairs = np.bincount(wo[1:][together], minlength=n).astype(np.float64)
    same = np.bincount(wo[1:][together & (wh[1:] == wh[:-1])], minlength=n)
    distinct, commonest = _distinct(wh, wo, n)
    pairs, _ = _distinct(mix(wh[:-1] * U64(3) ^ wh[1:])[together], wo[1:][together], n)
    lines, _ = _distinct(lh, lo_, n)
    n_bytes = np.diff(offsets).astype(np.float64)
    squeezed = np.array([len(zlib.compress(data[a:b], 1)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.float64)
    chars, per_word, per_char = sums[:, 0], np.maximum(1, n_words), np.maximum(1, sums[:, 0])
    short, long = (np.bincount(wo[m], minlength=n) for m in (size <= 3, size >= 12))
    return np.stack([
        np.log1p(chars), np.log1p(n_words), sums[:, 7] / per_word, short / per_word, long / per_word, sums[:, 1] / per_char, sums[:, 2] / per_char,
        sums[:, 3] / per_char, sums[:, 4] / per_word, sums[:, 5] / per_word, (n_bytes - chars) / per_char, sums[:, 6] / per_char, n_lines / per_word,
        sums[:, 8] / per_word, same / per_word, distinct / per_word, pairs / np.maximum(1, n_pairs), lines / np.maximum(1, n_lines), commonest / per_word,
        squeezed / np.maximum(1, n_bytes),
    ], axis=1)


def measures(column: pa.Array) -> np.ndarray:
    """The features of each text of a string column, one row each."""
    data, offsets = utf8(column)
    out = [_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets, PIECE)]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


class Model(NamedTuple):
    """Intercept; for each feature bin edges and a table; for each pair (i, j, edges of i, edges of j, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], "right")]
        for i, j, a, b, values in self.pairs:
            total += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles, each between two different values."""
    v = np.unique(values)
    if len(v) <= bins:
        return (v[1:] + v[:-1]) / 2
    at = np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf")
    return np.unique((at + v[np.minimum(np.searchsorted(v, at, "right"), len(v) - 1)]) / 2)


def _gain(g, h):
    return g * g / (h + 1.0)


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of the tree that splits, again and again, the range whose best cut lowers the loss most."""
    ranges, cg, ch = [(0, len(g))], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        at = np.arange(lo + 1, hi)
        left, right = _gain(cg[at] - cg[lo], ch[at] - ch[lo]), _gain(cg[hi] - cg[at], ch[hi] - ch[at])
        gains = left + right - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo])
        k = int(gains.argmax())
        return float(gains[k]), int(at[k])

    cuts = [best(*ranges[0])]
    while len(ranges) < leaves:
        k = max(range(len(ranges)), key=lambda i: cuts[i][0])
        if cuts[k][0] <= 1e-9:
            break
        (lo, hi), at = ranges[k], cuts[k][1]
        ranges[k : k + 1] = [(lo, at), (at, hi)]
        cuts[k : k + 1] = [best(lo, at), best(at, hi)]
    out = np.zeros(len(g))
    for lo, hi in ranges:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1.0)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by cell of the best cut of a two-way table into four, and what it lowers the loss by."""
    cg, ch = (np.pad(m.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for m in (g, h))
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    quarters = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    gs, hs = quarters(cg), quarters(ch)
    gains = sum(_gain(a, b) for a, b in zip(gs, hs, strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    value = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(gs, hs, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, float(gains[i, j])


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, held_back: float = 0.15, patience: int = 20) -> Model:
    """The model of measured rows and their labels (0 to 1); rows are in a random order that is the same each time."""
    n = len(x)
    if not n:
        return Model(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    mean = (y.sum() + 0.5) / (n + 1)
    intercept = float(np.log(mean / (1 - mean)))
    edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if y.min() == y.max():
        return Model(intercept, edges, tables, [])
    kept = np.arange(n) >= int(n * held_back)
    test = ~kept if int(n * held_back) >= 50 else kept
    total = np.full(n, intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.where(kept, y - p, 0.0), np.where(kept, p * (1 - p), 0.0)

    def loss() -> float:
        t = total[test]
        return float((np.logaddexp(0, t) - y[test] * t).mean())

    def boost(visits: list, most: int) -> None:
        """Go round the visits; tables end as they were in the best round."""
        best, since, state = loss(), 0, None
        for _ in range(most):
            for visit in visits:
                visit()
            now = loss()
            if now < best - 1e-6:
                best, since, state = now, 0, ([t.copy() for t in grown], total.copy())
            else:
                since += 1
            if since >= patience:
                break
        for t, old in zip(grown, state[0] if state else [np.zeros_like(t) for t in grown], strict=True):
            t[:] = old
        total[:] = state[1] if state else before

    def main(k: int):
        def visit() -> None:
            g, h = slopes()
            size = len(tables[k])
            step = rate * tree_1d(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), LEAVES)
            tables[k][:] += step
            total[:] += step[bins[k]]

        return visit

    grown, before = tables, total.copy()
    boost([main(k) for k in range(len(tables))], rounds)

    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def table_of(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cells[i] * shape[1] + cells[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-tree_2d(table_of(i, j, g), table_of(i, j, h))[1], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])))
    chosen = [(i, j) for gain, i, j in ranked[:pairs] if gain < 0]
    surfaces = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]

    def crossed(m: int):
        i, j = chosen[m]

        def visit() -> None:
            g, h = slopes()
            step = rate * tree_2d(table_of(i, j, g), table_of(i, j, h))[0]
            surfaces[m][:] += step
            total[:] += step[cells[i], cells[j]]

        return visit

    grown, before = surfaces, total.copy()
    if chosen:
        boost([crossed(m) for m in range(len(chosen))], pair_rounds)
    return Model(intercept, edges, tables, [(i, j, coarse[i], coarse[j], s) for (i, j), s in zip(chosen, surfaces, strict=True)])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 20_000, **boosting) -> Model:
    """The model of the labelled ids of smallest hash."""
    by_place = numbered(labels)
    pick = lambda c: by_place[f"__{position(labels, c)}"]
    marks = by_place.select(pick(id_col).alias("id"), pick(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    marks = marks.groupBy("id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = numbered(docs)
    rows = texts.select(texts[f"__{position(docs, id_col)}"].alias("id"), texts[f"__{position(docs, text_col)}"].cast("string").alias("text"))
    rows = rows.join(F.broadcast(marks), "id").select("id", "y", "text")  # sample_rows ids at most

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 500):
                some = x.slice(at, 500)
                m = measures(some.column("text"))
                yield pa.RecordBatch.from_arrays([some.column("y"), pa.array(list(m), pa.list_(pa.float64()))], ["y", "x"])

    sample = rows.mapInArrow(measured, "y double, x array<double>").orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample_rows).collect()
    x = np.array([r.x for r in sample], np.float64).reshape(len(sample), len(FEATURES))
    return fitted(x, np.clip(np.array([r.y for r in sample], np.float64), 0, 1), **boosting)


RESULTS = "score double, predicted int"


def classify(df: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Score and prediction of each text; no shuffle."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # some hundred numbers for each feature and pair

    def per_batch(column: pa.Array) -> list[pa.Array]:
        score = shipped.value.score(measures(column))
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return map_texts(df, text_col, df.columns if keep is None else keep, RESULTS, per_batch)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows of remainder 0 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op13_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(F.coalesce(fold() != 0, F.lit(False))))
    out = classify(docs.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted")
