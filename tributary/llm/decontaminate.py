"""Benchmark decontamination with one FM-index for each training shard.

A shard is the documents of one Arrow batch. Its words become vocabulary numbers; only stretches of at least as many
words as the shortest window, all of them benchmark words, can hold an occurrence, so these stretches, parted by unique
separators, are the text that is indexed. The index is the Burrows-Wheeler transform of that text as a wavelet matrix,
with every ``SAMPLE``-th suffix position kept. All distinct windows are searched at once, last word first, each step
narrowing the suffix intervals by wavelet ranks; occurrences are located by stepping back to a kept position. Covered
words of a document are merged to spans.

The benchmark is taken in parts of at most ``part_chars`` characters. A part is collected and broadcast, the documents pass
through one stage that adds what it hits, and what was found is written to the shared checkpoint folder before the next part
is read. So neither a task nor the driver holds more than one part.

Words are compared by 64-bit hashes of two lanes. Edge cases: null and empty texts have no words and no hits; an item
without words has no window; an item of fewer than ``size`` words is one window; items with the same text all count. Items
without an id are one item of an empty id. Repeated document rows give repeated rows. An empty table gives no rows. Columns not named in ``keep`` do not appear; a kept column with a result's name gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, chunks, cut, numbered, position, ranges, table, utf8, word_hashes

SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit of the symbols at a level, the highest first."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels, seq = [], seq.copy()
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def ranks(self, symbols: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """For each array of ends, how often each symbol stands before its end."""
        first, ends = np.zeros(len(symbols), np.int64), list(ends)
        for b, ones, zeros in self.levels:
            up = ((symbols >> b) & 1).astype(bool)
            moved = [np.where(up, zeros + ones[e], e - ones[e]) for e in (first, *ends)]
            first, ends = moved[0], moved[1:]
        return [e - first for e in ends]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``text`` has unique separators, so ranks become distinct after few rounds."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        if width < n:
            after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Full-text index over a sequence of numbers of 1.. (words) in which 0 is a separator."""

    def __init__(self, text: np.ndarray, vocabulary: int):
        gap = text == 0
        unique = text + int(gap.sum())
        unique[gap] = np.arange(int(gap.sum()))
        order = suffix_order(unique)
        self.bwt = text[order - 1]  # the character before the first suffix is the last one, a separator
        self.less = np.zeros(vocabulary + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=vocabulary + 1), out=self.less[1:])
        self.wavelet = WaveletMatrix(self.bwt, max(1, vocabulary.bit_length()))
        kept = order % SAMPLE == 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions = kept, order[kept]
        self.at_start = self.bwt == 0
        self.starts = order[self.at_start]
        self.start_before = np.concatenate([[0], np.cumsum(self.at_start)])
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (rows): those that occur, and their suffix intervals."""
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            a, b = self.wavelet.ranks(c, lo, hi)
            lo, hi = self.less[c] + a, self.less[c] + b
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back by LF until a kept position or the start of a stretch is met."""
        out, todo, steps = np.full(len(rows), -1, np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            kept = self.kept[rows]
            out[todo[kept]] = self.positions[self.kept_before[rows[kept]]] + steps
            start = self.at_start[rows] & ~kept
            out[todo[start]] = self.starts[self.start_before[rows[start]]] + steps
            go = ~kept & ~start
            todo, rows = todo[go], rows[go]
            c = self.bwt[rows]
            rows = self.less[c] + self.wavelet.ranks(c, rows)[0] if len(rows) else rows
            steps += 1
        return out


class Windows:
    """The windows of one benchmark part."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        data, off = utf8(pa.array([t for _, t in items], pa.string()))
        hashes, _, _, per = word_hashes(data, off)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        found: dict[tuple[int, ...], set[int]] = {}
        for k in range(len(items)):
            w = tuple((numbers[per[k] : per[k + 1]] + 1).tolist())
            for at in range(max(1, len(w) - size + 1) if w else 0):
                found.setdefault(w[at : at + size], set()).add(k)
        self.ids = [i for i, _ in items]
        self.groups = []  # (length, patterns, the items of each)
        for n in sorted({len(p) for p in found}):
            rows = [p for p in found if len(p) == n]
            self.groups.append((n, np.array(rows, np.int64), [sorted(found[p]) for p in rows]))
        self.shortest = self.groups[0][0] if self.groups else 0
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1; 0 for other words."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[some])
        at[at == len(self.vocabulary)] = 0
        good = self.vocabulary[at] == hashes[some]
        out[some[good]] = at[good] + 1
        return out


def find(windows: Windows, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Word counts of a shard's texts, and for those with hits the merged spans of word numbers and the item ids."""
    counts = np.zeros(len(off) - 1, np.int64)
    texts, place_doc, place_word = [], [], []
    for a, b in chunks(off):
        hashes, _, _, per = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        counts[a:b] = np.diff(per)
        if not windows.shortest or not len(hashes):
            continue
        n = windows.numbers(hashes)
        doc = np.repeat(np.arange(a, b), np.diff(per))
        known = n > 0
        new = np.ones(len(n), bool)
        new[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(n)))
        good = known[start] & (length >= windows.shortest)
        start, length = start[good], length[good]
        if len(start):
            # each stretch with a separator behind it
            at = ranges(start, length + 1)
            last = np.cumsum(length + 1) - 1
            at[last] = start
            piece = n[at]
            piece[last] = 0
            texts.append(piece)
            place_doc.append(doc[at])
            place_word.append(at - per[doc[at] - a])
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    if not texts:
        return counts, spans, items
    index = FMIndex(np.concatenate(texts), len(windows.vocabulary))
    docs, word = np.concatenate(place_doc), np.concatenate(place_word)
    hits: list[tuple[int, int, int]] = []
    for n, patterns, owners in windows.groups:
        which, lo, hi = index.search(patterns)
        if not len(which):
            continue
        at = index.locate(ranges(lo, hi - lo))
        which = np.repeat(which, hi - lo)
        for p, d, w in zip(which.tolist(), docs[at].tolist(), word[at].tolist(), strict=True):
            hits.append((d, w, w + n))
            items.setdefault(d, set()).update(windows.ids[k] for k in owners[p])
    for d, a, b in sorted(hits):
        mine = spans.setdefault(d, [])
        if mine and a <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(b, mine[-1][1]))
        else:
            mine.append((a, b))
    return counts, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_STATE = "__words bigint, __spans array<bigint>, __items array<string>"


def _stage(df: DataFrame, windows) -> DataFrame:
    """Adds what one part's windows hit to the state columns."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for b in batches:
            if not b.num_rows:
                continue
            counts, spans, items = find(w, *utf8(b.column("__text")))
            old_spans, old_items = b.column("__spans").to_pylist(), b.column("__items").to_pylist()
            for d, mine in spans.items():
                flat = old_spans[d]
                old_spans[d] = [x for s in merged(mine + list(zip(flat[::2], flat[1::2], strict=True))) for x in s]
                old_items[d] = sorted(items[d].union(old_items[d]))
            made = {"__words": pa.array(counts, pa.int64()), "__spans": pa.array(old_spans, pa.list_(pa.int64())), "__items": pa.array(old_items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(c, b.column(c)) for c in names], names)

    return df.mapInArrow(run, df.schema)


def parts(benchmark: DataFrame, id_col: str, text_col: str, part_chars: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's (id as text, text) in parts of about ``part_chars`` characters, at least one."""
    by_place = numbered(benchmark)
    item, text = (by_place[f"__{position(benchmark, c)}"].cast("string") for c in (id_col, text_col))
    rows = by_place.select(F.coalesce(item, F.lit("")).alias("i"), text.alias("t"))
    total = rows.agg(F.sum(F.length("t"))).collect()[0][0] or 0
    n = max(1, -(-total // part_chars))
    for k in range(n):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "items"]


def _hits(df: DataFrame, kept: list[int], benchmark: DataFrame, text_col: str, item_id_col: str, item_text_col: str, size: int, part_chars: int) -> DataFrame:
    """Columns of ``df`` by place, as __keep0, __keep1, ..., and the state columns after all parts."""
    by_place = numbered(df)
    state = by_place.select(
        *[by_place[f"__{i}"].alias(f"__keep{k}") for k, i in enumerate(kept)],
        by_place[f"__{position(df, text_col)}"].cast("string").alias("__text"),
        F.lit(0).cast("bigint").alias("__words"),
        F.array().cast("array<bigint>").alias("__spans"),
        F.array().cast("array<string>").alias("__items"),
    )
    for k, items in enumerate(parts(benchmark, item_id_col, item_text_col, part_chars)):
        state = cut(state) if k else state
        state = _stage(state, df.sparkSession.sparkContext.broadcast(Windows(items, size)))
    return state


def scan(df: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_id_col: str = "item_id", item_text_col: str = "text", size: int = 10, part_chars: int = 8_000_000) -> DataFrame:
    """Words, hit words and items with occurring windows of each document; ``hit_spans`` are pairs of word numbers."""
    keep = carried(df.columns if keep is None else keep, RESULTS)
    state = _hits(df, [position(df, c) for c in keep], benchmark, text_col, item_id_col, item_text_col, size, part_chars)
    hit = F.aggregate(F.transform("__spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return state.select(
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
        F.col("__spans").alias("hit_spans"),
        F.col("__items").alias("items"),
    )


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 10, part_chars: int = 8_000_000) -> DataFrame:
    """The documents that no window of the benchmark hits; columns as they came, whatever their names."""
    state = _hits(df, list(range(len(df.columns))), benchmark, text_col, item_id_col, item_text_col, size, part_chars)
    return state.where(F.size("__spans") == 0).select(*[f"__keep{i}" for i in range(len(df.columns))]).toDF(*df.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.drop("hit_spans", "items")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark),
v AS (SELECT DISTINCT item, w[s:s + 9] AS win FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT len(win) AS n FROM v),
p AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, l WHERE len(w) >= n),
h AS (SELECT r, s, n, item FROM (SELECT r, s, n, w[s:s + n - 1] AS win FROM p) x JOIN v ON v.win = x.win),
k AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS place FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN i ON i.r = d.r
"""
