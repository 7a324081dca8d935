"""Removal of repeated byte strings by suffix arrays and longest-previous-factor tests.

A window is ``WINDOW`` consecutive bytes of one text. Its key is the hash of that of its ``ANCHOR``-byte strings which a
fixed hash puts first: a function of the window's bytes alone, so equal windows have equal keys wherever they stand.
Consecutive windows of a text with one key form a segment. Segments whose key occurs once cannot repeat anything; this
leaves few. Of the others,

* equal segments of a key are counted by their hash: all their windows repeat, and one of them stands for the rest;
* up to ``GROUP`` different segments of a key meet in one task, which builds the suffix array of all the segments it has,
  sorted by the first WINDOW bytes, and from it the previous and next smaller positions in suffix order: a window has an
  earlier copy exactly if one of these two neighbours shares its first WINDOW bytes (its longest previous factor is that
  long), and a later copy by the same test with larger positions;
* keys of more different segments (passages that very many texts share, where each copy goes on differently) are split:
  the windows of a segment are dealt to ``WAYS`` ranges by their distance from the anchor, the key of a range is the hash
  of the bytes that all windows in it share, and the same three cases apply again. A range of one window holds only equal
  segments, so this ends after four rounds, with few rows for each segment and no task that has a whole group.

``keep="none"`` removes every byte under a window that occurs more than once; ``keep="first"`` spares the windows that
occur for the first time, in order of id and place.

A row is known by its id and its text's hash, so rows may share an id. Segments are equal if hashes of two lanes are; the
first lane's alone only brings together what is then told apart.

Edge cases: null and empty texts, and texts shorter than a window, have nothing to remove. Repeated rows are copies of
each other, of which ``keep="first"`` spares all or none. Rows without an id take part, as the first ones. Ids are whole
numbers or strings (anything else is compared as a string). Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, chunks, cut, mix, numbered, position, powers, prefix_sums, ranges, span_hashes, table, utf8

WINDOW, ANCHOR = 200, 40
#: Windows of a segment at most (more only arise in periodic text).
LONGEST = 1024
#: Segments of a key that one task takes together.
GROUP = 512
#: Ranges that the windows of a key with more segments are dealt to in one round.
WAYS = 4
#: Bytes that a vector pass over one text takes at once.
PIECE = 4 << 20
_PLACE = U64((1 << 24) - 1)


def segments(data: np.ndarray, off: np.ndarray, join: bool = True) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, hash, anchor) of the segments of the texts.

    ``anchor`` is the anchor's distance from the start, or -1 if the segment is joined from neighbours with one key, as in
    periodic text.
    """
    n, span = len(data), WINDOW - ANCHOR + 1
    first, count = off[:-1], np.maximum(0, np.diff(off) - WINDOW + 1)
    at = ranges(first, count)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, U64), np.empty(0, U64), none
    sums = prefix_sums(data.astype(U64) + U64(1))
    wide = sums[0]
    anchors = mix((wide[ANCHOR:] - wide[: n - ANCHOR + 1]) * powers(n + 1)[1][: n - ANCHOR + 1])
    low = np.full(-(-len(anchors) // span) * span, ~U64(0))
    low[: len(anchors)] = (anchors & ~_PLACE) | np.arange(len(anchors), dtype=U64)
    rows = low.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[at], ahead[at + span - 1]) & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    begin = np.flatnonzero(new)
    start, windows, key = at[begin], np.diff(np.append(begin, len(at))), anchors[place[begin]]
    anchor = place[begin] - start
    joined = np.zeros(len(start), bool)
    joined[1:] = join & (key[1:] == key[:-1]) & (start[:-1] + windows[:-1] == start[1:])
    if joined.any():
        head = np.flatnonzero(~joined)
        run = np.cumsum(~joined) - 1
        total = np.cumsum(windows) - windows
        part = (total - total[head][run]) // LONGEST
        head = np.ones(len(start), bool)
        head[1:] = (run[1:] != run[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(head)
        several = np.diff(np.append(head, len(start))) > 1
        anchor = np.where(several, -1, anchor[head])
        start, windows, key = start[head], np.add.reduceat(windows, head), key[head]
    text = np.searchsorted(off, start, "right") - 1
    return text, start - off[text], windows, key, span_hashes(sums, start, start + windows + WINDOW - 1), anchor


def pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, place of the piece in it, bytes, offsets): chunks of texts; a text over PIECE bytes comes in
    overlapping pieces that share no window."""
    for a, b in chunks(off):
        if off[b] - off[a] <= PIECE:
            yield a, 0, data[off[a] : off[b]], off[a : b + 1] - off[a]
        else:
            for at in range(int(off[a]), int(off[b]), PIECE):
                to = min(at + PIECE + WINDOW - 1, int(off[b]))
                yield a, at - int(off[a]), data[at:to], np.array([0, to - at])


#: What a row is known by: its id (null: the least value) and its text's hash.
ROW = ["id", "th"]
_SEGMENT = "key bigint, hash bigint, id {id}, th bigint, start int, n int, anchor int"


def text_segments(docs: DataFrame) -> DataFrame:
    """The segments of documents (id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, place, data, off in pieces(*utf8(x.column("text"))):
                text, start, n, key, h, anchor = segments(data, off)
                if len(text):
                    row = x.select(ROW).take(pa.array(first + text))
                    numbers = [pa.array(c) for c in (key.view(np.int64), h.view(np.int64), (start + place).astype(np.int32), n.astype(np.int32), anchor.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*numbers[:2], *row.columns, *numbers[2:]], ["key", "hash", *ROW, "start", "n", "anchor"])

    return docs.mapInArrow(run, _SEGMENT.format(id=docs.schema["id"].dataType.simpleString()))


def suffix_groups(data: np.ndarray) -> np.ndarray:
    """Rank of every suffix by its first WINDOW bytes; equal ranks mean equal bytes. By prefix doubling from 8 bytes."""
    n = len(data)
    padded = np.zeros(n + 8, U64)
    padded[:n] = data
    eight = np.zeros(n, U64)
    for j in range(8):
        eight = (eight << U64(8)) | padded[j : j + n]
    rank = np.unique(eight, return_inverse=True)[1].astype(np.int64)
    width = 8
    while width < WINDOW:
        step = min(width, WINDOW - width)
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:]
        rank = np.unique(rank * n + after, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1; all pointers jump at once."""
    to = np.arange(-1, len(x) - 1)
    todo = np.arange(len(x))
    while len(todo):
        todo = todo[(to[todo] >= 0)]
        todo = todo[x[to[todo]] > x[todo]]
        to[todo] = to[to[todo]]
    return to


def has_copy(order_position: np.ndarray, group: np.ndarray) -> np.ndarray:
    """By suffix order: whether the longest previous factor reaches WINDOW, that is, whether the previous or the next
    smaller position in suffix order belongs to the same group."""
    n = len(order_position)
    back = previous_smaller(order_position)
    ahead = n - 1 - previous_smaller(order_position[::-1])[::-1]
    out = np.zeros(n, bool)
    good = back >= 0
    out[good] = group[back[good]] == group[good]
    good = ahead < n
    out[good] |= group[ahead[good]] == group[good]
    return out


def repeated_windows(texts: list[bytes], keep_first: bool) -> list[np.ndarray]:
    """For each segment's bytes, in order of place, which of its windows repeat (with keep_first: repeat an earlier one)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    count = np.maximum(0, size - WINDOW + 1)
    at = ranges(np.cumsum(size) - size, count)
    rank = suffix_groups(data)[at]
    order = np.argsort(rank, kind="stable")
    group, position = rank[order], at[order]
    copy = has_copy(position, group)
    if not keep_first:
        copy |= has_copy(-position, group)
    out = np.empty(len(at), bool)
    out[order] = copy
    return np.split(out, np.cumsum(count)[:-1])


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that the flagged windows cover."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + WINDOW - 1).tolist(), strict=True))


_SPAN = "id {id}, th bigint, a int, b int"


def group_spans(parts: DataFrame, keep_first: bool) -> DataFrame:
    """Spans that repeat, from rows (key, id, th, start, part) of keys with few segments each."""
    id_type = parts.schema["id"].dataType.simpleString()
    kinds = (pa.string() if id_type == "string" else pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1:4])
        out = [(r[1], r[2], r[3] + a, r[3] + b) for r, flags in zip(rows, repeated_windows([r[4] for r in rows], keep_first), strict=True) for a, b in spans_of(flags)]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], [*ROW, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key = [], 0, None
        for x in batches:
            for row in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if row[0] != key and size >= 1 << 20:  # never between segments of one key
                    yield solve(rows)
                    rows, size = [], 0
                key = row[0]
                rows.append(row)
                size += len(row[4])
        if rows:
            yield solve(rows)

    ordered = parts.select("key", *ROW, "start", "part").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, _SPAN.format(id=id_type))


_PART = "key bigint, id {id}, th bigint, start int, n int, anchor int, part binary"


def cut_out(docs: DataFrame, wanted: DataFrame, apart: bool = False) -> DataFrame:
    """The bytes of the wanted segments, a document's together; with ``apart`` joined segments come as what they were
    joined from, so that each has one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data, off = utf8(x.column("text"))
            for at, found in enumerate(x.column("found").to_pylist()):
                raw, rows = data[off[at] : off[at + 1]].tobytes(), []
                for f in found:
                    part = raw[f["start"] : f["start"] + f["n"] + WINDOW - 1]
                    if apart and f["anchor"] < 0:
                        _, start, n, _, _, anchor = segments(np.frombuffer(part, np.uint8), np.array([0, len(part)]), join=False)
                        rows += [(f["key"], f["start"] + s, k, a, part[s : s + k + WINDOW - 1]) for s, k, a in zip(start.tolist(), n.tolist(), anchor.tolist(), strict=True)]
                    else:
                        rows.append((f["key"], f["start"], f["n"], f["anchor"], part))
                cols = list(zip(*rows, strict=True))
                row = x.select(ROW).take(pa.array([at] * len(rows)))
                made = [pa.array(cols[0], pa.int64()), *row.columns, *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["key", *ROW, "start", "n", "anchor", "part"])

    by_doc = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("key", "start", "n", "anchor")).alias("found"))
    return docs.join(by_doc, ROW).select(*ROW, "text", "found").mapInArrow(run, _PART.format(id=docs.schema["id"].dataType.simpleString()))


def split_parts(parts: DataFrame) -> DataFrame:
    """Segments with bytes, cut by the distance of their windows from the anchor to at most WAYS ranges of low..high; the
    key is the hash of the bytes that all windows of the range share, the hash that of the piece's bytes and place."""
    out = []
    for k in range(WAYS):
        step = F.ceil((F.col("high") - F.col("low") + 1) / WAYS).cast("int")
        r = parts.withColumns({"a": F.col("low") + k * step, "b": F.least(F.col("low") + (k + 1) * step - 1, "high")}).where("a <= high")
        r = r.withColumns({"far": F.least("anchor", "b"), "near": F.greatest(F.col("anchor") - F.col("n") + 1, "a")}).where("far >= near")
        piece = F.substring("part", F.col("anchor") - F.col("far") + 1, F.col("far") - F.col("near") + WINDOW)
        r = r.withColumn("piece", piece)
        core = F.substring("piece", F.col("far") - F.col("a") + 1, WINDOW - (F.col("b") - F.col("a")))
        place = F.col("start") + F.col("anchor") - F.col("far")
        out.append(
            r.select(
                F.xxhash64("a", "b", core).alias("key"), F.xxhash64("near", "far", "piece").alias("hash"), *ROW, place.alias("start"),
                (F.col("far") - F.col("near") + 1).alias("n"), F.col("far").alias("anchor"), F.col("a").alias("low"), F.col("b").alias("high"), F.col("piece").alias("part"),
            )
        )
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def settled(rows: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, group, more) of segments: the spans of equal ones; and, of keys with different ones, the first of each
    kind: of keys with few kinds, and of keys with many."""
    place = F.struct(*ROW, "start")
    payload = [c for c in rows.columns if c not in ("key", "hash", *ROW, "start", "n", "anchor")]
    kinds = rows.groupBy("key", "hash").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max("n").alias("n"), F.max("anchor").alias("anchor"))
    sizes = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("copies").alias("rows"), F.min("anchor").alias("least"))
    sizes = sizes.where("rows > 1 or least < 0").drop("rows", "least")
    kinds = cut(kinds.join(sizes, "key"))
    equal = kinds.where("copies > 1").select("key", "hash", "first")
    gone = rows.select("key", "hash", *ROW, "start", "n").join(equal, ["key", "hash"])
    if keep_first:
        gone = gone.where(place != F.col("first"))
    spans = gone.select(*ROW, F.col("start").alias("a"), (F.col("start") + F.col("n") + WINDOW - 1).alias("b"))
    one = kinds.where("kinds > 1 or anchor < 0").select("key", "hash", "first.id", "first.th", "first.start", "n", "anchor", "kinds")
    if payload:
        one = cut(one.join(rows.select("key", "hash", *ROW, "start", *payload).dropDuplicates(["key", "hash", *ROW, "start"]), ["key", "hash", *ROW, "start"]))
    few = F.col("kinds") <= GROUP
    return spans, one.where(few).drop("hash", "kinds"), one.where(~few).drop("hash", "kinds")


def repeated_spans(docs: DataFrame, keep_first: bool) -> DataFrame:
    """(id, th, a, b): byte ranges of documents (id, th, text) that are to go; they may overlap."""
    runs = text_segments(docs)
    seen = runs.groupBy("key").agg(F.count("*").alias("c"), F.min("anchor").alias("anchor")).where("c > 1 or anchor < 0").select("key")
    found = cut(runs.join(cut(seen), "key"))
    spans, group, more = settled(found, keep_first)
    every = [spans, group_spans(cut_out(docs, group), keep_first)]
    parts = cut(cut_out(docs, more, apart=True).select(*ROW, "start", "n", "anchor", F.lit(0).alias("low"), F.lit(WINDOW - ANCHOR).alias("high"), "part"))
    groups = None
    while not parts.isEmpty():
        spans, group, parts = settled(cut(split_parts(parts)), keep_first)
        every.append(spans)
        groups = group if groups is None else groups.unionByName(group)
        parts = cut(parts.drop("key"))
    if groups is not None:
        every.append(group_spans(groups, keep_first))
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


_RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none", texts: bool = False) -> DataFrame:
    """Digests of what is left of each document; with ``texts`` also the bytes themselves (``kept binary``)."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    by_place = numbered(df)
    given, text = by_place[f"__{position(df, id_col)}"], F.coalesce(by_place[f"__{position(df, text_col)}"].cast("string"), F.lit(""))
    whole = isinstance(df.schema.fields[position(df, id_col)].dataType, T.IntegralType)
    known = F.coalesce(given.cast("bigint"), F.lit(0)) if whole else F.coalesce(given.cast("string"), F.lit(""))
    docs = by_place.select(given.alias("doc_id"), known.alias("id"), F.xxhash64(text, given.isNull()).alias("th"), text.alias("text"))
    by_doc = repeated_spans(docs.select(*ROW, "text"), keep == "first").groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data, off = utf8(x.column("text"))
            rows = []
            for at, spans in enumerate(x.column("spans").to_pylist()):
                raw, parts, end, removed, n = data[off[at] : off[at + 1]].tobytes(), [], 0, 0, 0
                merged: list[list[int]] = []
                for s in spans or ():
                    if merged and s["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["b"])
                    else:
                        merged.append([s["a"], s["b"]])
                for a, b in merged:
                    parts.append(raw[end:a])
                    removed, n, end = removed + b - a, n + 1, b
                left = b"".join([*parts, raw[end:]])
                rows.append((len(raw), removed, n, hashlib.sha256(left).hexdigest(), *([left] if texts else [])))
            cols = [pa.array(c) for c in zip(*rows, strict=True)]
            if cols:
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), *cols], ["doc_id", *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(by_doc, ROW, "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {id_type}, {_RESULT}" + ", kept binary" * texts)


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
