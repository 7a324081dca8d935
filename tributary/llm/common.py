"""Shared helpers of the training-data operators.

Everything here works on one Arrow batch inside a Spark task: it views the UTF-8 buffer of a string column as a numpy
array, cuts it into words, and hashes words or windows by prefix sums, so the cost is a few vector passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64
#: Odd multiplier of the rolling hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
#: The second lane: structured texts (Thue-Morse words) collide modulo any power of two, not modulo a prime.
PRIME, PRIME_BASE = 2**31 - 1, 1_103_515_245
#: Bytes of text that the vector passes take at once; bounds their scratch memory.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 2000

# Word bytes: 0-9, a-z (A-Z are lower-cased) and every byte of a non-ASCII character; the rest separates words.
_TABLE = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _TABLE[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _TABLE[_b] = _b + 32
WORD_TABLE = _TABLE
#: The same for bytes.translate(), separators becoming blanks.
WORD_TRANSLATE = bytes(int(x) or 0x20 for x in _TABLE)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and offsets of length rows + 1 into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``limit`` bytes; one long text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


_powers = [np.ones(1, U64), np.ones(1, U64)]
_prime_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n modulo 2**64; kept for the next batch of the same worker."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for PRIME_BASE modulo PRIME."""
    if len(_prime_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, b in enumerate((PRIME_BASE, pow(PRIME_BASE, -1, PRIME))):
            row, filled = np.ones(size, U64), 1
            while filled < size:  # the second half is the first one times a power
                step = min(filled, size - filled)
                row[filled : filled + step] = row[:step] * U64(pow(b, filled, PRIME)) % U64(PRIME)
                filled += step
            _prime_powers[k] = row
    return _prime_powers[0], _prime_powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


Sums = tuple[np.ndarray, np.ndarray]


def prefix_sums(values: np.ndarray) -> Sums:
    """Two lanes of S with S[i] the sum of values[j] * base**j for j < i: modulo 2**64, and in powers modulo PRIME.

    Values are under 2**9, so the second lane's sums stay exact below 2**24 values.
    """
    values, out = values.astype(U64), (np.zeros(len(values) + 1, U64), np.zeros(len(values) + 1, U64))
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[0][1:])
    np.cumsum(values * prime_powers(len(values))[0][: len(values)], out=out[1][1:])
    return out


def span_hashes(sums: Sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal contents wherever they stand."""
    wide, prime = sums
    first = (wide[end] - wide[start]) * powers(len(wide))[1][start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407)
    second = (prime[end] - prime[start]) % U64(PRIME) * prime_powers(len(prime))[1][start] % U64(PRIME)
    return mix(first ^ mix(second * U64(0x9FB21C651E98DF25)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: lower-cased bytes, start and end byte of each word, and word offsets of each text."""
    low = WORD_TABLE[data]
    inside = low != 0
    if not len(data):
        none = np.empty(0, np.int64)
        return low, none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False  # a text begins: what stands before belongs to another
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return low, start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, start and end byte of each, and word offsets of each text."""
    low, start, end, per = words(data, offsets)
    return span_hashes(prefix_sums(low), start, end), start, end, per


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += hashes[k : k + n]
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def position(df: DataFrame, name: str) -> int:
    """Where the column of this name stands: the one spelt so, else the first that differs only in case."""
    names = df.columns
    if name in names:
        return names.index(name)
    same = [i for i, c in enumerate(names) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name} among {names}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named by their place, so that names that differ only in case can be told apart."""
    return df.toDF(*[f"__{i}" for i in range(len(df.columns))])


def carried(keep: list[str], results: list[str]) -> list[str]:
    """The columns of ``keep`` that no result column replaces; case does not tell names apart."""
    taken = {c.lower() for c in results}
    return [c for c in keep if c.lower() not in taken]


PerBatch = Callable[[pa.Array], list[pa.Array] | tuple[list[pa.Array], pa.Array]]


def map_texts(df: DataFrame, text_col: str, keep: list[str], results: str, per_batch: PerBatch) -> DataFrame:
    """Columns ``keep`` and, from ``per_batch`` over the text column, the columns ``results``; no shuffle.

    ``per_batch`` gives the result columns, or these and a mask of the rows to keep. A kept column whose name is also a
    result's gives way to the result.
    """
    out = T.StructType.fromDDL(results).fields if results else []
    keep = carried(keep, [f.name for f in out])
    return _mapped(df, text_col, [(c, position(df, c)) for c in keep], out, per_batch)


def _mapped(df: DataFrame, text_col: str, kept: list[tuple[str, int]], out: list[T.StructField], per_batch: PerBatch) -> DataFrame:
    """``map_texts`` over columns by place; a string text column among the kept ones is sent to the tasks once."""
    text_at, fields = position(df, text_col), df.schema.fields
    sent = [i for _, i in kept]
    names = [c for c, _ in kept] + [f.name for f in out]
    if not (text_at in sent and isinstance(fields[text_at].dataType, T.StringType)):
        sent = [*sent, text_at]
    column = sent.index(text_at) if sent[-1] != text_at else len(sent) - 1
    schema = T.StructType([T.StructField(c, fields[i].dataType, True) for c, i in kept] + out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                made = per_batch(b.column(column))
                made, mask = made if isinstance(made, tuple) else (made, None)
                rows = pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + made, names)
                yield rows if mask is None else rows.filter(mask)

    by_place = numbered(df)
    cols = [by_place[f"__{i}"].alias(f"__s{k}") for k, i in enumerate(sent)]
    cols[column] = by_place[f"__{text_at}"].cast("string").alias(f"__s{column}")
    return by_place.select(*cols).mapInArrow(run, schema)


def keep_texts(df: DataFrame, text_col: str, good: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows for which ``good`` gives true; every column as it came, whatever its name."""
    every = [(c, i) for i, c in enumerate(df.columns)]
    return _mapped(df, text_col, every, [], lambda column: ([], good(column)))


def replace_texts(df: DataFrame, text_col: str, change: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """Every row and column, the text column changed; other columns as they came, whatever their names."""
    at = position(df, text_col)
    kept = [(c, i) for i, c in enumerate(df.columns) if i != at]
    made = _mapped(df, text_col, kept, [T.StructField("__changed", T.StringType())], lambda column: [change(column)])
    order = [k for k in range(at)] + [len(kept)] + [k for k in range(at, len(kept))]
    by_place = numbered(made)
    return by_place.select(*[by_place[f"__{k}"] for k in order]).toDF(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so later stages read files instead of recomputing it.

    The folder is the session's spark.checkpoint.dir; only where that is unset (tests on one machine) a folder under
    spark.sql.warehouse.dir is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint()
