"""Integer vectors and their exact means, as the vector operators share them.

A vector takes part if neither it nor a component is null, all components are finite, and the scaled components stay under
2**62, so that a long holds them. Components under ``SMALL`` are compared in doubles or longs, which are exact there;
larger ones in Python's integers. Squared distances and sums beyond a long are given as its largest value.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, position

SMALL = 1 << 26
MOST = 2**63 - 1
#: Products and sums of integers are exact in doubles below this.
EXACT = 2.0**53


def vector_rows(df: DataFrame, vector_col: str, scale: int, columns: dict[str, str]) -> DataFrame:
    """The columns ``columns`` (new name to old name) and ``v``, the vector as doubles, of the rows that take part."""
    by_place = numbered(df)
    pick = lambda c: by_place[f"__{position(df, c)}"]
    rows = by_place.select(*[pick(old).alias(new) for new, old in columns.items()], pick(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float(2**62 // scale), F.lit(False))))


def scaled(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as rows of longs."""
    return np.floor(np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) * scale).astype(np.int64)


def computable(x: np.ndarray, *others: np.ndarray) -> np.dtype:
    """The type in which squared distances between such rows are exact: doubles, longs, or Python's integers."""
    top = max([int(np.abs(a).max()) if a.size else 0 for a in (x, *others)])
    if 4 * top * top * max(1, x.shape[1]) < EXACT:
        return np.dtype(np.float64)
    return np.dtype(np.int64) if top < SMALL and x.shape[1] <= 128 else np.dtype(object)


def capped(values: np.ndarray) -> pa.Array:
    """Longs; what is larger becomes the largest long."""
    return pa.array([min(int(v), MOST) for v in values] if values.dtype == object else values.astype(np.int64), pa.int64())


class Sums:
    """Component sums and counts by (part, entry), gathered within a task and given as rows of two halves."""

    DDL = "part int, entry int, at int, n long, high long, low long"

    def __init__(self) -> None:
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, part: int, entries: np.ndarray, counts: np.ndarray, sums: np.ndarray, of: int) -> None:
        """Add ``sums`` and ``counts`` to those of ``entries``, which are numbers under ``of`` and may repeat."""
        if sums.dtype != object:
            sums = sums.astype(np.int64)
        held = self.rows.get(part, (np.zeros(of, np.int64), np.zeros((of, sums.shape[1]), np.int64)))
        total = held[1].astype(object) if sums.dtype == object or self.near_full(held[1], sums) else held[1]
        np.add.at(held[0], entries, counts)
        np.add.at(total, entries, sums)
        self.rows[part] = held[0], total

    @staticmethod
    def near_full(a: np.ndarray, b: np.ndarray) -> bool:
        return a.dtype == object or max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)) * len(b)) >= 2**62

    def batches(self):
        for part, (n, total) in self.rows.items():
            used = np.flatnonzero(n)
            wide = total.shape[1]
            flat = [int(v) for v in total[used].ravel()] if total.dtype == object else None
            high = pa.array([v >> 32 for v in flat], pa.int64()) if flat is not None else pa.array((total[used] >> 32).ravel())
            low = pa.array([v & 0xFFFFFFFF for v in flat], pa.int64()) if flat is not None else pa.array((total[used] & 0xFFFFFFFF).ravel())
            at = np.tile(np.arange(wide, dtype=np.int32), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(np.repeat(used, wide).astype(np.int32)), pa.array(at), pa.array(np.repeat(n[used], wide)), high, low], ["part", "entry", "at", "n", "high", "low"])


def floor_means(sums: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The books with each entry that has members replaced by floor(sum / count) of each component.

    ``sums`` holds rows of ``Sums``; what comes to the driver is one row for each component of the books.
    """
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r.part][r.entry, r.at] = ((r.high << 32) + r.low) // r.n
    return out


def digest(rows: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in rows.ravel()).encode()).hexdigest()
