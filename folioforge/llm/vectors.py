"""Columns of vectors as whole numbers: floor(scale * x) of every component, packed into bytes that are equal when the vectors are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = (1, 2, 4, 8)


def sound(vector: Column) -> Column:
    """True for a vector that is there and holds finite components only."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * values) as 64-bit numbers; what lies beyond them becomes the nearest one."""
    with np.errstate(over="ignore"):
        x = np.floor(values * scale)
    out = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)
    out[x >= 2.0**63], out[x <= -(2.0**63)] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return out


def pack(x: np.ndarray) -> bytes:
    """The narrowest integers that hold the vector, after a byte that says how wide they are."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = next(w for w in WIDTHS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def packed(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """The rows of df whose vector is sound, with the column `x` (binary) in place of the vector; other columns stay as they are."""
    kept = [c for c in df.columns if c != vector]
    rows = df.where(sound(F.col(f"`{vector}`"))).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vector}`").cast("array<double>").alias("x"))
    schema = rows.select(*[F.col(f"`{c}`") for c in kept], F.lit(b"").alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(len(kept))
            values, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            x = whole(np.asarray(values, np.float64), scale)
            made = [pack(x[ends[i] : ends[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(made, pa.binary())], names=[*kept, "x"])

    return rows.mapInArrow(run, schema)


def by_length(rows: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of packed vectors, for each length among them."""
    size = np.array([(len(r) - 1) // r[0] for r in rows], np.int64)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, np.array([unpack(rows[i]) for i in at], np.int64).reshape(len(at), int(d))


def exact(make: Callable[[np.ndarray], np.ndarray], x: np.ndarray, most: float) -> np.ndarray:
    """make(x) in 64-bit integers if no number on the way passes `most` < 2**62, else in Python's, which have no bound."""
    return make(x) if most < 2.0**62 else make(x.astype(object))
