"""Operator 12: whitening of embeddings.

Every partition folds its vectors by Welford's rank-one update, the partitions' states meet by the parallel formula of
Chan, Golub and LeVeque in a tree of tasks, and the symmetric matrix that is left, whose size is that of one vector
squared, is solved by Householder's reduction and the implicit QR algorithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import prepared, table, written
from folioforge.llm.vectors import by_length, exact, packed

SCALE, COMPONENTS = 256.0, 4
#: States that one task merges; no more than so many reach the driver for a length of vectors.
FAN = 16
#: An eigenvalue is 0 if it is under this share of the largest one times the number of dimensions.
RANK = 1e-13


# ---- moments ----------------------------------------------------------------------------------------------------------


@dataclass
class Moments:
    """Count, mean, sum of centred outer products, and the exact sums of whole numbers."""

    n: int
    mean: np.ndarray
    m2: np.ndarray
    sums: list[int]

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, np.zeros(d), np.zeros((d, d)), [0] * d)

    def add(self, rows: np.ndarray) -> None:
        """One vector after the other: the mean moves by delta / n, the products grow by the outer product of the deviations before and after."""
        outer, step = np.empty_like(self.m2), np.empty_like(self.mean)
        for x in rows.astype(np.float64):
            self.n += 1
            delta = x - self.mean
            np.divide(delta, self.n, out=step)
            self.mean += step
            np.multiply.outer(delta, x - self.mean, out=outer)
            self.m2 += outer

    def count(self, rows: np.ndarray) -> None:
        """The exact sums of whole numbers."""
        most = float(np.abs(rows.astype(np.float64)).max(initial=0)) * max(1, len(rows))
        self.sums = [a + int(b) for a, b in zip(self.sums, exact(lambda v: v.sum(0), rows, most), strict=True)]

    def merge(self, other: Moments) -> Moments:
        """Both samples as one: between their means lies an outer product of its own."""
        if not self.n or not other.n:
            return other if other.n else self
        n = self.n + other.n
        delta = other.mean - self.mean
        return Moments(n, self.mean + delta * (other.n / n), self.m2 + other.m2 + np.multiply.outer(delta, delta) * (self.n * other.n / n), [a + b for a, b in zip(self.sums, other.sums, strict=True)])


#: length: that of the vectors; dim: that of what the moments are of.
STATE = "length int, id long, dim int, n long, mean array<double>, m2 array<double>, sums array<decimal(38,0)>"


def _state(length: int, at: int, m: Moments) -> pa.RecordBatch:
    values = [length, at, len(m.mean), m.n, m.mean, m.m2.reshape(-1), [Decimal(s) for s in m.sums]]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["length", "id", "dim", "n", "mean", "m2", "sums"])


def _read(r: dict) -> Moments:
    return Moments(r["n"], np.array(r["mean"], np.float64), np.array(r["m2"], np.float64).reshape(r["dim"], r["dim"]), [int(s) for s in r["sums"]])


def moments(vectors: DataFrame, of: Callable[[int, np.ndarray], np.ndarray] | None = None) -> dict[int, Moments]:
    """For each length the moments of a column `x` of packed vectors, or of what of(length, matrix) makes of them.

    A task holds one state for each length; FAN states meet in a task until FAN are left, which the driver merges.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for b in batches:
            for length, _, x in by_length(b.column(0).to_pylist()):
                y = of(length, x) if of else x
                m = held.setdefault(length, Moments.none(y.shape[1]))
                m.add(y)
                if not of:
                    m.count(x)
        for length, m in held.items():
            yield _state(length, TaskContext.get().partitionId(), m)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m = None, None
        for b in batches:
            for i in range(b.num_rows):  # sorted: one state at a time
                r = b.slice(i, 1).to_pylist()[0]
                if (now := (r["length"], r["id"])) != key:
                    if m:
                        yield _state(*key, m)
                    key, m = now, _read(r)
                else:
                    m = m.merge(_read(r))
        if m:
            yield _state(*key, m)

    states = written(vectors.select("x").mapInArrow(fold, STATE), "whitening-states")
    while (most := states.groupBy("length").count().agg(F.max("count")).first()[0] or 0) > FAN:
        grouped = states.withColumn("id", F.floor(F.col("id") / FAN).cast("long"))
        states = written(grouped.repartition(-(-most // FAN), "length", "id").sortWithinPartitions("length", "id").mapInArrow(meet, STATE), "whitening-states")
    out: dict[int, Moments] = {}
    for r in states.orderBy("length", "id").toLocalIterator():  # FAN states for each length at most
        m = _read(r.asDict())
        out[r["length"]] = out[r["length"]].merge(m) if r["length"] in out else m
    return out


# ---- symmetric eigenproblem -------------------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and orthogonal Q with A = Q T Q', by Householder reflections."""
    a, n = np.array(a, np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.abs(x).max(initial=0.0)
        if not size or not np.abs(x[1:]).max(initial=0.0):
            continue
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns: implicit QR steps with Wilkinson's shift on the tridiagonal form.

    Each vector's entry of the largest size (the first of them) is positive.
    """
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = tridiagonal(a)
    q = np.ascontiguousarray(q.T)  # rows are turned, which lie together in memory
    eps, hi = np.finfo(np.float64).eps, n - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if not e[hi - 1]:
            hi -= 1
            continue
        cut = np.flatnonzero(e[:hi] == 0)
        lo = int(cut[-1]) + 1 if len(cut) else 0
        half = (d[hi - 1] - d[hi]) / 2
        turn = half + np.copysign(np.hypot(half, e[hi - 1]), half)
        x, z = d[lo] - (d[hi] - e[hi - 1] * (e[hi - 1] / turn)), e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, u, o = d[k], d[k + 1], e[k]
            d[k] = c * c * p + 2 * c * s * o + s * s * u
            d[k + 1] = s * s * p - 2 * c * s * o + c * c * u
            e[k] = c * s * (u - p) + (c * c - s * s) * o
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    order = np.argsort(-d, kind="stable")
    vectors = q[order]
    first = np.abs(vectors).argmax(1)
    return d[order], (vectors * np.sign(vectors[np.arange(n), first])[:, None]).T


# ---- the operator -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Axes:
    """The whitening of one length: size of the fit list, exact sums, values and unit vectors of the first components, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows on the components, in units of their standard deviations; nan where a component has no variance."""
        mean = np.array([s / self.n for s in self.sums])
        # einsum sums each entry by itself, so a row has the same result in every batch
        y = np.einsum("nd,dk->nk", x.astype(np.float64) - mean, self.vectors)
        return np.divide(y, np.sqrt(np.maximum(self.values, 0)), out=np.full_like(y, np.nan), where=self.live)

    @property
    def live(self) -> np.ndarray:
        return self.values > RANK * max(1, len(self.vectors)) * np.max(self.values, initial=0)

    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0) / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)**2, exact; None if it takes more than 64 bits."""
        size = np.abs(x.astype(np.float64)).max(initial=0)
        most = (self.n * float(size) + max((abs(s) for s in self.sums), default=0)) ** 2 * max(1, x.shape[1])
        sums = np.array(self.sums, object) if most >= 2.0**62 else np.array(self.sums, np.int64)
        found = exact(lambda v: ((self.n * v - sums) ** 2).sum(1), x, most)
        return [int(v) if v < 1 << 63 else None for v in found] if x.shape[1] else [0] * len(x)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Axes]:
    """The whitening of a table of distinct packed vectors `x`, one for each length among them."""
    axes = {}
    for d, m in moments(distinct).items():
        values, vectors = symmetric_qr(m.m2 / m.n)
        axes[d] = Axes(m.n, m.sums, values[:components], vectors[:, :components], float(np.trace(m.m2)) / m.n)
    measured = moments(distinct, lambda d, x: axes[d].whitened(x)[:, axes[d].live])
    error = {d: float(np.abs(m.m2 / m.n - np.eye(len(m.mean))).max(initial=0)) for d, m in measured.items()}
    return {d: replace(a, error=error[d]) for d, a in axes.items()}


FIELDS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each row of df and component.

    Rows whose vector is null or holds null or non-finite components are left out. Entries are floor(scale * c), at the
    nearest end of 64 bits where they lie beyond. The fit list holds each distinct vector once, so copies weigh
    nothing; repeated rows each get their rows, and ids may be null. Vectors of each length have a fit of their own, with as many
    components as dimensions at most; empty vectors have none. A component without variance (one distinct vector, or
    fewer than components) has a null `whitened`, `explained` 0 and no part in identity_error. A deviation beyond 64
    bits is null. Other columns of df are not read. No rows give no rows.
    """
    prepared(df.sparkSession)
    rows = written(packed(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("v")), "v", scale), "whitening-rows")
    distinct = written(rows.select("x").distinct(), "whitening-distinct")
    axes = fit(distinct, components)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column(1).to_pylist()):
                a = axes[d]
                k, n = len(a.values), len(at)
                y = a.whitened(x).reshape(-1)
                columns = [b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, a.n, np.int64))]
                columns += [pa.array([v for v in a.deviations(x) for _ in range(k)], pa.int64()), pa.array(y, mask=np.isnan(y)), pa.array(np.tile(a.explained(), n)), pa.array(np.full(n * k, a.error))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *(f.split()[0] for f in FIELDS.split(", "))])

    return rows.mapInArrow(run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
