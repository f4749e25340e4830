"""Operator 11: exact top-k by inner product over a pivot-distance index.

Every distinct vector is keyed by its nearest pivot and its distance from it; distances are cut into annuli. What a
query can score in an annulus is bounded: with d the distance of the query from the pivot, no vector in the annulus is
nearer than the gap between d and its distances (the triangle inequality), and 2 q.x = |q|^2 + |x|^2 - |q - x|^2. A query
goes through the annuli from the highest bound down and stops where the bound is under its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.llm.common import prepared, table, written
from folioforge.llm.vectors import by_length, packed, unpack

SCALE, K, EVERY = 64.0, 20, 20
#: The index: rows that pivots and borders are fitted on at most for each length (the least by hash), distinct vectors
#: that an annulus should hold, pivots and annuli of a pivot at most. They bound the directory; they never leave a row out.
FIT_ROWS, PER_ANNULUS, PIVOTS, BINS = 8192, 4096, 256, 64
#: Distinct vectors that a query meets in its first and its second round; the third has no end but the bound.
ROUNDS = (4096, 32768)
#: Numbers of a block of candidates, and queries that meet it in one task: larger annuli are split, in both directions.
BLOCK_NUMBERS, BLOCK_QUERIES = 1 << 21, 16384
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", x, x)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """einsum sums each entry by itself, so a row has the same distances in every batch."""
    return np.sqrt(np.maximum(_squares(x)[:, None] - 2 * np.einsum("nd,kd->nk", x, pivots) + _squares(pivots), 0))


def _pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Rows that lie far apart, each moved to the mean of what is nearest to it, eight times."""
    chosen, far = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[chosen[-1:]])[:, 0])
    pivots = x[chosen]
    for _ in range(8):
        own = _distances(x, pivots).argmin(1)
        n = np.bincount(own, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, own, x)
        pivots = total[n > 0] / n[n > 0][:, None]
    return pivots


@dataclass(frozen=True)
class Index:
    """For one length of vectors: pivots, and the inner borders of each pivot's annuli (padded with infinity)."""

    pivots: np.ndarray
    borders: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, n: int) -> Index:
        annuli = max(1, -(-n // PER_ANNULUS))
        pivots = _pivots(sample, min(PIVOTS, max(1, int(2 * annuli**0.5))))
        bins = min(BINS, -(-annuli // len(pivots)))
        d = _distances(sample, pivots)
        own = d.argmin(1)
        borders = np.full((len(pivots), BINS - 1), np.inf)
        for p in range(len(pivots)):
            mine = d[own == p, p]
            if len(mine) and bins > 1:
                borders[p, : bins - 1] = np.quantile(mine, np.arange(1, bins) / bins)
        return cls(pivots, borders)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row the number of its annulus (pivot * BINS + bin) and the distance from its pivot."""
        d = _distances(x, self.pivots)
        own = d.argmin(1)
        r = d[np.arange(len(x)), own]
        return own * BINS + (self.borders[own] <= r[:, None]).sum(1), r


@dataclass(frozen=True)
class Directory:
    """What is known of the annuli of one length: number, least and greatest distance, greatest square of a vector, count."""

    index: Index
    annulus: np.ndarray
    near: np.ndarray
    far: np.ndarray
    square: np.ndarray
    n: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """By query and annulus a number that no score is above: rounding is allowed for."""
        d, own = _distances(x, self.index.pivots), _squares(x)[:, None]
        d = d[:, self.annulus // BINS]
        slack = 1e-6 * (np.sqrt(own) + np.sqrt(self.square) + np.sqrt(_squares(self.index.pivots))[self.annulus // BINS])
        gap = np.maximum(np.maximum(self.near - d, d - self.far) - slack, 0)
        return np.minimum((own + self.square - gap**2) / 2, np.sqrt(own * self.square)) * (1 + 1e-9) + 1e-9 * (own + self.square) + 0.5

    def visits(self, x: np.ndarray, floor: np.ndarray, begin: float, end: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and annuli: from the annulus after those that hold `begin` vectors, in falling order of bounds, to the one with which `end` are reached, as long as the bound reaches the row's floor."""
        bound = self.bounds(x)
        order = np.argsort(-bound, 1, kind="stable")
        before = np.cumsum(self.n[order], 1) - self.n[order]
        go = (before >= begin) & (before < end) & (np.take_along_axis(bound, order, 1) >= floor[:, None])
        r, at = np.nonzero(go)
        return r, self.annulus[order[r, at]]


def _indexed(classes: DataFrame) -> tuple[DataFrame, dict[int, Index]]:
    """The classes with their length, annulus, distance and square, as a table, and the indexes that key them."""
    length = ((F.octet_length("x") - 1) / F.ascii(F.decode(F.substring("x", 1, 1), "ISO-8859-1"))).cast("int")
    sized = classes.withColumn("dim", length)
    indexes = {}
    for r in sized.groupBy("dim").count().collect():  # a row for each length
        sample = sized.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("x"), "x").limit(FIT_ROWS).select("x").collect()
        x = np.array([unpack(bytes(s["x"])) for s in sample], np.float64).reshape(len(sample), r["dim"])
        indexes[r["dim"]] = Index.fit(x, r["count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column(0).to_pylist()):
                y = x.astype(np.float64)
                annulus, r = indexes[d].keys(y)
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), d, np.int32)), pa.array(annulus.astype(np.int32)), pa.array(r), pa.array(_squares(y))], names=["x", "ids", "dim", "annulus", "r", "square"])

    return written(classes.select("x", "ids").mapInArrow(run, "x binary, ids array<long>, dim int, annulus int, r double, square double"), "topk-index"), indexes


def _directories(keyed: DataFrame, indexes: dict[int, Index]) -> dict[int, Directory]:
    """Collected: PIVOTS * BINS rows for each length at most."""
    rows = keyed.groupBy("dim", "annulus").agg(F.min("r").alias("near"), F.max("r").alias("far"), F.max("square").alias("square"), F.count("*").alias("n")).orderBy("dim", "annulus").toPandas()
    return {int(d): Directory(indexes[int(d)], *(g[c].to_numpy() for c in ("annulus", "near", "far", "square", "n"))) for d, g in rows.groupby("dim")}


def _visits(queries: DataFrame, directories: dict[int, Directory], begin: float, end: float) -> DataFrame:
    """(q, dim, annulus, x, floor) for a table (q, x, floor): the annuli that queries go to in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floors = b.column(2).fill_null(LEAST).to_numpy().astype(np.float64)
            for d, at, x in by_length(b.column(1).to_pylist()):
                for lo in range(0, len(at), 128):
                    r, annulus = directories[d].visits(x[lo : lo + 128].astype(np.float64), floors[at[lo : lo + 128]], begin, end)
                    part = b.take(pa.array(at[lo : lo + 128][r]))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(r), d, np.int32)), pa.array(annulus, pa.int32()), part.column(1), part.column(2)], names=["q", "dim", "annulus", "x", "floor"])

    return queries.select("q", "x", "floor").mapInArrow(run, "q long, dim int, annulus int, x binary, floor long")


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors: exact, at the nearest end of 64 bits where they lie beyond."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:  # no sum on the way is rounded
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, LEAST, MOST).astype(np.int64)


def _best(s: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores of at least its floor; of equal ones the first columns."""
    take = s >= floor[:, None]
    full = np.flatnonzero(take.sum(1) > k)
    if len(full):
        part = s[full]
        least = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k][:, None]
        over, tie = part > least, part == least
        take[full] = over | tie & (np.cumsum(tie, 1) <= k - over.sum(1)[:, None])
    return np.nonzero(take)


PLACE = ["dim", "annulus", "home", "away"]


def _compared(ready: DataFrame, k: int) -> DataFrame:
    """(q, score, vec_id, same): what each block of candidates (role 0, first) adds to the queries (role 1) that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for b in batches:
            place = np.stack([b.column(i).to_numpy() for i in range(4)])
            cut = np.flatnonzero(np.append((place[:, 1:] != place[:, :-1]).any(0), True)) + 1
            for lo, hi in zip([0, *cut[:-1]], cut, strict=True):
                now, part = tuple(place[:, lo]), b.slice(lo, hi - lo)
                if now != key:
                    key, held, block = now, [], None
                role = part.column(4).to_numpy()
                if (n := int((role == 0).sum())) > 0:
                    held.append(part.slice(0, n).select(["x", "ids"]))
                seek = part.slice(n)
                if not seek.num_rows or not held:
                    continue
                if block is None:
                    home = pa.Table.from_batches(held)
                    ids = home.column("ids").to_pylist()
                    order = sorted(range(len(ids)), key=lambda i: (ids[i][0] is None, ids[i][0] or 0))
                    packs = home.column("x").to_pylist()
                    block = [packs[i] for i in order], [ids[i] for i in order], np.array([unpack(packs[i]) for i in order])
                packs, ids, x = block
                own, q, floor = seek.column("x").to_pylist(), seek.column("q").to_numpy(), seek.column("floor").fill_null(LEAST).to_numpy()
                step = max(1, (1 << 22) // len(x))
                for at in range(0, len(own), step):
                    y = np.array([unpack(v) for v in own[at : at + step]])
                    s = scores(y, x)
                    r, c = _best(s, floor[at : at + step], k)
                    found = [(q[at + i], s[i, j], v, own[at + i] == packs[j]) for i, j in zip(r.tolist(), c.tolist(), strict=True) for v in ids[j]]
                    if found:
                        columns = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.bool_())], names=["q", "score", "vec_id", "same"])

    return ready.mapInArrow(run, "q long, score long, vec_id long, same boolean")


def _met(keyed: DataFrame, visits: DataFrame) -> DataFrame:
    """Candidates and queries of each visited annulus in one table, dealt over blocks of bounded size in both directions."""
    seeks = visits.groupBy("dim", "annulus").agg(F.count("*").alias("seeks"))
    rows = keyed.groupBy("dim", "annulus").agg(F.count("*").alias("rows"))
    most = F.greatest(F.lit(256), F.lit(BLOCK_NUMBERS) / F.greatest(F.lit(1), F.col("dim")))
    grid = written(seeks.join(rows, ["dim", "annulus"]).select("dim", "annulus", F.ceil(F.col("rows") / most).cast("int").alias("homes"), F.ceil(F.col("seeks") / BLOCK_QUERIES).cast("int").alias("aways")), "topk-grid")
    one = lambda c, n: F.array(F.pmod(F.xxhash64(c), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home = keyed.join(grid, ["dim", "annulus"]).select("dim", "annulus", one("x", "homes").alias("hs"), every("aways").alias("as"), F.lit(0).alias("role"), "x", "ids", F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("floor"))
    away = visits.join(grid, ["dim", "annulus"]).select("dim", "annulus", every("homes").alias("hs"), one("q", "aways").alias("as"), F.lit(1).alias("role"), "x", F.lit(None).cast("array<long>").alias("ids"), "q", "floor")
    both = home.unionByName(away).withColumn("home", F.explode("hs")).withColumn("away", F.explode("as"))
    return both.select(*PLACE, "role", "x", "ids", "q", "floor").repartition(*PLACE).sortWithinPartitions(*PLACE, "role")


def search(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of df for which is_query holds, the k rows of the highest inner product.

    Components are floor(scale * x). Rows whose vector is null or holds null or non-finite components take no part, on
    either side. A query's candidates are all other rows with a vector of its length (an empty one scores 0); of equal
    scores the smaller id comes first, a null id last. Repeated rows are candidates each, and queries each, for which
    the same rows come out. Scores and components beyond 64 bits become the nearest end. Fewer rows give fewer results,
    no rows none. is_query reads columns of df; others than it, id and vector may have any name.

    Equal vectors are one class with its k + 1 smallest ids, as no query can need more (one may be its own row): copies
    are never compared. Nothing is left out: the bounds are exact, and the last round has no limit but them.
    """
    prepared(df.sparkSession)
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(f"`{vector}`").alias("v"))
    rows = written(packed(base, "v", scale), "topk-rows")
    first = W.partitionBy("x").orderBy(F.col("id").asc_nulls_last())
    least = rows.select("x", "id").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rn", "id"))), lambda s: s["id"])
    classes = written(least.groupBy("x").agg(ids.alias("ids")), "topk-classes")
    keyed, indexes = _indexed(classes)
    directories = _directories(keyed, indexes)
    queries = written(rows.where("asks").groupBy("id", "x").agg(F.count("*").alias("copies")).withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("same").desc())
    best = None
    for begin, end in zip((0, *ROUNDS), (*ROUNDS, float("inf")), strict=True):
        if best is None:
            asked = queries.withColumn("floor", F.lit(None).cast("long"))
        else:
            floors = best.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
            asked = queries.join(floors, "q", "left")
        visits = written(_visits(asked, directories, begin, end), "topk-visits")
        found = _compared(_met(keyed, visits), k + 1)
        both = found if best is None else best.unionByName(found)
        best = written(both.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).drop("rn"), "topk-best")
    named = best.join(queries.select("q", "id", "copies"), "q")
    own = F.col("same") & F.col("vec_id").eqNullSafe(F.col("id"))
    passed = named.withColumn("own", own).withColumn("met", F.sum(F.col("own").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(order))
    others = passed.where(~F.col("own") | (F.col("met") > 1)).withColumn("rank", F.col("rn") - F.least(F.col("met"), F.lit(1)).cast("int")).where(F.col("rank") <= k)
    return others.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x, c.x) DESC, c.vec_id))::INT AS rank,
  c.vec_id AS vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 20
"""
