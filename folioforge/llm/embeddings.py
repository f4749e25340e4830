"""Operator 8: near-duplicate embeddings by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the pairs of codes are the cells of a grid. A vector visits
cells in the order of how near it is to their borders, until pairs at the similarity threshold are met at the target
recall, and is compared with all vectors at home there. Only sums of links and spanning links leave a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table, written
from folioforge.llm.components import connected

COSINE, RECALL = 0.98, 0.999
#: Vectors of each dimension that codebooks and the stopping bound are fitted on at most, by hash of the id; vectors
#: that a cell should hold; codes of a codebook at most; home vectors in one task, beyond which a cell is split.
FIT_ROWS, PER_CELL, CODES, BLOCK = 8192, 32, 256, 4096


@dataclass(frozen=True)
class Books:
    """For each dimension the codebooks of both halves and the squared stopping bound."""

    by_dim: dict[int, tuple[np.ndarray, np.ndarray, float]]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors the squared distances to the nearest border of each code's region, 0 for their own code, by half."""
        one, two, _ = self.by_dim[x.shape[1]]
        h = x.shape[1] // 2
        return _borders(x[:, :h], one), _borders(x[:, h:], two)


def _borders(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """By row and code, from the distances of the rows to the codes and of the codes to each other: no array is larger than rows by codes or codes by codes.

    einsum sums each entry by itself, so a row has the same result in every batch.
    """
    norms = (book**2).sum(1)
    d = np.maximum((x**2).sum(1)[:, None] - 2 * np.einsum("nd,kd->nk", x, book) + norms, 0)
    own = d.argmin(1)
    pair = np.sqrt(np.maximum(norms[:, None] - 2 * np.einsum("jd,kd->jk", book, book) + norms, 1e-300))
    out = np.square((d - d[np.arange(len(x)), own][:, None]) / (2 * pair[own]))
    out[np.arange(len(x)), own] = 0
    return out


def _visits(a: np.ndarray, b: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, codes of one half and codes of the other whose border distances add up to no more than the bound.

    Multi-sequence traversal: codes of either half in the order of their distances; each row goes through those of the
    first half as long as they are within the bound, and through those of the second that the rest allows.
    """
    p, q = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
    a, b = np.take_along_axis(a, p, 1), np.take_along_axis(b, q, 1)
    b = b[:, : int((b <= bound).sum(1).max(initial=0))]
    out, live = [], np.arange(len(a))
    for i in range(a.shape[1]):
        live = live[a[live, i] <= bound]
        if not len(live):
            break
        r, j = np.nonzero(a[live, i][:, None] + b[live] <= bound)
        out.append((live[r], p[live[r], i], q[live[r], j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of a bounded sample; empty codes are dropped."""
    book = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(12):
        d = (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        book = total[n > 0] / n[n > 0][:, None]
    return book


def _fit(classes: DataFrame) -> Books:
    rng = np.random.default_rng(8)
    dims = {r["dim"]: r for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).collect()}  # one row per dimension
    out = {}
    for dim, r in dims.items():
        if dim < 2:
            continue
        got = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("cls", F.lit(8))).limit(FIT_ROWS).select("embedding").collect()
        x = np.array([v["embedding"] for v in got], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k = 1
        while k < CODES and (2 * k) ** 2 * PER_CELL <= r["n"] / max(1, r["labels"]):
            k *= 2
        h = dim // 2
        one, two = _codebook(x[:, :h], k, rng), _codebook(x[:, h:], k, rng)
        # the bound: how far across borders vectors at the threshold lie, for random directions
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        y = COSINE * x + np.sqrt(1 - COSINE**2) * away
        books = Books({dim: (one, two, 0.0)})
        a, b = books.near(x)
        c, d = books.near(y)
        need = a[np.arange(len(x)), c.argmin(1)] + b[np.arange(len(x)), d.argmin(1)]
        out[dim] = (one, two, float(np.quantile(need, RECALL)) * 1.2 + 1e-12)
    return Books(out)


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # very large and very small components don't overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(classes: DataFrame, books: Books) -> DataFrame:
    """(cls, label, dim, cell, role): a row for the home cell, role 0, and one for each cell to visit, role 1, home included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, rows in pdf.groupby("dim"):
                ids, n = rows["cls"].to_numpy(), len(rows)
                if dim not in books.by_dim:
                    at = np.concatenate([np.arange(n), np.arange(n)])
                    cell, role = np.zeros(2 * n, np.int64), np.repeat([0, 1], n)
                else:
                    parts = []
                    one, two, bound = books.by_dim[dim]
                    for lo in range(0, n, 512):
                        a, b = books.near(_unit(rows["embedding"].iloc[lo : lo + 512]))
                        r, i, j = _visits(a, b, bound)
                        home = a.argmin(1) * len(two) + b.argmin(1)
                        parts.append((np.arange(len(a)) + lo, home, np.zeros(len(a), int)))
                        parts.append((r + lo, i * len(two) + j, np.ones(len(r), int)))
                    at, cell, role = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pd.DataFrame({"cls": ids[at], "label": rows["label"].to_numpy()[at], "dim": dim, "cell": cell, "role": role, "k": rows["k"].to_numpy()[at], "embedding": rows["embedding"].to_numpy()[at]})

    return classes.select("cls", "label", "dim", "k", "embedding").mapInPandas(run, "cls long, label long, dim int, cell long, role int, k long, embedding array<double>")


def _spanning(p: np.ndarray, h: np.ndarray, n_p: int, n_h: int) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of both sides of a bipartite set of matches: numbers of home rows."""
    lp, lh = np.full(n_p, n_h), np.arange(n_h)
    while True:
        before = lh.copy()
        np.minimum.at(lp, p, lh[h])
        np.minimum.at(lh, h, lp[p])
        lh = lh[lh]
        if (lh == before).all():
            np.minimum.at(lp, p, lh[h])
            return lp, lh


def _compared(cells: DataFrame, books: Books) -> DataFrame:
    """Partial results of every block: (cls, links, root): links counted for cls, and a class that it is linked to or itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, k, x, near = None, None, None, None, None
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for now, rows in pdf.groupby(["label", "dim", "cell", "block"], sort=False):
                if now != key:
                    key, x, held = now, None, []
                home, seek = rows[rows["role"] == 0], rows[rows["role"] == 1]
                if len(home):
                    held.append(home)
                if not len(seek) or not held:
                    continue
                if x is None:
                    both = pd.concat(held)
                    ids, k, x = both["cls"].to_numpy(), both["k"].to_numpy(), _unit(both["embedding"])
                    near = books.near(x) if now[1] in books.by_dim else None
                for lo in range(0, len(seek), 1024):
                    part = seek.iloc[lo : lo + 1024]
                    y, own, ky = _unit(part["embedding"]), part["cls"].to_numpy(), part["k"].to_numpy()
                    p, h = np.nonzero(y @ x.T >= COSINE)
                    other = own[p] != ids[h]
                    p, h = p[other], h[other]
                    if not len(p):
                        continue
                    links = np.bincount(p, k[h], len(own)).astype(np.int64)
                    back = np.zeros(len(ids), np.int64)
                    if near is not None:
                        # home vectors that don't visit the other's cell in turn get their side of the link here
                        a, b = books.near(y)
                        cell_a, cell_b = a.argmin(1)[p], b.argmin(1)[p]
                        silent = near[0][h, cell_a] + near[1][h, cell_b] > books.by_dim[now[1]][2]
                        back = np.bincount(h[silent], ky[p[silent]], len(ids)).astype(np.int64)
                    lp, lh = _spanning(p, h, len(own), len(ids))
                    f, g = np.unique(p), np.unique(h)
                    yield pd.DataFrame({"cls": np.concatenate([own[f], ids[g]]), "links": np.concatenate([links[f], back[g]]), "root": np.concatenate([ids[lp[f]], ids[lh[g]]])})

    return cells.mapInPandas(run, "cls long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of df.

    Rows of equal labels link at a cosine of 0.98 or more in double precision. A null label, and a vector that is null,
    empty, zero or has null or non-finite components, links with nothing. Vectors of different lengths don't link. Equal
    vectors are one class with a count, so copies are never paired. n_links counts rows, without the row itself;
    component_id is the smallest id reachable (null only if none has an id); kept is vec_id = component_id.
    """
    ok = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    clean = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", "label", "v", F.when(F.coalesce(ok & clean, F.lit(False)), F.xxhash64("label", F.size("v"), F.transform("v", lambda x: x + F.lit(0.0)))).alias("cls"))
    valid = rows.where("cls IS NOT NULL")
    classes = written(valid.groupBy("cls").agg(F.first("label").alias("label"), F.first("v").alias("embedding"), F.count("*").alias("k"), F.min("vec_id").alias("first_id")).withColumn("dim", F.size("embedding")), "embedding-classes")
    books = _fit(classes)
    cells = written(_cells(classes, books), "embedding-cells")
    place = ["label", "dim", "cell"]
    large = cells.where("role = 0").groupBy(*place).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).where("blocks > 1").drop("n")
    # home rows of a large cell are dealt over its blocks, those that visit it go to all of them
    dealt = cells.join(written(large, "embedding-large"), place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    ready = dealt.withColumn("block", F.explode(block)).drop("blocks").repartition(*place, "block").sortWithinPartitions(*place, "block", "role")
    found = written(_compared(ready, books), "embedding-links")
    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    nodes = written(connected(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct()), "embedding-components")
    named = classes.select("cls", "k", "first_id").join(nodes.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(sums, "cls", "left")
    least = named.groupBy("component").agg(F.min("first_id").alias("least"))
    known = named.join(least, "component").select("cls", (F.col("k") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "least")
    out = rows.select("vec_id", "cls").join(known, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
