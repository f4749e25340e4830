"""What a task does to rank rows for a block of queries: scores of a few rows with all queries of the block at once, and the best rows met so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Scores that are held at once, products that are added at once.
GRID, PRODUCTS = 1 << 20, 1 << 19
#: Words that at least this share of a block's queries asks for are scored as a dense matrix, the most frequent ones so many at most.
DENSE_SHARE, DENSE_WORDS = 0.1, 512


class Best:
    """The k best rows of each of n queries so far: of the highest key, of equal keys the smallest id.

    An offer is a grid of estimates (row, query) that lie within `slack` of the keys; the score and key of a cell are only
    asked for where its estimate can reach the k-th best key. An estimate of -inf is no candidate unless `every`.
    """

    def __init__(self, n: int, k: int, slack: float, every: bool = False):
        self.k, self.slack, self.every = k, slack, every
        self.floor = np.full(n, -np.inf)
        self.q, self.id, self.key, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)

    def offer(self, ids: np.ndarray, grid: np.ndarray, queries: np.ndarray | slice, exact: Callable) -> None:
        """grid: estimates of rows with the queries of these numbers; exact(rows, columns) gives their scores and keys."""
        low = self.floor[queries] - self.slack
        take = grid >= low if self.every else (grid >= low) & (grid > -np.inf)
        if len(ids) > self.k and np.count_nonzero(take) > 4 * self.k * grid.shape[1]:
            kth = np.partition(grid, len(ids) - self.k, axis=0)[len(ids) - self.k]
            # keys and estimates differ by the slack on both sides
            take &= grid >= np.where(np.isneginf(kth), kth, kth - 2 * self.slack)
        r, c = np.nonzero(take)
        if not len(r):
            return
        score, key = exact(r, c)
        q = np.arange(len(self.floor))[queries][c]
        q, i = np.concatenate([self.q, q]), np.concatenate([self.id, ids[r]])
        key, score = np.concatenate([self.key, key]), np.concatenate([self.score, score])
        order = np.lexsort((i, -key, q))
        first = np.flatnonzero(np.diff(q[order], prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.q, self.id, self.key, self.score = q[order], i[order], key[order], score[order]
        self.floor[self.q[rank == self.k - 1]] = self.key[rank == self.k - 1]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one behind the other, and the length of each list; null lists are empty."""
    at = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), at


# ---- words ------------------------------------------------------------------------------------------------------------


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, hashes of words with repeats) as (doc, length, distinct hashes, counts)."""
    for b in batches:
        flat, n = lists(b.column(1))
        ends = np.cumsum(n)
        each = [np.unique(flat[e - m : e], return_counts=True) for e, m in zip(ends, n, strict=True)]
        to = pa.array(np.cumsum([0, *(len(h) for h, _ in each)]).astype(np.int32))
        join = lambda j, kind: pa.ListArray.from_arrays(to, pa.array(np.concatenate([x[j] for x in each] or [np.empty(0)]).astype(kind)))  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(b.column(1).is_null().to_numpy(zero_copy_only=False), -1, n).astype(np.int32)), join(0, np.int64), join(1, np.int32)], names=["doc", "dl", "terms", "tfs"])


@dataclass(frozen=True)
class WordQueries:
    """A block of queries by the words that they ask for: sorted hashes, and for each the queries with their weights."""

    ids: np.ndarray
    terms: np.ndarray
    begin: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    dense: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, table: pa.Table) -> WordQueries:
        """table: query, terms (array of hashes), weights (array)."""
        column = lambda c: table.column(c).combine_chunks()
        flat, n = lists(column(1))
        weight = lists(column(2))[0]
        query = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.argsort(flat, kind="stable")
        terms, begin = np.unique(flat[order], return_index=True)
        begin = np.append(begin, len(flat))
        asked = np.diff(begin)
        often = np.argsort(-asked, kind="stable")[:DENSE_WORDS]
        dense = np.sort(often[asked[often] >= max(2, DENSE_SHARE * len(n))])
        return cls(column(0).to_numpy(zero_copy_only=False).astype(np.int64), terms, begin, query[order], weight[order], dense)

    def best(self, batches: Iterator[pa.RecordBatch], k: int, places: int, gain: float, flat_part: float, slope: float) -> Best:
        """batches of (doc, length, terms, counts); a document's weight of a word is gain * tf / (tf + flat_part + slope * length)."""
        n = len(self.ids)
        scale, best = 10.0**places, Best(n, k, 10.0**-places)
        matrix, place = np.zeros((len(self.dense), n)), np.full(len(self.terms), -1, np.int64)
        place[self.dense] = np.arange(len(self.dense))
        for row, t in enumerate(self.dense):
            at = slice(self.begin[t], self.begin[t + 1])
            matrix[row, self.query[at]] = self.weight[at]
        step = max(1, GRID // max(1, n))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                ids, dl = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy().astype(np.float64)
                h, m = lists(part.column(2))
                tf = lists(part.column(3))[0].astype(np.float64)
                doc = np.repeat(np.arange(len(m)), m)
                at = np.searchsorted(self.terms, h)
                hit = self.terms[np.minimum(at, len(self.terms) - 1)] == h if len(self.terms) else np.zeros(len(h), bool)
                doc, at, tf = doc[hit], at[hit], tf[hit]
                w = gain * tf / (tf + flat_part + slope * np.maximum(dl, 1)[doc])
                own = place[at]
                rows = np.zeros((len(m), len(self.dense)))
                rows[doc[own >= 0], own[own >= 0]] = w[own >= 0]
                grid = rows @ matrix
                self._add(grid.reshape(-1), doc[own < 0] * n, at[own < 0], w[own < 0])
                # a document without any word of the query is none of its rows
                grid[grid == 0] = -np.inf
                best.offer(ids, grid, slice(None), lambda r, c, g=grid: (g[r, c], np.floor(g[r, c] * scale + 0.5) / scale))
        return best

    def _add(self, grid: np.ndarray, base: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
        """Adds to the grid what each (place of a document's row, word, weight) gives the queries that ask for the word."""
        n = self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + PRODUCTS, "right")))
            m = n[lo:hi]
            total, before = int(m.sum()), np.cumsum(m) - m
            from_ = np.arange(total) + np.repeat(self.begin[at[lo:hi]] - before, m)
            cell = np.repeat(base[lo:hi], m) + self.query[from_]
            first, last = int(base[lo]), int(base[hi - 1]) + len(self.ids)
            grid[first:last] += np.bincount(cell - first, np.repeat(w[lo:hi], m) * self.weight[from_], last - first)
            lo = hi


# ---- vectors ----------------------------------------------------------------------------------------------------------


def _sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on: the same digits wherever a row stands."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
    return total


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: places in the column, vectors as rows, their norms, and which of them hold a null."""
    flat, n = lists(column)
    void = column.flatten().is_null().to_numpy(zero_copy_only=False)
    begin, there = np.cumsum(n) - n, ~column.is_null().to_numpy(zero_copy_only=False)
    for d in np.unique(n[there]):
        at = np.flatnonzero(there & (n == d))
        cells = begin[at][:, None] + np.arange(d)
        x = flat[cells].astype(np.float64) if d else np.zeros((len(at), 0))
        yield at, x, np.sqrt(_sequential(x, x)), void[cells].any(1) if d else np.zeros(len(at), bool)


class VectorQueries:
    """A block of queries by the length of their vectors."""

    #: Between these norms a product of matrices is as good as a sum in order but for its last digits.
    SAFE, SLACK = (1e-100, 1e100), 1e-9

    def __init__(self, table: pa.Table):
        """table: query, vector (array of double)."""
        column = table.column(1).combine_chunks()
        self.ids = table.column(0).to_numpy().astype(np.int64)
        self.by_length = {x.shape[1]: (at, x, norm, void, self._units(x, norm)) for at, x, norm, void in _vectors(column)}

    @classmethod
    def _units(cls, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Rows over their norms; not-a-number where a product of them says nothing."""
        safe = (norm > cls.SAFE[0]) & (norm < cls.SAFE[1])
        return np.where(safe[:, None], x / np.where(safe, norm, 1)[:, None], np.nan)

    def best(self, batches: Iterator[pa.RecordBatch], k: int) -> Best:
        """batches of (key, vector). A score is the cosine in double precision, -1 if a norm is zero; not-a-number comes first, a null (a vector that holds one) last."""
        best = Best(len(self.ids), k, self.SLACK, every=True)
        with np.errstate(all="ignore"):
            for b in batches:
                for at, x, norm, void in _vectors(b.column(1)):
                    if x.shape[1] not in self.by_length:
                        continue
                    queries, q, q_norm, q_void, q_unit = self.by_length[x.shape[1]]
                    ids, unit, step = b.column(0).to_numpy(zero_copy_only=False)[at], self._units(x, norm), max(1, GRID // len(queries))
                    for lo in range(0, len(at), step):
                        part = slice(lo, lo + step)
                        grid = unit[part] @ q_unit.T if x.shape[1] else np.full((len(ids[part]), len(queries)), np.nan)
                        grid[np.isnan(grid)] = np.inf
                        grid[norm[part] == 0] = -1
                        grid[:, q_norm == 0] = -1
                        grid[void[part]] = -np.inf
                        grid[:, q_void] = -np.inf

                        def exact(r, c, x=x[part], norm=norm[part], void=void[part], q=q, q_norm=q_norm, q_void=q_void):
                            out, step = np.empty(len(r)), 1 << 16
                            for i in range(0, len(r), step):
                                rr, cc = r[i : i + step], c[i : i + step]
                                n = norm[rr] * q_norm[cc]
                                out[i : i + step] = np.where(n == 0, -1.0, _sequential(x[rr], q[cc]) / n)
                            none = void[r] | q_void[c]
                            return out, np.where(none, -np.inf, np.where(np.isnan(out), np.inf, out))

                        best.offer(ids[part], grid, queries, exact)
        return best
