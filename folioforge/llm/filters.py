"""Operator 13: how filters of documents interact, in every order in which they can stand.

A document enters as the set of filters that it fails, a mask. Documents are counted by part and mask, a table of at
most 2**n cells a part; all orders are then visited by single swaps of neighbours, of which each changes two steps only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.llm.common import prepared, table

UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: The letters of the filters in the order of their bits; the last is the one for repeated texts, which no text shows by itself.
LETTERS = "ABCDE"
#: Documents without an id are dealt over so many keys in the join with the labels.
SALTS = 1024
#: Parts whose orders a worker holds at once.
PARTS = 64


def failures(text: str) -> int:
    """The filters A to D that a text fails, as bits from the lowest: few words, repeated words, capitals, symbols."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the six ASCII white-space characters
    capitals = len(data) - len(data.translate(None, UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * len(text)) << 2 | (len(data.translate(None, SYMBOLS)) < len(data)) << 3


def masks(df: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source", fails: Callable[[str], int] = failures) -> DataFrame:
    """(doc_id, part, digest, mask): the failed filters and 128 bits of hash of every whole text; a null text is empty, a null part the empty string."""
    prepared(df.sparkSession)
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array([fails(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "mask"])

    return named.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def cells(masked: DataFrame, labels: DataFrame, repeated: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, with bit `repeated` for a text that a smaller doc_id has too.

    No text meets its copies: equal rows are summed first, then the rows of a text within a part, and what is compared
    over parts is one row for each part that has the text. A document without an id repeats none and is repeated by
    none; rows that share id and text don't repeat each other. A document is good (toxic) if any of its labels says so.
    """
    rows = masked.groupBy("doc_id", "digest", "part").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(0))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    labelled = rows.join(known, ["doc_id", "salt"], "left")
    sums = F.struct("n", (F.coalesce("good", F.lit(0)) * F.col("n")).alias("good"), (F.coalesce("toxic", F.lit(0)) * F.col("n")).alias("toxic"))
    each = labelled.select("digest", "part", "mask", "doc_id", sums.alias("s"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    total = lambda c, where: F.sum(F.when(where, F.col(f"s.{c}")).otherwise(0)).alias(c)
    texts = each.groupBy("digest", "part").agg(
        F.first("mask").alias("mask"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("s", "doc_id"), zero).alias("first"),
        F.struct(*[total(c, F.lit(True)) for c in ("n", "good", "toxic")]).alias("all"),
        F.struct(*[total(c, F.col("doc_id").isNull()) for c in ("n", "good", "toxic")]).alias("nameless"),
    )
    leads = F.coalesce(F.col("least") == F.min("least").over(W.partitionBy("digest")), F.lit(False))
    told = texts.withColumn("leads", leads)
    own = lambda c: F.col(f"nameless.{c}") + F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0)
    new = F.struct(F.col("mask").alias("mask"), *[own(c).alias(c) for c in ("n", "good", "toxic")])
    again = F.struct(F.col("mask").bitwiseOR(F.lit(1 << repeated)).alias("mask"), *[(F.col(f"all.{c}") - own(c)).alias(c) for c in ("n", "good", "toxic")])
    split = told.select("part", F.explode(F.array(new, again)).alias("c")).select("part", "c.*")
    return split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def swaps(n: int) -> Iterator[int]:
    """The places i of the swaps of i and i + 1 that lead from the identity through all orders of n things, each once.

    Steinhaus, Johnson and Trotter: the greatest thing that can move its way (past a smaller neighbour) does, and all
    greater ones turn round.
    """
    order, way = list(range(n)), [-1] * n
    while True:
        free = [x for x in range(n) if 0 <= (at := order.index(x)) + way[x] < n and order[at + way[x]] < x]
        if not free:
            return
        x = max(free)
        at = order.index(x)
        to = at + way[x]
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield min(at, to)


class Walk:
    """The steps of one order over the cells of many parts; swap() goes to a neighbouring order.

    cells: parts x measures x 2**n, the first measure being the count. removed[k], kept[k] and redundant[k] belong to
    step k. Where two neighbours change places, what stood before them and what is left after them stays as it was.
    """

    def __init__(self, counts: np.ndarray, n: int):
        self.counts, self.n, self.order = counts, n, list(range(n))
        self.sets = np.arange(1 << n)
        self.failing = np.stack([counts[:, 0] @ (self.sets >> f & 1) for f in range(n)])
        self.removed = np.zeros((n, *counts.shape[:2]), np.int64)
        self.kept = np.zeros((n, len(counts)), np.int64)
        self.shapley = np.zeros((n, len(counts)), np.int64)
        for k in range(n):
            self._step(k)
        self._count()

    def _step(self, k: int) -> None:
        before = sum(1 << f for f in self.order[:k])
        f = self.order[k]
        self.removed[k] = self.counts @ ((self.sets & before == 0) & (self.sets >> f & 1 == 1)).astype(np.int64)
        self.kept[k] = (self.kept[k - 1] if k else self.counts[:, 0].sum(1)) - self.removed[k, :, 0]

    def _count(self) -> None:
        self.shapley[self.order] += self.removed[:, :, 0]

    def swap(self, i: int) -> None:
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self._step(i)
        self._step(i + 1)
        self._count()

    def rows(self) -> dict[str, np.ndarray]:
        """The current order's steps, part by part: parts x n arrays."""
        gone, failing = self.removed, self.failing[self.order]
        unique = np.stack([self.counts[:, 0, 1 << f] for f in self.order])
        named = {"kept": self.kept, "removed": gone[:, :, 0], "redundant": failing - gone[:, :, 0], "unique_fails": unique, "good_lost": gone[:, :, 1], "toxic_lost": gone[:, :, 2]}
        return {k: v.T.copy() for k, v in named.items()}


MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def orders(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, measures): every step of every order of the filters for every part of a table of cells."""
    n = len(letters)
    packed = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2**n at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PARTS):
                parts, held = (c.to_pylist() for c in b.slice(lo, PARTS).columns)
                counts = np.zeros((len(parts), 3, 1 << n), np.int64)
                for p, own in enumerate(held):
                    for c in own:
                        counts[p, :, c["mask"]] += (c["n"], c["good"], c["toxic"])
                walk = Walk(counts, n)
                seen = [("".join(letters[f] for f in walk.order), list(walk.order), walk.rows())]
                for i in swaps(n):
                    walk.swap(i)
                    seen.append(("".join(letters[f] for f in walk.order), list(walk.order), walk.rows()))
                for name, order, rows in seen:
                    size = len(parts) * n
                    columns = [pa.array(np.repeat(np.array(parts, object), n), pa.string()), pa.array([name] * size, pa.string()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(parts)))]
                    columns += [pa.array(rows[m].reshape(-1)) for m in MEASURES] + [pa.array(walk.shapley[order].T.reshape(-1))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *MEASURES, "shapley"])

    return packed.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES) + ", shapley long")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), for each part, order and step.

    Filters: A fewer than 50 words, B under 65 % distinct words, C over 5 % capitals, D a symbol of #$%&*|, E the text of
    a smaller id. Null texts are empty, null parts the empty string, repeated rows count each, no rows give no rows.
    Of df only the three named columns are read, so others may have any name; labels may be empty, repeat documents or
    name unknown ones.
    """
    return orders(cells(masks(df, id_col, text, part), labels, LETTERS.index("E")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH RECURSIVE seen AS (
  SELECT coalesce(source, '') AS part, coalesce(text, '') AS t, doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(s.doc_id > least, false)::INT AS mask
  FROM seen s LEFT JOIN marks m ON s.doc_id = m.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask
), letters(f, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders(o, used) AS (
  SELECT '', 0 UNION ALL SELECT o || f, used + bit FROM orders, letters WHERE used & bit = 0
), steps AS (
  SELECT o AS filter_order, step::INT AS step, bit,
    coalesce((SELECT sum(p.bit) FROM letters p WHERE strpos(o, p.f) < step), 0)::INT AS before
  FROM (SELECT o FROM orders WHERE used = 31), range(1, 6) r(step), letters WHERE f = o[step]
), counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM counted
"""
