"""Operator 6: an interpolated modified Kneser-Ney model of words, of order 3 or 2.

Words and trigrams are counted by Spark jobs whose rows are packed, sorted arrays of one shard. Trigrams are dealt by
their middle word: then a shard holds, for each of its words v, all trigrams u v w, so the counts of the contexts (u, v),
the words that come before each (v, w) and all facts of v are found where they lie. Middle words that would fill half a
shard are dealt by (u, v), and only their pairs (v, w) are summed by a second exchange. The model is a set of sorted
arrays, 64-bit hashes of words and 32-bit ids in n-grams, that workers map into memory and search for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.arrays import Store, bundle, filled, merge, pack, pack_sorted, store, unbundled, unpack, unpack_sorted
from folioforge.llm.common import crc_mod, mix64, prepared, table, with_columns, word_hashes

#: Hashes that stand for the text's end and its start. No word has these but by a collision of 64 bits.
END, START = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x57A2757A2757A275)
#: Tokens that a task gathers before it sorts them; characters of text for each shard, and shards at most (shards grow
#: from there); parts over which the pairs of frequent words are dealt at most; the least count of such words.
GATHER, SHARD_CHARS, SHARDS, PARTS, HOT_LEAST = 4_000_000, 16_000_000, 4096, 256, 1000
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Model:
    order: int
    words: Store  # per shard: hashes, counts
    grams: Store  # per shard and per part of the frequent words: the arrays of a bundle
    starts: np.ndarray  # id of the first word of each word shard, and of the end
    hot: np.ndarray  # sorted ids of the words whose trigrams are dealt by their first two words
    hot_facts: np.ndarray  # for each of these what FACTS names
    parts: int
    tokens: int
    distinct: int
    end_before: int  # distinct words before the end of a text
    kinds: int  # distinct bigrams
    discounts: np.ndarray  # by level, 1 to 3, and by count 0, 1, 2, 3 or more
    spare: float  # share of the unigram level that goes to the uniform distribution


#: Columns of a word's facts: the sum of its pairs' values, its pairs of value 1, 2, 3 or more, the words before it.
FACTS = 5


def _shard_bits(shards: int) -> int:
    return shards.bit_length() - 1


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(64 - _shard_bits(shards))).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)


def _gram_shard(v: np.ndarray, u: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    by = np.where(np.isin(v, hot), (v.astype(np.uint64) << np.uint64(32)) | u.astype(np.uint64), v.astype(np.uint64)) if len(hot) else v.astype(np.uint64)
    return (mix64(by + np.uint64(1)) & np.uint64(shards - 1)).astype(np.int64)


def _pair_part(v: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    return (mix64((v.astype(np.uint64) << np.uint64(32)) ^ w.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _split(part: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(shards + 1))
    return [(s, order[ends[s] : ends[s + 1]]) for s in range(shards) if ends[s] < ends[s + 1]]


class _Lookup:
    def __init__(self, words: Store, starts: np.ndarray):
        self.words, self.starts, self.shards = words, starts, len(starts) - 1

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 for words that the training rows don't have."""
        u, back = np.unique(h, return_inverse=True)
        return self.of_sorted(u)[back]

    def of_sorted(self, u: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes: ids rise with hashes."""
        out = np.full(len(u), -1, np.int64)
        ends = np.searchsorted(_word_shard(u, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            lo, hi = ends[s], ends[s + 1]
            if lo < hi and self.starts[s] < self.starts[s + 1]:
                known = self.words.get(f"hash-{s}")
                at = np.searchsorted(known, u[lo:hi])
                at[at == len(known)] = 0
                out[lo:hi] = np.where(known[at] == u[lo:hi], at + self.starts[s], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """The counts of ids; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        ends = np.searchsorted(ids[order], self.starts)
        for s in range(self.shards):
            part = order[ends[s] : ends[s + 1]]
            if len(part):
                out[part] = self.words.get(f"count-{s}")[ids[part] - self.starts[s]]
        return out


# ---- arrays of a shard -----------------------------------------------------------------------------------------------


def _small(x: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes; 255 stands for those that are listed with their places."""
    over = np.flatnonzero(x >= 255)
    return [np.minimum(x, 255).astype(np.uint8), over.astype(np.uint32), x[over].astype(np.uint64)]


def _counts_at(small: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = small[0][at].astype(np.int64)
    over = out == 255
    if over.any():
        out[over] = small[2][np.searchsorted(small[1], at[over])]
    return out


def _lower(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number sought its place in the sorted a[lo:hi], and whether it is there."""
    lo, hi, end = lo.astype(np.int64), hi.astype(np.int64), hi
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = a[mid] < sought[open_]
        lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    hit = lo < end
    hit[hit] = a[lo[hit]] == sought[hit]
    return lo, hit


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], new])) if len(keys[0]) else np.empty(0, np.int64)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x.astype(np.int64), first) if len(first) else np.empty(0, np.int64)


#: Bits for a word's number within a batch, so that three make one number.
_CODE_BITS = 21


def _counted(h: np.ndarray, lengths: list[int], find: "_Lookup") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (v << 32 | u, w) of a batch of token hashes, and their counts. Ids rise with hashes, so numbers within the batch sort as ids do."""
    u, code = np.unique(np.append(h, START), return_inverse=True)
    ids = find.of_sorted(u).astype(np.uint64)
    one, start = code[:-1], int(code[-1])
    two = _before(one, lengths, start)
    three = _before(two, lengths, start)
    if len(u) >= 1 << _CODE_BITS:
        return _trigrams([((ids[two] << np.uint64(32)) | ids[three], ids[one].astype(np.uint32), np.ones(len(one), np.int64))])
    b, mask = np.uint64(_CODE_BITS), np.uint64((1 << _CODE_BITS) - 1)
    x = np.sort((two.astype(np.uint64) << (b + b)) | (three.astype(np.uint64) << b) | one.astype(np.uint64))
    first = _firsts(x)
    c, x = np.diff(np.append(first, len(x))), x[first]
    return (ids[x >> (b + b)] << np.uint64(32)) | ids[(x >> b) & mask], ids[x & mask].astype(np.uint32), c


def _trigrams(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (v << 32 | u, w) and the sums of their counts."""
    key, w, c = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((w, key))
    key, w, c = key[order], w[order], c[order]
    first = _firsts(key, w)
    return key[first], w[first], _sums(c, first)


def _pairs(v: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w, x = v[order], w[order], x[order]
    first = _firsts(v, w)
    return v[first], w[first], _sums(x, first)


def _pair_arrays(of: np.ndarray, v: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of sorted pairs: v's place in `of` and w as one number, and values; and the sums and kinds of those words."""
    ends = np.searchsorted(v, of, side="right")
    starts = np.searchsorted(v, of)
    total = np.concatenate([[0], np.cumsum(x)])
    facts = np.zeros((len(of), FACTS), np.int64)
    facts[:, 0] = total[ends] - total[starts]
    for k, mask in enumerate((x == 1, x == 2, x >= 3), 1):
        sums = np.concatenate([[0], np.cumsum(mask)])
        facts[:, k] = sums[ends] - sums[starts]
    return [_joined(np.repeat(np.arange(len(of)), ends - starts), w), *_small(x)], facts


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _found_in(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the number is there."""
    at = np.minimum(np.searchsorted(keys, sought), max(0, len(keys) - 1))
    return at, keys[at] == sought if len(keys) else np.zeros(len(sought), bool)


def _shard_arrays(key: np.ndarray, w: np.ndarray, c: np.ndarray, hot: np.ndarray, order: int):
    """The arrays of a shard's trigrams, the facts of its words, and the pairs of hot words, which other shards have too.

    Arrays: words; pairs (the first word's place and the second word), values (3); facts; contexts (the second word's
    place and the first word); places of contexts seen more than once; their starts, sums, kinds 1, kinds 2; the word
    after each context seen once; the words after the others; their counts (3). For order 2 those of contexts are empty.
    """
    v, u = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64)
    first = _firsts(key)
    size, total = np.diff(np.append(first, len(key))), _sums(c, first)
    own = first[_firsts(v[first])] if len(first) else first
    of = v[own]
    ends = np.searchsorted(v[first], of, side="right")
    pv, pw, px = _pairs(v, w.astype(np.int64), np.ones(len(v), np.int64) if order == 3 else c)
    shared = np.isin(pv, hot)
    pairs, facts = _pair_arrays(of, pv[~shared], pw[~shared], px[~shared])
    facts[:, 4] = np.diff(np.concatenate([[0], ends]))
    big = total > 1
    of_big = np.repeat(big, size)
    starts = np.concatenate([[0], np.cumsum(size[big])])
    contexts = [_joined(np.repeat(np.arange(len(of)), facts[:, 4]), u[first]), np.flatnonzero(big), starts, total[big], _sums(c == 1, first)[big], _sums(c == 2, first)[big], w[~of_big], w[of_big]]
    if order == 2:
        contexts, of_big = [x[:0] for x in contexts], of_big[:0]
    many = c[of_big] if order == 3 else c[:0]
    # facts are of words that don't fill a shard, so 32 bits hold them; those of hot words are kept apart
    arrays = [of.astype(np.uint32), *pairs, np.minimum(facts, _LOW).reshape(-1).astype(np.uint32), contexts[0], *[x.astype(np.uint32) for x in contexts[1:3]], contexts[3].astype(np.uint64), *[x.astype(np.uint32) for x in contexts[4:]], *_small(many)]
    return arrays, of, facts, (pv[~shared], pw[~shared], px[~shared]), (pv[shared], pw[shared], px[shared])


def _kinds(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


def _gathered(texts, size: int = GATHER) -> Iterator[tuple[list[int], np.ndarray]]:
    """Token hashes of many texts at a time: the number of tokens of each text, its words and one end, and all of them."""
    lengths, parts, n = [], [], 0
    end = np.array([END])
    for t in texts:
        h = word_hashes(t)
        parts += [h, end]
        lengths.append(len(h) + 1)
        n += len(h) + 1
        if n >= size:
            yield lengths, np.concatenate(parts)
            lengths, parts, n = [], [], 0
    if lengths:
        yield lengths, np.concatenate(parts)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[str]:
    for pdf in batches:
        yield from pdf["text"]


def _before(ids: np.ndarray, lengths: list[int], start: int) -> np.ndarray:
    """The id before each token of its text; the start before the first."""
    prev = np.concatenate([[start], ids[:-1]])
    prev[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = start
    return prev


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows of each shard, whole, from batches that are sorted by shard."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for shard, rows in pdf.groupby("shard", sort=True):
            if held and held[0]["shard"].iloc[0] != shard:
                yield int(held[0]["shard"].iloc[0]), pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield int(held[0]["shard"].iloc[0]), pd.concat(held)


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.repartition(shards, "shard").sortWithinPartitions("shard")


def _discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of n-grams with count 1 to 4; a class without members takes 0.5, 1 and 1.5 at most."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0] + [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)])


def fit(docs: DataFrame, text: str = "text", order: int = 3) -> Model:
    """The model of all rows' texts: lower-cased words and one end for each text, after order - 1 starts; null texts are empty.

    The highest order counts n-grams, the lower ones the distinct words before them.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = prepared(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = min(SHARDS, 1 << max(2, (chars // SHARD_CHARS).bit_length()))
    words, grams = store(spark, "lm-words"), store(spark, "lm-grams")

    def count_words(batches):
        for _, h in _gathered(_texts(batches)):
            k, c = np.unique(h, return_counts=True)
            rows = [(s, pack_sorted(k[i]), pack(c[i].astype(np.uint32))) for s, i in _split(_word_shard(k, shards), shards)]
            yield pd.DataFrame(rows, columns=["shard", "k", "c"])

    def merge_words(batches):
        for shard, rows in _grouped(batches):
            k, c = merge([unpack_sorted(x, np.uint64) for x in rows["k"]], [unpack(x, np.uint32).astype(np.int64) for x in rows["c"]])
            if shard == int(_word_shard(np.array([START]), shards)[0]):  # the start is a context, but no token
                k, c = merge([k, np.array([START])], [c, np.array([0])])
            made = [words.put(f"hash-{shard}", k), words.put(f"count-{shard}", c)]
            yield pd.DataFrame([(n, d, shard, len(k), int((c > 0).sum()), int(c.sum())) if j == 0 else (n, d, shard, 0, 0, 0) for j, (n, d) in enumerate(made)], columns=["name", "data", "shard", "entries", "kinds", "tokens"])

    counted = docs.mapInPandas(count_words, "shard int, k binary, c binary")
    seed = spark.range(1).selectExpr(f"{int(_word_shard(np.array([START]), shards)[0])} AS shard").mapInPandas(lambda it: (p.assign(k=pack_sorted(np.array([START])), c=pack(np.zeros(1, np.uint32))) for p in it), "shard int, k binary, c binary")
    rows, words = filled(spark, _by_shard(counted.unionByName(seed), shards).mapInPandas(merge_words, "name string, data binary, shard int, entries long, kinds long, tokens long"), words, "lm-words-rows")
    by = {r["shard"]: r for r in rows.groupBy("shard").agg(*[F.sum(c).alias(c) for c in ("entries", "kinds", "tokens")]).collect()}  # one row for each shard
    starts = np.concatenate([[0], np.cumsum([by[s]["entries"] if s in by else 0 for s in range(shards)])])
    tokens, distinct = sum(r["tokens"] for r in by.values()), sum(r["kinds"] for r in by.values())
    if starts[-1] >= 1 << 32:
        raise ValueError("the vocabulary has over 2**32 words: bigram keys need wider ids")
    find = _Lookup(words, starts)

    def frequent(batches):
        for pdf in batches:
            for s in pdf["shard"]:
                c = words.get(f"count-{s}")
                i = np.flatnonzero(c > max(HOT_LEAST, tokens // (2 * shards)))
                yield pd.DataFrame({"id": i + starts[s]})

    present = sorted(by)
    hot = spark.createDataFrame([(s,) for s in present] or [(0,)], "shard int").where("shard >= 0").repartition(len(present) or 1).mapInPandas(frequent, "id long") if present else None
    hot = [r["id"] for r in hot.collect()] if hot is not None else []  # at most 2 * shards words
    hot = np.union1d(np.array(hot, np.int64), find.ids(np.array([START])))  # the start precedes every text
    parts = min(shards, PARTS)

    def count_grams(batches):
        for lengths, h in _gathered(_texts(batches)):
            key, w, c = _counted(h, lengths, find)
            shard = _gram_shard((key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64), shards, hot)
            rows = [(s, pack_sorted(key[i]), pack(w[i]), pack(c[i].astype(np.uint32))) for s, i in _split(shard, shards)]
            yield pd.DataFrame(rows, columns=["shard", "a", "b", "c"])

    columns = ["name", "data", "part", "a", "b", "v", "facts", "kinds"]

    def merge_grams(batches):
        ends = int(find.ids(np.array([END]))[0])
        for shard, rows in _grouped(batches):
            key, w, c = _trigrams([(unpack_sorted(a, np.uint64), unpack(b, np.uint32), unpack(x, np.uint32).astype(np.int64)) for a, b, x in zip(rows["a"], rows["b"], rows["c"], strict=True)])
            arrays, of, facts, plain, shared = _shard_arrays(key, w, c, hot, order)
            name, data = grams.put(f"grams-{shard}", bundle(arrays))
            own = ~np.isin(of, hot)
            came = facts[own, 4]
            out = [(name, data, -1, None, None, None, None, [*_kinds(c), *_kinds(plain[2]), *_kinds(came), int((came >= 3).sum()), int(came.sum()), int((plain[1] == ends).sum())])]
            out += [(None, None, -1, None, None, int(v), [0, 0, 0, 0, int(n)], None) for v, n in zip(of[~own], facts[~own, 4], strict=True)]
            pv, pw, px = shared
            for p, i in _split(_pair_part(pv, pw, parts), parts):
                out.append((None, None, p, pack_sorted((pv[i].astype(np.uint64) << np.uint64(32)) | pw[i].astype(np.uint64)), pack(px[i].astype(np.uint32)), None, None, None))
            yield pd.DataFrame(out, columns=columns).astype({"v": "Int64"})

    def merge_shared(batches):
        ends = int(find.ids(np.array([END]))[0])
        for part, rows in _grouped(batches):
            keys = [unpack_sorted(a, np.uint64) for a in rows["a"]]
            key, x = merge(keys, [unpack(b, np.uint32).astype(np.int64) for b in rows["b"]])
            v, w = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64)
            arrays, facts = _pair_arrays(hot, v, w, x)
            name, data = grams.put(f"shared-{part}", bundle(arrays))
            out = [(name, data, -1, None, None, None, None, [0, 0, 0, 0, *_kinds(x), 0, 0, 0, 0, 0, 0, int((w == ends).sum())])]
            out += [(None, None, -1, None, None, int(h), [int(k) for k in f], None) for h, f in zip(hot, facts, strict=True) if f[0]]
            yield pd.DataFrame(out, columns=columns).astype({"v": "Int64"})

    form = "name string, data binary, part int, a binary, b binary, v long, facts array<long>, kinds array<long>"
    counted = docs.mapInPandas(count_grams, "shard int, a binary, b binary, c binary")
    one, at = filled(spark, _by_shard(counted, shards).mapInPandas(merge_grams, form), grams, "lm-grams-rows")
    passed = one.where("part >= 0").select(F.col("part").alias("shard"), "a", "b")
    two, at_two = filled(spark, _by_shard(passed, parts).mapInPandas(merge_shared, form), grams, "lm-shared-rows")
    grams = replace(at, shipped=(*at.shipped, *at_two.shipped))
    rows = one.unionByName(two)
    kinds = np.array(rows.where("kinds IS NOT NULL").select(*[F.coalesce(F.sum(F.col("kinds")[k]), F.lit(0)) for k in range(15)]).first(), np.int64)
    sums = rows.where("v IS NOT NULL").groupBy("v").agg(*[F.sum(F.col("facts")[k]).alias(f"f{k}") for k in range(FACTS)]).collect()  # one row for each hot word
    hot_facts = np.zeros((len(hot), FACTS), np.int64)
    for r in sums:
        hot_facts[np.searchsorted(hot, r["v"])] = [r[f"f{k}"] for k in range(FACTS)]
    # the unigram level: the words before each word, those of hot words and of the end added; the start is none
    start = int(find.ids(np.array([START]))[0])
    end_before = int(kinds[14])
    more = np.array([*hot_facts[hot != start, 4], end_before], np.int64)
    more = more[more > 0]
    uni, three, total = kinds[8:12] + np.array(_kinds(more)), int(kinds[12] + (more >= 3).sum()), int(kinds[13] + more.sum())
    discounts = np.stack([_discounts(uni.tolist()), _discounts(kinds[4:8].tolist()), _discounts(kinds[0:4].tolist())])
    spare = float(discounts[0, 1:] @ np.array([uni[0], uni[1], three], float)) / total if total else 1.0
    return Model(order, words, grams, starts, hot, hot_facts, parts, int(tokens), int(distinct), end_before, total, discounts, spare)


class Scorer:
    """Scores batches of texts in a worker."""

    def __init__(self, model: Model):
        self.m, self.find = model, _Lookup(model.words, model.starts)
        self.start, self.end = (int(i) for i in self.find.ids(np.array([START, END])))

    def _arrays(self, name: str) -> list[np.ndarray] | None:
        try:
            return unbundled(self.m.grams.get(name))
        except FileNotFoundError:  # a shard without n-grams
            return None

    def _placed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct ids: their facts, zeros for those that precede nothing; whether they are hot; their shard and their place in it, -1 for none."""
        m, shards = self.m, self.find.shards
        facts, place = np.zeros((len(ids), FACTS), np.int64), np.full(len(ids), -1, np.int64)
        hot = np.isin(ids, m.hot)
        shard = _gram_shard(ids, np.zeros(len(ids), np.int64), shards, np.empty(0, np.int64))
        for s, i in _split(shard, shards):
            g = self._arrays(f"grams-{s}")
            if g is not None and len(g[0]):
                at, hit = _found_in(g[0], ids[i])
                facts[i[hit]] = g[5].reshape(-1, FACTS)[at[hit]]
                place[i[hit]] = at[hit]
        facts[hot] = m.hot_facts[np.searchsorted(m.hot, ids[hot])]
        facts[ids == self.end, 4] = m.end_before
        return facts, hot, shard, place

    def _pair_values(self, keys: np.ndarray, g: list[np.ndarray], first: int) -> np.ndarray:
        at, hit = _found_in(g[first], keys)
        out = np.zeros(len(keys), np.int64)
        out[hit] = _counts_at(g[first + 1 : first + 4], at[hit])
        return out

    def _found(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray, shard: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For tokens w after known words u, v: values of pairs (v, w); counts of trigrams, sums and kinds 1, 2, 3 of contexts. u and w may be -1. hot, shard and place are v's."""
        m = self.m
        pair, tri = np.zeros(len(w), np.int64), np.zeros((len(w), 5), np.int64)
        some = np.flatnonzero(hot)
        if len(some):
            shard, place = shard.copy(), place.copy()
            shard[some] = _gram_shard(v[some], u[some], self.find.shards, m.hot)
            for p, i in _split(_pair_part(v[some], w[some], m.parts), m.parts):
                g = self._arrays(f"shared-{p}")
                if g is not None:
                    i = some[i]
                    pair[i] = self._pair_values(_joined(np.searchsorted(m.hot, v[i]), w[i]), g, 0)
        for s, i in _split(shard, self.find.shards):
            g = self._arrays(f"grams-{s}")
            if g is None or not len(g[0]):
                continue
            mine = i[hot[i]]
            at, hit = _found_in(g[0], v[mine])
            place[mine] = np.where(hit, at, -1)
            i = i[place[i] >= 0]
            plain = i[~hot[i]]
            pair[plain] = self._pair_values(_joined(place[plain], w[plain]), g, 1)
            if m.order == 2:
                continue
            at, hit = _found_in(g[6], _joined(place[i], u[i]))
            hit &= u[i] >= 0
            i, at = i[hit], at[hit]
            b = np.searchsorted(g[7], at)
            big = np.zeros(len(at), bool)
            inside = b < len(g[7])
            big[inside] = g[7][b[inside]] == at[inside]
            once, many = i[~big], i[big]
            tri[once, 0] = g[12][at[~big] - b[~big]] == w[once]
            tri[once, 1:3] = 1
            b = b[big]
            lo, hi = g[8][b].astype(np.int64), g[8][b + 1].astype(np.int64)
            spot, there = _lower(g[13], lo, hi, w[many])
            tri[many[there], 0] = _counts_at(g[14:17], spot[there])
            tri[many, 1], tri[many, 2], tri[many, 3] = g[9][b], g[10][b], g[11][b]
            tri[many, 4] = hi - lo - tri[many, 2] - tri[many, 3]
        return pair, tri

    def __call__(self, lengths: list[int], h: np.ndarray) -> np.ndarray:
        """For each text: tokens, known tokens, base score, score."""
        m = self.m
        words, back = np.unique(np.append(h, START), return_inverse=True)
        distinct = self.find.of_sorted(words)
        back, start = back[:-1], int(back[-1])
        count = self.find.counts(distinct)
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.distinct + 1)))[back]
        known = (count > 0)[back]
        if m.kinds:
            facts, hot, shard, place = self._placed(distinct)
            before = facts[:, 4]
            uni = np.maximum(before - m.discounts[0][np.minimum(before, 3)], 0) / m.kinds + m.spare / (m.distinct + 1)
            mass = facts[:, 1:4] @ m.discounts[1][1:]
            row = _before(back, lengths, start)
            ids, v, u = distinct[back], distinct[row], distinct[_before(row, lengths, start)]
            seen = np.flatnonzero(v >= 0)
            pair, tri = np.zeros(len(ids), np.int64), np.zeros((len(ids), 5), np.int64)
            pair[seen], tri[seen] = self._found(u[seen], v[seen], ids[seen], hot[row[seen]], shard[row[seen]], place[row[seen]])
            total = facts[row, 0]
            p = uni[back]
            p = np.where(total > 0, (np.maximum(pair - m.discounts[1][np.minimum(pair, 3)], 0) + mass[row] * p) / np.maximum(total, 1), p)
            if m.order == 3:
                held = np.maximum(tri[:, 1], 1)
                p = np.where(tri[:, 1] > 0, (np.maximum(tri[:, 0] - m.discounts[2][np.minimum(tri[:, 0], 3)], 0) + (tri[:, 2:5] @ m.discounts[2][1:]) * p) / held, p)
        else:
            p = np.full(len(h), 1 / (m.distinct + 1))
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.column_stack([lengths, np.add.reduceat(known.astype(float), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)])


MADE = "n_tokens long, n_known long, base_score double, score double"


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of df; a null text is an empty one: its end alone is scored.

    score is the log10 probability of the text: of every word given those before it, the first given the start, and of
    the end. Perplexity is 10 ** (-score / n_tokens). Unknown words get the uniform share of the unigram level.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("lm_text"))

    def make():
        scorer = Scorer(model)

        def step(texts: list) -> list[list]:
            got = [scorer(lengths, h) for lengths, h in _gathered(texts, GATHER // 4)]
            made = np.concatenate(got) if got else np.empty((0, 4))
            return [made[:, 0].astype(np.int64), made[:, 1].astype(np.int64), made[:, 2], made[:, 3]]

        return step

    return with_columns(rows, "lm_text", make, MADE).drop("lm_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(crc_mod(F.col("doc_id"), 5) != 1))
    out = score(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
