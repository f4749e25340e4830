"""Operator 2: n-gram Jaccard join by grouped prefixes.

Documents with equal shingle sets are one class. Classes of equal size and equal prefix (in one global order of
shingles) are one group; an index of the groups' prefix shingles gives group pairs, which length, position and sketch
filters thin; pairs that stay are expanded to classes and verified on whole shingle sets. All filters are exact: none
drops a pair of similarity 0.8 or more. As only components are asked for, a bucket is first linked through its leader,
and then only pairs of classes that are still apart are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.arrays import Store, filled, pack_sorted, store, unpack_sorted
from folioforge.llm.common import crc_mod, mix64, shingle_set, signed, table, unsigned, written
from folioforge.llm.components import connected
from folioforge.sources.shared import discard

WORDS = 5
#: Shingles that SAMPLE_HITS of the rows in one of SAMPLE_OF parts hold are put last in the order, the most frequent
#: ORDER_MOST of them (8 bytes each). Any order gives the same result; this one only keeps prefix buckets small.
SAMPLE_OF, SAMPLE_HITS, ORDER_MOST = 16, 3, 1 << 20
#: Rows that may be broadcast (under 64 bytes each); a leader's comparisons in one task.
BROADCAST_ROWS, CELL = 1_000_000, 128
#: Rows of a table of classes for each task, so that small tables are not dealt over more tasks than they need.
ROWS_A_TASK = 20_000
#: Fingerprints of prefix shingles: a shard holds about so many, a fingerprint has so many bits more than their number
#: needs (2 to the minus of which is the share of lone shingles that stay in the index), a task sorts so many at once.
#: Above so many shingles the index is made without them.
SHARD_TOKENS, SPARE_BITS, TOKENS_AT_ONCE, MOST_TOKENS = 1 << 20, 5, 1 << 19, 1 << 36

#: What the comparison within a bucket sees: a sketch of 256 slots, or for sets of up to FINE shingles one of 512, which
#: tells almost every shingle apart. Rows of a bucket in one block; pairs of two labels that a bucket offers at first, and
#: the factor by which that grows while there are more. Rows that a worker compares at once, and the rest of a bucket.
FINE, BLOCK, OFFER, GROWTH, ROWS_AT_ONCE = 256, 2048, 1, 8, 8192
_RECORD = "doc_id string, th long, n long, cls long, grp long, prefix array<long>, sketch array<long>, fold binary"


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _least_shared(n: int) -> int:
    """Shingles that a set of n must share with any set of similarity 0.8 or more."""
    return (4 * n + 4) // 5


def odd_sketch(s: np.ndarray, m: int = 0) -> np.ndarray:
    """Parities of the counts of shingles by slot, as 64-bit words; as many slots as shingles if m is 0. Two sketches of one size differ in no more bits than the sets in shingles."""
    m = m or max(64, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((mix64(s) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _records(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document with words: class, group, prefix and sketch."""
    last = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, place = last.value
        for pdf in batches:
            rows = []
            for doc, th, text in zip(pdf["doc_id"], pdf["th"], pdf["text"], strict=True):
                s = shingle_set(text, WORDS)
                n = len(s)
                if n == 0:
                    rows.append((doc, th, 0, None, None, None, None, None))
                    continue
                ordered = s
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    seen = often[at] == s
                    ordered = np.concatenate([s[~seen], s[seen][np.argsort(place[at[seen]])]])
                prefix = ordered[: n - _least_shared(n) + 1]
                rows.append((doc, th, n, _hash64(s.tobytes()), _hash64(prefix.tobytes() + n.to_bytes(8, "little")), signed(prefix.copy()), odd_sketch(s), odd_sketch(s, 512 if n <= FINE else 256).tobytes()))
            # column by column: pandas would make floats of 64-bit numbers that stand beside nulls
            names = ["doc_id", "th", "n", "cls", "grp", "prefix", "sketch", "fold"]
            columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in names}
            yield pd.DataFrame({c: pd.Series(list(v), dtype="object") if c in ("doc_id", "prefix", "sketch", "fold") else pd.array(list(v), dtype="Int64") for c, v in columns.items()})

    # ids travel as text: pandas has no null in its integers
    made = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, _RECORD)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that stand last in the order, and their places in it, the most frequent last: from one part in SAMPLE_OF of the rows; copies count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, WORDS) for t in pdf["text"]]
            yield pd.DataFrame({"cls": [_hash64(s.tobytes()) for s in sets], "s": [signed(s) for s in sets]})

    part = docs.where(crc_mod(F.col("doc_id"), SAMPLE_OF) == 0).dropDuplicates(["th"]).mapInPandas(run, "cls long, s array<long>")
    counts = part.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= SAMPLE_HITS)
    top = counts.orderBy(F.col("count").desc(), "s").limit(ORDER_MOST)
    often = unsigned(top.select("s").toPandas()["s"].to_numpy(np.int64))
    order = np.argsort(often)
    return often[order], -order


class _Fingerprints:
    """Short hashes of shingles: a shard and the bits within it."""

    def __init__(self, tokens: int):
        self.shards = 1 << max(0, (tokens // SHARD_TOKENS).bit_length())
        self.bits = max(8, tokens.bit_length()) + SPARE_BITS - (self.shards.bit_length() - 1)

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(unsigned(tokens) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        shard_bits = self.shards.bit_length() - 1
        shard = (h >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(h), np.int64)
        return shard, ((h << np.uint64(shard_bits)) >> np.uint64(64 - self.bits)).astype(np.uint64)


def _flat(arrays) -> np.ndarray:
    return np.concatenate([np.asarray(x, np.int64) for x in arrays]) if len(arrays) else np.empty(0, np.int64)


def _repeated(groups: DataFrame, prints: _Fingerprints) -> Store:
    """For each shard the sorted fingerprints that stand in the prefixes of two groups at least, or in one by chance twice.

    Fingerprints travel sorted and packed, two or three bytes each: most shingles of a prefix are alone, and this finds
    them without a shuffle of their rows.
    """
    spark = groups.sparkSession
    twice = store(spark, "jaccard-twice")

    def sorted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(held: list) -> pd.DataFrame:
            shard, low = prints(_flat(held))
            order = np.lexsort((low, shard))
            shard, low = shard[order], low[order]
            ends = np.searchsorted(shard, np.arange(prints.shards + 1))
            return pd.DataFrame([(s, pack_sorted(low[ends[s] : ends[s + 1]])) for s in range(prints.shards) if ends[s] < ends[s + 1]], columns=["shard", "k"])

        held, n = [], 0
        for pdf in batches:
            for x in pdf["prefix"]:
                held.append(x)
                n += len(x)
                if n >= TOKENS_AT_ONCE:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def put(shard: int, held: list) -> pd.DataFrame:
            k = np.sort(np.concatenate(held))
            same = k[1:][k[1:] == k[:-1]]
            return pd.DataFrame([twice.put(f"twice-{shard}", np.unique(same))], columns=["name", "data"])

        now, held = None, []
        for pdf in batches:
            for shard, k in zip(pdf["shard"].tolist(), pdf["k"], strict=True):
                if held and shard != now:
                    yield put(now, held)
                    held = []
                now = shard
                held.append(unpack_sorted(k, np.uint64))
        if held:
            yield put(now, held)

    runs = groups.select("prefix").mapInPandas(sorted_runs, "shard int, k binary")
    dealt = runs.repartition(prints.shards, "shard").sortWithinPartitions("shard")
    return filled(spark, dealt.mapInPandas(met, "name string, data binary"), twice, "jaccard-twice-rows")[1]


def _index(groups: DataFrame) -> DataFrame:
    """(grp, n, cls, pos, token): a row for each prefix shingle that another group may hold as well, written."""
    tokens = groups.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    if tokens > MOST_TOKENS:
        return written(groups.select("grp", "n", "cls", F.posexplode("prefix").alias("pos", "token")), "jaccard-index")
    prints = _Fingerprints(tokens)
    twice = _repeated(groups, prints)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = np.array([len(x) for x in pdf["prefix"]], np.int64)
            token = _flat(list(pdf["prefix"]))
            shard, low = prints(token)
            keep = np.zeros(len(token), bool)
            order = np.lexsort((low, shard))
            ends = np.searchsorted(shard[order], np.arange(prints.shards + 1))
            for s in range(prints.shards):
                part = order[ends[s] : ends[s + 1]]
                if len(part):
                    known = twice.get(f"twice-{s}")
                    at = np.minimum(np.searchsorted(known, low[part]), max(0, len(known) - 1))
                    keep[part] = known[at] == low[part] if len(known) else False
            row = np.repeat(np.arange(len(pdf)), sizes)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            row, pos, token = row[keep], pos[keep], token[keep]
            yield pd.DataFrame({"grp": pdf["grp"].to_numpy()[row], "n": pdf["n"].to_numpy()[row], "cls": pdf["cls"].to_numpy()[row], "pos": pos.astype(np.int32), "token": token})

    return written(groups.select("grp", "n", "cls", "prefix").mapInPandas(some, "grp long, n long, cls long, pos int, token long"), "jaccard-index")


def _with_sums(rows: DataFrame, key: str, **sums) -> DataFrame:
    """rows with aggregates of their key: combined in tasks and joined, so that no task gets all rows of a frequent key."""
    return rows.join(rows.groupBy(key).agg(*[c.alias(k) for k, c in sums.items()]), key)


def _near(x: str, y: str):
    """Length and position filters of a bucket's pair: enough shingles can follow the shared one."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return (9 * rest >= 4 * n) & (5 * F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= 4 * F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n")))


def _sketch_filter(pairs: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """Pairs whose sketches allow similarity 0.8: in no more bits apart than the ninth of both sizes."""
    side = lambda k: classes.select(F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    both = pairs.coalesce(tasks).join(side("a"), "a").coalesce(tasks).join(side("b"), "b").coalesce(tasks)
    half = lambda s, n: F.when(F.size(s) > n, F.zip_with(F.slice(s, 1, n), F.slice(s, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(s)
    n = F.least(F.size("s_a"), F.size("s_b"))
    apart = F.aggregate(F.zip_with(half(F.col("s_a"), n), half(F.col("s_b"), n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.where((9 * apart <= F.col("n_a") + F.col("n_b")) & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """The pairs (leader a, member b) whose whole sets have similarity 0.8 or more.

    Texts go to their leaders: a task holds the set of one leader and streams the members. A leader with many members
    is sent to several tasks.
    """
    pairs = written(pairs, "jaccard-pairs")
    # leaders of more than CELL pairs, at most a row for each CELL pairs
    wide = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("cells")).where("cells > 1")
    salted = pairs.join(wide, "a", "left").withColumn("salt", F.pmod("b", F.coalesce("cells", F.lit(1)))).coalesce(tasks)
    jobs = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("cls")).unionByName(salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("cls")).distinct().coalesce(tasks))
    jobs = written(jobs.join(classes.select("cls", "rep"), "cls").select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "a", "salt", "role", "cls").coalesce(tasks), "jaccard-jobs")
    small = jobs.count() <= BROADCAST_ROWS
    right = F.broadcast(jobs) if small else jobs
    cells = docs.join(right, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("a", "salt", "role", "cls", "text")
    cells = cells.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader, own = None, None
        for pdf in batches:
            found = []
            for a, role, cls, text in zip(pdf["a"], pdf["role"], pdf["cls"], pdf["text"], strict=True):
                s = shingle_set(text, WORDS)
                if role == 0:
                    leader, own = a, s
                elif leader == a:
                    shared = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * shared >= 80 * (len(own) + len(s) - shared):
                        found.append((a, cls))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cells.mapInPandas(run, "a long, b long")


def _pairs_of(rows: pd.DataFrame, offer: int) -> pd.DataFrame:
    """(a, b, more, token) of whole buckets, or of pairs of their blocks, one after the other: of each pair of labels in one the nearest pairs that may have similarity 0.8."""
    n, pos, label, cls, block, blocks, token, cell = (rows[c].to_numpy(np.int64) for c in ("n", "pos", "label", "cls", "block", "blocks", "token", "cell"))
    bucket = np.cumsum(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
    has = np.array([len(x) > 32 for x in rows["fold"]])
    fine = np.zeros((len(n), 8), np.uint64)
    fine[has] = np.frombuffer(b"".join(x for x in rows["fold"] if len(x) > 32), np.uint64).reshape(-1, 8)
    coarse = fine[:, :4] ^ fine[:, 4:]  # 512 slots modulo 256
    coarse[~has] = np.frombuffer(b"".join(x for x in rows["fold"] if len(x) <= 32), np.uint64).reshape(-1, 4)
    across = cell // blocks != cell % blocks  # two blocks of one bucket: pairs within a block belong to another cell
    got, x, d = [np.empty((3, 0), np.int64)], np.arange(len(n) - 1), 0
    while len(x):
        # all rows with the d-th row after them, as long as that is in the same bucket
        d += 1
        x = x[x + d < len(n)]
        x = x[bucket[x] == bucket[x + d]]
        y = x + d
        total = n[x] + n[y]
        ok = (label[x] != label[y]) & (9 * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= 4 * total) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])) & (~across[x] | (block[x] != block[y]))
        p, q, most = x[ok], y[ok], total[ok]
        bits = np.bitwise_count(coarse[p] ^ coarse[q]).sum(1, dtype=np.int64)
        near = 9 * bits <= most
        p, q, bits, most = p[near], q[near], bits[near], most[near]
        both = has[p] & has[q]
        bits[both] = np.bitwise_count(fine[p[both]] ^ fine[q[both]]).sum(1, dtype=np.int64)
        near = 9 * bits <= most
        got.append(np.stack([p[near], q[near], bits[near]]))
    x, y, bits = np.concatenate(got, axis=1)
    low, high, at = np.minimum(label[x], label[y]), np.maximum(label[x], label[y]), bucket[x]
    order = np.lexsort((cls[y], cls[x], bits, high, low, at))
    x, y, low, high, at = x[order], y[order], low[order], high[order], at[order]
    first = np.ones(len(x), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (at[1:] != at[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0)) if len(x) else np.empty(0, np.int64)
    keep = np.arange(len(x)) - start < offer
    more = np.bincount(start[~keep], minlength=len(x))[start[keep]] > 0
    return pd.DataFrame({"a": np.minimum(cls[x], cls[y])[keep], "b": np.maximum(cls[x], cls[y])[keep], "more": more, "token": token[x][keep]})


def _offered(live: DataFrame, offer: int) -> DataFrame:
    """(a, b, more, token) of all buckets. A bucket of several blocks is dealt as pairs of blocks, so a task holds two blocks at most."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < ROWS_AT_ONCE:
                continue
            rows = pd.concat(held, ignore_index=True)
            token, cell = rows["token"].to_numpy(), rows["cell"].to_numpy()
            last = int(np.flatnonzero((token != token[-1]) | (cell != cell[-1]))[-1]) + 1 if (token[0], cell[0]) != (token[-1], cell[-1]) else 0
            if last:
                yield _pairs_of(rows.iloc[:last], offer)
            held, size = [rows.iloc[last:]], len(rows) - last
        if size:
            yield _pairs_of(pd.concat(held, ignore_index=True), offer)

    made = "a long, b long, more boolean, token long"
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(F.col("block"), k) * F.col("blocks") + F.greatest(F.col("block"), k))
    dealt = live.withColumn("block", block).withColumn("cell", F.explode(cells))
    return dealt.repartition("token", "cell").sortWithinPartitions("token", "cell").mapInPandas(run, made)


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n, cls, component, component_id), one row per row of docs; th is the text's hash.

    Words are runs of anything but ASCII white space after lower-casing A-Z; a set holds the distinct 5-word shingles,
    or the whole sequence where there are fewer words. Sets link at 100 * |both| >= 80 * |either|. component_id is the
    smallest id reachable, null only if no reachable row has an id. Ids may be null or repeated, so component_id doesn't
    tell components apart; component, the least class of each, does. Null and blank texts have n = 0 and a null
    component, and link with nothing.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    records = written(_records(docs.select("doc_id", "th", "text"), _common(docs)), "jaccard-records")
    full = records.where("n > 0")
    tasks = 8 + records.count() // ROWS_A_TASK
    classes = written(full.groupBy("cls").agg(F.first("n").alias("n"), F.first("grp").alias("grp"), F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"), F.first("fold").alias("fold")).coalesce(tasks), "jaccard-classes")
    groups = written(full.groupBy("grp").agg(F.first("n").alias("n"), F.min("cls").alias("cls"), F.first("prefix").alias("prefix")), "jaccard-groups")
    index = _index(groups)
    discard(groups)
    # rows that can be near another of their bucket: exact for two rows, by the bucket's sizes for more
    end = F.struct("cls", "n", "pos")
    rows = _with_sums(index, "token", k=F.count("*"), p=F.min(end), q=F.max(end), lo=F.min("n"), hi=F.max("n")).where("k > 1")
    least = F.greatest(F.ceil(0.8 * F.col("n")), F.col("lo"))
    fits = (9 * (F.col("n") - F.col("pos")) >= 4 * (F.col("n") + least)) & (5 * F.col("hi") >= 4 * F.col("n")) & (4 * F.col("lo") <= 5 * F.col("n"))
    near = F.when(F.col("k") == 2, _near("p", "q")).otherwise(fits)
    shared = written(rows.where(near).select("grp", "n", "cls", "pos", "token").coalesce(4 * tasks), "jaccard-buckets")
    discard(index)
    inside = classes.select("grp", "n", "cls", F.lit(0).alias("pos"), F.col("grp").alias("token"))
    several = written(_with_sums(inside, "grp", k=F.count("*")).where("k > 1").select(*inside.columns).coalesce(tasks), "jaccard-several")
    # the leader of a bucket is its class of the least hash: in a group of near copies mostly one and the same
    led = _with_sums(shared.unionByName(several.select(*shared.columns)), "token", lead=F.min(end))
    x, y = F.struct("cls", "n", "pos").alias("x"), F.col("lead").alias("y")
    star = led.where("cls <> lead.cls").select(x, y).where(_near("x", "y")).select(F.col("y.cls").alias("a"), F.col("x.cls").alias("b"))
    links = written(_verified(docs, _sketch_filter(star.coalesce(4 * tasks).distinct(), classes, tasks), classes, tasks).coalesce(tasks), "jaccard-links")
    nodes = written(connected(links), "jaccard-labels")
    # what is left: pairs of classes with different labels in one bucket, groups expanded to their classes
    offer = OFFER
    while True:
        named = classes.select("cls", "grp").join(nodes.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "grp", F.coalesce("component", "cls").alias("label")).coalesce(tasks)
        whole = shared.drop("cls").join(named, "grp").unionByName(several.join(named.drop("grp"), "cls").select(*shared.drop("cls").columns, "cls", "label")).drop("grp")
        whole = written(whole.coalesce(4 * tasks), "jaccard-labelled")
        mixed = whole.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo < hi")
        live = whole.join(mixed, "token").join(classes.select("cls", "fold"), "cls")
        offered = written(_offered(live.select("token", "cls", "n", "pos", "label", "fold", "blocks"), offer).coalesce(4 * tasks), "jaccard-offered")
        discard(whole)
        late = written(_verified(docs, _sketch_filter(offered.select("a", "b").distinct(), classes, tasks), classes, tasks).coalesce(tasks), "jaccard-links")
        if not late.isEmpty():
            known = nodes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            nodes = written(connected(known.unionByName(late)), "jaccard-labels")
        # pairs of labels with more pairs to offer, that the verified ones haven't joined
        at = lambda k: nodes.select(F.col("node").alias(k), F.col("component").alias(f"label_{k}"))
        rest = offered.where("more").select("a", "b", "token").coalesce(tasks).join(at("a"), "a", "left").coalesce(tasks).join(at("b"), "b", "left").coalesce(tasks)
        # a bucket without such a pair has offered all that can change a component
        open_ = written(rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("token").distinct().coalesce(tasks), "jaccard-open")
        n = open_.count()
        if not n:
            break
        few = F.broadcast(open_) if n <= BROADCAST_ROWS else open_
        before = shared, several, offered
        shared = written(shared.join(few, "token", "left_semi").coalesce(4 * tasks), "jaccard-buckets")
        several = written(several.join(few, "token", "left_semi").select(*several.columns).coalesce(tasks), "jaccard-several")
        discard(*before)
        offer *= GROWTH
    named = classes.join(nodes.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), "first_id").coalesce(tasks)
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id")).coalesce(tasks)
    known = named.select("cls", "component").join(least, "component").select("cls", "component", "component_id")
    out = records.select("doc_id", "th", "n", "cls").join(known, "cls", "left")
    return out.select("doc_id", "th", "n", "cls", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays (null first), repeated rows once.

    Columns are docs', whatever their names. Rows without words are kept, repeated ones once. Of rows of one id and text
    that differ in other columns the one whose JSON is least stays.
    """
    found = written(components(docs, id_col, text), "jaccard-found")
    best = found.where("n > 0").groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("best")).select("best.doc_id", "best.th")
    again = found.groupBy("doc_id", "th").agg((F.count("*") > 1).alias("again"))
    kept = best.unionByName(found.where("n = 0").select("doc_id", "th").distinct())
    kept = kept.alias("x").join(again.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.th") == F.col("y.th"))).select("x.doc_id", "x.th", "again")
    kept = written(kept, "jaccard-kept")
    right = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    # the rows travel whole under an alias, so that no column of docs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = rows.withColumns({"own_id": F.col(f"row.`{id_col}`").cast("long"), "own_th": F.xxhash64(F.coalesce(F.col(f"row.`{text}`"), F.lit("")))})
    stay = own.join(right, (F.col("own_th") == F.col("th")) & F.col("own_id").eqNullSafe(F.col("doc_id"))).select("row", "own_id", "own_th", "again")
    if kept.where("again").isEmpty():
        return stay.select("row.*")
    once = stay.where("again").groupBy("own_id", "own_th").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return stay.where("NOT again").select("row.*").unionByName(once.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
