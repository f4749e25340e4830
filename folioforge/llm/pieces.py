"""Operator 7: SentencePiece encoding and decoding over a lattice of words.

A text is cut into words at the places that no piece crosses. The lattice of the distinct words is relational: all
substrings that begin like a piece of their size are exploded, equi-joined to the piece table and grouped by word, all
under one exchange of the words. A fold over the edges by the higher-order aggregate gives a word's ids: Viterbi for
unigram models, the merge order for BPE models, whose ranks are no probabilities. The encodings are kept as sorted arrays
that workers map to turn texts into ids, so that no row is made for each word of each text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain as flat
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.arrays import Store, bundle, filled, store, unbundled
from folioforge.llm.common import table, with_columns

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Code points of words that the lattice takes, whose cuts are bits of a 64-bit number; longer ones are encoded one by
#: one in workers. Units (words and what follows them) kept by a worker. Characters of text for each shard of words, and
#: shards at most; words of a task that are grouped in memory, beyond which Spark sorts them.
LATTICE_CHARS, CACHE, SHARD_CHARS, SHARDS, GROUPED = 60, 500_000, 4_000_000, 4096, 100_000


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: what a worker needs, a few hundred kilobytes."""

    names: tuple[str, ...]  # by id; "" for control and unknown pieces
    scores: tuple[float, ...]
    bytes_at: tuple[int, ...]  # ids of the 256 byte pieces, or none
    unknown: int
    unigram: bool
    joined: tuple[str, ...] = field(default=(), compare=False)  # classes of characters: no piece holds neighbours of two
    led: str = field(default="", compare=False)  # other characters that pieces have after white space

    @property
    def unknown_score(self) -> float:
        return min((s for n, s in zip(self.names, self.scores, strict=True) if n), default=0.0) - 10

    def ranks(self) -> dict[int, int]:
        """The place of each piece in the merge order: by score, the greatest first."""
        order = {x: k for k, x in enumerate(sorted({-s for n, s in zip(self.names, self.scores, strict=True) if n}))}
        return {i: order[-s] for i, (n, s) in enumerate(zip(self.names, self.scores, strict=True)) if n}

    def merges(self) -> dict[int, tuple[int, bool]]:
        """For each piece that merging its own characters makes: where its last two parts meet, and whether one of them comes no earlier in the merge order than the piece.

        A word's merges within a span that none crosses are those of the span alone, so a piece is made in any word of
        the same two parts, or never.
        """
        rank, out = {self.names[i]: r for i, r in self.ranks().items()}, {}
        for i, name in enumerate(self.names):
            parts = list(name)
            while len(parts) > 2 and (ready := [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]):
                k = min(ready)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                out[i] = len(parts[0]), any(len(x) > 1 and rank[x] >= rank[name] for x in parts)
        return out

    @property
    def longest(self) -> int:
        return max((len(n) for n in self.names), default=1)


def load(path: str = MODEL_FILE) -> Pieces:
    """The piece table of a SentencePiece model file with identity normalisation, read on the driver."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only models with identity normalisation, escaped white space and a dummy prefix are supported")
    sp = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    return from_table(
        [(sp.id_to_piece(i), sp.get_score(i), "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece") for i in range(sp.get_piece_size())],
        sp.unk_id(),
        spec.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM,
    )


def from_table(rows: list[tuple[str, float, str]], unknown: int, unigram: bool) -> Pieces:
    """Pieces from (name, score, kind) by id; kind is piece, byte or other."""
    at = {int(n[1:-1], 16): i for i, (n, _, kind) in enumerate(rows) if kind == "byte"}
    names = tuple(n if kind == "piece" else "" for n, _, kind in rows)
    if any(SPACE in n.lstrip(SPACE) for n in names):
        raise ValueError("pieces with white space after other characters are not supported")
    bare = [n.lstrip(SPACE) for n in names]
    to: dict[str, str] = {}

    def top(c: str) -> str:
        while to.setdefault(c, c) != c:
            c = to[c]
        return c

    for n in bare:
        for a, b in zip(n, n[1:], strict=False):
            to[top(a)] = top(b)
    classes: dict[str, list[str]] = {}
    for c in sorted(to):
        classes.setdefault(top(c), []).append(c)
    joined = tuple(sorted(("".join(x) for x in classes.values()), key=lambda x: (-len(x), x)))
    led = "".join(sorted({b for n, b in zip(names, bare, strict=True) if len(b) == 1 < len(n)} - to.keys()))
    return Pieces(names, tuple(s for _, s, _ in rows), tuple(at[b] for b in range(256)) if len(at) == 256 else (), unknown, unigram, joined, led)


def word_pattern(p: Pieces) -> str:
    """Words of the escaped text: white space and then characters that pieces join, or one character that none joins."""
    runs = [f"[{re.escape(x)}]+" for x in p.joined]
    after = "|".join(runs + ([f"[{re.escape(p.led)}]"] if p.led else []))
    return "|".join([f"{SPACE}+(?:{after})?" if after else f"{SPACE}+", *runs, f"[^{re.escape(''.join(p.joined))}{SPACE}]"])


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def own_lines(p: Pieces) -> bool:
    """Whether no piece has a new line beside other characters."""
    return "\n" not in "".join(p.joined) + p.led


def unit_cutter(p: Pieces) -> Callable[[str], list[str]]:
    """The function from a text to its units: what follows a space, without that space, or begins with a new line.

    Words don't cross units, and cutting at single characters is several times faster than finding words.
    """
    lines = own_lines(p)
    runs = re.compile(" +[^ \n]*|\n[^ \n]*" if lines else " +[^ ]*").findall

    def cut(text: str) -> list[str]:
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return [x[1:] if x[0] == " " else x for x in runs(" " + text)]
        return (text.replace("\n", " \n") if lines else text).split(" ")

    return cut


def spelled(unit: str, lines: bool) -> str:
    """The text of a unit with its space."""
    return unit if lines and unit[:1] == "\n" else " " + unit


# ---- the lattice of the distinct words -------------------------------------------------------------------------------


def piece_table(spark: SparkSession, p: Pieces) -> DataFrame:
    """(piece, id, score, rank, meet, late): one row per piece that text can match; of BPE models those that merges make, with the place where the last two parts meet."""
    ranks, made = p.ranks(), {} if p.unigram else p.merges()
    rows = [(n, i, float(s), ranks[i], *made.get(i, (0, False))) for i, (n, s) in enumerate(zip(p.names, p.scores, strict=True)) if n and (p.unigram or i in made)]
    return spark.createDataFrame(rows, "piece string, id int, score double, rank int, meet int, late boolean")


def distinct_words(texts: DataFrame, p: Pieces, text: str, shards: int) -> DataFrame:
    """(shard, word): the distinct words of 2 to LATTICE_CHARS code points, dealt by shard. Workers drop repeats before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cut, lines, seen = re.compile(word_pattern(p)).findall, unit_cutter(p), own_lines(p), set()
        alone = next(c for c in map(chr, range(0x110000)) if c not in f"{''.join(p.joined)}{p.led} {SPACE}")

        def batch() -> pa.RecordBatch:
            words = set()
            while seen:  # as one text, between characters that are words of their own; units leave as words come
                words.update(find(alone.join([spelled(seen.pop(), lines) for _ in range(min(50_000, len(seen)))]).replace(" ", SPACE)))
            return pa.RecordBatch.from_arrays([pa.array([w for w in words if 1 < len(w) <= LATTICE_CHARS], pa.string())], names=["word"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(cut(t))
                if len(seen) > CACHE:
                    yield batch()
                    seen = set()
        if seen:
            yield batch()

    found = texts.select(text).mapInArrow(run, "word string")
    return found.withColumn("shard", F.xxhash64("word").bitwiseAND(F.lit(shards - 1)).cast("int")).repartition(shards, "shard").select("shard", "word").distinct()


def lattice(words: DataFrame, pieces: DataFrame, edge: Column, least: int, *more: Column) -> DataFrame:
    """(shard, word, edges, more): the sorted edges of each word of `least` characters or more, none for words without one.

    An edge is made of word, start, size, span and the columns of its piece; more are further aggregates of these. Edges
    of one character are there for every character, with a null id if it is no piece. A substring of more than `least`
    characters is made only if some piece of its size begins with the same least + 1. The piece table is a vocabulary of
    fixed size and is broadcast; it is joined by hash and text, as Spark finds numbers faster than texts. Words are dealt
    by shard, so nothing else is exchanged.
    """
    known = pieces.where(F.char_length("piece") >= least)
    heads = known.where(F.char_length("piece") > least).groupBy(F.substring("piece", 1, least + 1).alias("begin")).agg(F.concat(F.array(F.lit(least)), F.array_sort(F.collect_set(F.char_length("piece")))).alias("sizes"))
    heads = F.broadcast(heads.withColumn("begin_h", F.xxhash64("begin")))
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(0), F.char_length("word") - least))).withColumn("head", F.substring(F.col("word"), F.col("start") + 1, F.lit(least + 1)))
    sized = starts.join(heads, (F.xxhash64("head") == F.col("begin_h")) & (F.col("head") == F.col("begin")), "left")
    spans = sized.select("shard", "word", "start", F.explode(F.coalesce("sizes", F.array(F.lit(least)))).alias("size")).where(F.col("start") + F.col("size") <= F.char_length("word"))
    cut = spans.withColumn("span", F.substring(F.col("word"), F.col("start") + 1, F.col("size"))).withColumn("h", F.xxhash64("span"))
    met = cut.join(F.broadcast(known.withColumn("piece_h", F.xxhash64("piece"))), (F.col("h") == F.col("piece_h")) & (F.col("span") == F.col("piece")), "left" if least == 1 else "inner")
    if least == 1:
        met = met.where("id IS NOT NULL OR size = 1")
    return met.groupBy("shard", "word").agg(F.sort_array(F.collect_list(edge)).alias("edges"), *more)


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def merge_order(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(shard, word, ids) by merges: two neighbours that make a piece become one, the best-ranked piece first, the leftmost of equals; -1 - c for a character c that stays alone.

    The cuts of a word are the bits of a number. An edge of two characters or more is a merge when the cuts within it
    are its ends and the place where its parts meet. Edges come by rank and start. A merge offers only pieces of later
    ranks, so one pass over the edges finds all merges in order; a word with a piece that comes no later than one of its
    parts (runs of spaces of equal scores, in the given model) starts again from the first edge after each merge. Words
    without such edges are left out. A task groups the edges of all its words, so each is one number there, and becomes
    the bits of its cuts in the fold, word by word.
    """
    shift = lambda c, n: F.shiftleft(c.cast("long"), n)
    bits = lambda n, at, width: F.shiftright(n, at).bitwiseAND(F.lit((1 << width) - 1))
    # a number that sorts by rank and start: up to 24 bits of rank, 6 of start, 21 of the id, 6 of the size, 6 of the place where the parts meet
    edge = shift(F.col("rank"), 39).bitwiseOR(shift(F.col("start"), 33)).bitwiseOR(shift(F.col("id"), 12)).bitwiseOR(shift(F.col("size"), 6)).bitwiseOR(F.col("meet").cast("long"))
    edges = lattice(words, pieces, edge, 2, F.bool_or("late").alias("late"), F.max(F.char_length("word")).alias("n_chars"))

    def cut_bits(n: Column) -> Column:
        start, size, meet = (bits(n, at, 6).cast("int") for at in (33, 6, 0))
        first, last, middle = _power(start), _power(start + size), _power(start + meet)
        return F.struct(n.alias("n"), (last - first).bitwiseOR(last).alias("span"), first.bitwiseOR(last).bitwiseOR(middle).alias("ready"), middle.alias("meet"))

    edges = edges.withColumn("edges", F.transform("edges", cut_bits))
    ready = lambda cuts, e: cuts.bitwiseAND(e["span"]) == e["ready"]
    begin = _power(F.col("n_chars") + 1) - 1
    once = F.aggregate("edges", begin, lambda cuts, e: F.when(ready(cuts, e), cuts.bitwiseXOR(e["meet"])).otherwise(cuts))
    again = F.aggregate(F.sequence(F.lit(2), F.col("n_chars")), begin, lambda cuts, _: F.coalesce(cuts.bitwiseXOR(F.get(F.filter("edges", lambda e: ready(cuts, e)), F.lit(0))["meet"]), cuts))
    done = edges.withColumn("cuts", F.when(F.col("late"), again).otherwise(once))
    cuts = F.col("cuts")
    # by start, as numbers of the start and 22 bits of the id: the edges that no cut parts, and the characters between two cuts
    made = F.filter("edges", lambda e: cuts.bitwiseAND(e["span"]) == e["ready"].bitwiseXOR(e["meet"]))
    placed = lambda at, i: shift(at, 22) + (i + F.lit(1 << 21))
    joined = F.transform(made, lambda e: placed(bits(e["n"], 33, 6), bits(e["n"], 12, 21)))
    alone = F.filter(F.sequence(F.lit(0), F.col("n_chars") - 1), lambda k: cuts.bitwiseAND(_power(k) * 3) == _power(k) * 3)
    chars = F.transform(alone, lambda k: placed(k, -1 - F.ascii(F.substring(F.col("word"), k + 1, F.lit(1))).cast("long")))
    return done.select("shard", "word", F.transform(F.sort_array(F.concat(joined, chars)), lambda x: (x.bitwiseAND(F.lit((1 << 22) - 1)) - F.lit(1 << 21)).cast("int")).alias("ids"))


def viterbi(words: DataFrame, pieces: DataFrame, unknown_score: float) -> DataFrame:
    """(shard, word, ids) on the path of the greatest sum of scores, of equal sums the one with the longest last piece."""
    edge = F.struct("start", (F.col("start") + F.col("size")).alias("end"), F.coalesce("id", -1 - F.ascii("span")).alias("id"), F.coalesce("score", F.lit(unknown_score)).alias("score"))
    state = "array<struct<score:double,ids:array<int>>>"
    best = F.aggregate(
        F.sequence(F.lit(1), F.char_length("word")),
        F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))).cast(state),
        lambda acc, end: F.concat(
            acc,
            F.array(
                F.aggregate(
                    F.filter("edges", lambda e: e["end"] == end),
                    F.struct(F.lit(float("-inf")).alias("score"), F.array().cast("array<int>").alias("ids")),
                    lambda top, e: F.when(F.get(acc, e["start"])["score"] + e["score"] > top["score"], F.struct((F.get(acc, e["start"])["score"] + e["score"]).alias("score"), F.concat(F.get(acc, e["start"])["ids"], F.array(e["id"])).alias("ids"))).otherwise(top),
                )
            ),
        ),
    )
    return lattice(words, pieces, edge, 1).select("shard", "word", F.element_at(best, -1)["ids"].alias("ids"))


def encoded_words(words: DataFrame, p: Pieces) -> DataFrame:
    """(shard, word, ids) of distinct words; id -1 - c stands for the character c. BPE words that no two characters of make a piece are left out."""
    table_ = piece_table(words.sparkSession, p)
    return viterbi(words, table_, p.unknown_score) if p.unigram else merge_order(words, table_)


def _kept(words: DataFrame, p: Pieces, shards: int) -> Store:
    """The encodings as arrays: for each shard the sorted hashes of its words, a second hash of each, where their ids end, and all ids."""
    spark = words.sparkSession
    at = store(spark, "piece-words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows["h"].to_numpy().view(np.uint64)
            order = np.argsort(h)
            ids = rows["ids"].combine_chunks().take(pa.array(order))
            ends = np.cumsum(ids.value_lengths().to_numpy(), dtype=np.int64).astype(np.uint32)
            arrays = [h[order], rows["c"].to_numpy()[order].astype(np.uint32), ends, ids.flatten().to_numpy().view(np.uint32)]
            name, data = at.put(f"words-{shard}", bundle(arrays))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["name", "data"])

        now, held = None, []
        for b in batches:
            shard = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if held and shard[lo] != now:
                    yield put(now, held)
                    held = []
                now = int(shard[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield put(now, held)

    found = encoded_words(words, p).select("shard", F.xxhash64("word").alias("h"), F.crc32(F.encode("word", "UTF-8")).alias("c"), "ids").sortWithinPartitions("shard")
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), GROUPED)))
    try:
        return filled(spark, found.mapInArrow(run, "name string, data binary"), at, "piece-words-rows")[1]
    finally:
        spark.conf.set(key, before)


# ---- texts to ids ----------------------------------------------------------------------------------------------------


class Numbers(dict):
    """Numbers of texts, from 0 in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts in a worker: looks words up in the kept encodings, and keeps those of recent units."""

    def __init__(self, p: Pieces, kept: Store | None = None, shards: int = 1):
        self.p, self.kept, self.shards, self.longest = p, kept, shards, p.longest
        self.find, self.units, self.lines = re.compile(word_pattern(p)).findall, unit_cutter(p), own_lines(p)
        self.ids = {n: i for i, n in enumerate(p.names) if n}
        self.rank = p.ranks()
        self.chars = np.full(0x110000, -1, np.int32)
        for n, i in self.ids.items():
            if len(n) == 1:
                self.chars[ord(n)] = i
        self.names = piece_bytes(p)
        self.n_bytes = np.fromiter(map(len, self.names), np.int64, len(self.names))
        self.first_byte, self.all_bytes = np.cumsum(self.n_bytes) - self.n_bytes, np.frombuffer(b"".join(self.names), np.uint8)
        self._forget()

    def _forget(self) -> None:
        """The encodings of units lie in one array; a unit has a number, its start and its length there, and whether its ids spell it."""
        self.rows = Numbers()
        self.start, self.size, self.flat, self.exact = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)

    def _fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.p.bytes_at[b] for b in c.encode("utf-8", "surrogatepass")) if self.p.bytes_at else (self.p.unknown,)

    def one(self, word: str) -> tuple[int, ...]:
        """One word of any length, exactly: a heap of merges, or Viterbi with a window of the longest piece."""
        n = len(word)
        if self.p.unigram:
            best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    i = self.ids.get(word[start:end])
                    s = best[start] + (self.p.scores[i] if i is not None else self.p.unknown_score if end - start == 1 else float("-inf"))
                    if s > best[end]:
                        best[end], back[end] = s, start
            cuts = [n]
            while cuts[-1]:
                cuts.append(back[cuts[-1]])
            cuts.reverse()
        else:
            after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
            heap: list[tuple[int, int, int, int]] = []

            def offer(a: int) -> None:
                b = after[a]
                if b < n:
                    end = after[b]
                    i = self.ids.get(word[a:end]) if end - a <= self.longest else None
                    if i is not None:
                        heapq.heappush(heap, (self.rank[i], a, b, end))

            for a in range(n - 1):
                offer(a)
            while heap:
                _, a, b, end = heapq.heappop(heap)
                if not (alive[a] and b < n and alive[b] and after[a] == b and after[b] == end):
                    continue
                alive[b], after[a] = False, end
                if end < n:
                    before[end] = a
                if before[a] >= 0:
                    offer(before[a])
                offer(a)
            cuts = [a for a in range(n) if alive[a]] + [n]
        return tuple(flat.from_iterable((self.ids[word[a:b]],) if word[a:b] in self.ids else self._fallback(word[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))

    def _looked_up(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
        """The words that have kept encodings, the sizes of these and all their ids; and the words that have none.

        Words are found by 64 bits of one hash and 32 of another. Kept ids that stand for characters become their bytes.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in raw), np.uint64, len(raw))
        c = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
        shard = (h & np.uint64(self.shards - 1)).astype(np.int64)
        order = np.lexsort((h, shard))
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        found, sizes, flats, odd = [], [], [], []
        for s in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            part = order[ends[s] : ends[s + 1]]
            try:
                known, check, stop, ids = unbundled(self.kept.get(f"words-{s}"))
            except FileNotFoundError:  # a shard without words
                odd += [words[k] for k in part]
                continue
            at = np.minimum(np.searchsorted(known, h[part]), len(known) - 1)
            hit = (known[at] == h[part]) & (check[at] == c[part])
            hi = stop[at].astype(np.int64)
            lo = np.where(at > 0, stop[at - 1], 0).astype(np.int64)
            size = (hi - lo)[hit]
            own = ids.view(np.int32)[np.repeat(lo[hit] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            alone = np.flatnonzero(own < 0)
            own[alone] = np.where(self.chars[-1 - own[alone]] >= 0, self.chars[-1 - own[alone]], own[alone])
            row = np.repeat(np.arange(len(size)), size)
            plain = np.ones(len(size), bool)
            plain[row[own < 0]] = False
            names = [words[k] for k in part[hit].tolist()]
            stops = np.cumsum(size)
            for k in np.flatnonzero(~plain).tolist():
                ids_k = tuple(flat.from_iterable((i,) if i >= 0 else self._fallback(chr(-1 - i)) for i in own[stops[k] - size[k] : stops[k]].tolist()))
                found.append(names[k])
                sizes.append(np.array([len(ids_k)]))
                flats.append(np.array(ids_k))
            found += [n for n, ok in zip(names, plain.tolist(), strict=True) if ok]
            sizes.append(size[plain])
            flats.append(own[plain[row]])
            odd += [words[k] for k in part[~hit].tolist()]
        return found, np.concatenate(sizes) if sizes else np.empty(0, np.int64), np.concatenate(flats) if flats else np.empty(0, np.int32), odd

    def _words(self, words: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """The number of each word, and by number the size of its encoding; all their ids."""
        short, middle, rest = [], [], []
        for w in words:
            (short if len(w) == 1 else middle if self.kept is not None and len(w) <= LATTICE_CHARS else rest).append(w)
        found, size, ids, odd = self._looked_up(middle) if middle else ([], np.empty(0, np.int64), np.empty(0, np.int32), [])
        rest += odd
        made = [(self.ids[w],) if w in self.ids else self._fallback(w) for w in short] + [self.one(w) for w in rest]
        names = found + short + rest
        return dict(zip(names, range(len(names)), strict=True)), np.concatenate([size, np.fromiter(map(len, made), np.int64, len(made))]), np.concatenate([ids.astype(np.int32), np.fromiter(flat.from_iterable(made), np.int32)])

    def _learn(self, units: list[str]) -> None:
        """Encodes units by their words, and tells of each whether decoding gives it again."""
        plain = [spelled(u, self.lines) for u in units]
        cut = [self.find(x.replace(" ", SPACE)) for x in plain]
        number, sizes, ids = self._words(list(set(flat.from_iterable(cut))))
        row = np.fromiter(map(number.__getitem__, flat.from_iterable(cut)), np.int64)
        ids = gathered(ids, (np.cumsum(sizes) - sizes)[row], sizes[row])
        size = summed(sizes[row], np.fromiter(map(len, cut), np.int64, len(cut)))
        raw = [x.encode("utf-8", "surrogatepass") for x in plain]
        got = gathered(self.all_bytes, self.first_byte[ids], self.n_bytes[ids]).tobytes()
        stop = np.cumsum(summed(self.n_bytes[ids], size)).tolist()
        exact = np.fromiter((got[a:b] == x for a, b, x in zip([0, *stop], stop, raw, strict=False)), bool, len(raw))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat, self.exact = np.concatenate([self.size, size]), np.concatenate([self.flat, ids]), np.concatenate([self.exact, exact])

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, how many each text has, and whether each text's units are spelled by their ids."""
        if len(self.rows) > CACHE:
            self._forget()
        cut = [self.units(t) if t else [] for t in texts]
        known = len(self.rows)
        row = np.fromiter(map(self.rows.__getitem__, flat.from_iterable(cut)), np.int64)
        if len(self.rows) > known:
            self._learn(list(islice(self.rows, known, None)))
        size, units = self.size[row], np.fromiter(map(len, cut), np.int64, len(cut))
        return gathered(self.flat, self.start[row], size), summed(size, units), summed(~self.exact[row], units) == 0

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, size, _ = self.arrays(texts)
        return np.split(ids, np.cumsum(size)[:-1]) if len(texts) else []


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start + size] of each start and size, one after the other."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return values[at]


def summed(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of these sizes, which may be 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    end = np.cumsum(size)
    return total[end] - total[end - size]


def decode_ids(p: Pieces, names: list[bytes], ids) -> str:
    """Text of ids: pieces with white space restored, without the first space; bytes that are no UTF-8 become U+FFFD; ids out of range are left out."""
    data = b"".join([names[i] for i in ids if 0 <= i < len(names)])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def piece_bytes(p: Pieces) -> list[bytes]:
    out = [n.replace(SPACE, " ").encode("utf-8") for n in p.names]
    for b, i in enumerate(p.bytes_at):
        out[i] = bytes([b])
    return out


def _slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[slice]:
    lo, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield slice(lo, k + 1)
            lo, n = k + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def encode(df: DataFrame, pieces: Pieces, text: str = "text", out: str = "ids", round_trip: str | None = None) -> DataFrame:
    """df with the ids of each text; null and empty texts have none. As the public library encodes: BPE models by merges, unigram models by Viterbi.

    round_trip names a column that tells whether decoding gives the text again: false for texts with U+2581, which is
    how white space is written, true for null texts. Columns of these names are replaced. The distinct words are encoded
    by a job of their own; words of over LATTICE_CHARS code points are encoded in the texts' workers.
    """
    spark = df.sparkSession
    chars = df.agg(F.coalesce(F.sum(F.length(f"`{text}`")), F.lit(0))).first()[0]
    shards = min(SHARDS, 1 << max(2, (chars // SHARD_CHARS).bit_length()))
    kept = _kept(distinct_words(df, pieces, f"`{text}`", shards), pieces, shards)
    shared = spark.sparkContext.broadcast(pieces)  # a vocabulary of fixed size

    def make():
        encoder = Encoder(shared.value, kept, shards)

        def step(texts: list) -> list[list | pa.Array]:
            parts = [(texts[part], *encoder.arrays(texts[part])) for part in _slices(texts)]
            sizes = np.concatenate([[0], *(size for _, _, size, _ in parts)])
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *(x for _, x, _, _ in parts)]), pa.int32()))
            if not round_trip:
                return [ids]
            # ids that spell a text's units spell the text, unless it has the sign that white space is written as
            same = [not t or SPACE not in t if ok else decode_ids(shared.value, encoder.names, x.tolist()) == t for values, x, size, exact in parts for t, ok, x in zip(values, exact.tolist(), np.split(x, np.cumsum(size)[:-1]), strict=True)]
            return [ids, same]

        return step

    return with_columns(df, text, make, f"{out} array<int>" + (f", {round_trip} boolean" if round_trip else ""))


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; null ids give null, no ids ""."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    def make():
        names = piece_bytes(shared.value)
        return lambda values: [[None if x is None else decode_ids(shared.value, names, x) for x in values]]

    return with_columns(df, ids, make, f"{out} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text again."""
    pieces = load()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(docs, pieces, round_trip="round_trip").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
