"""Operator 5: personal data, with information-theoretic sanitisation.

Patterns find the base spans (e-mail, IP, card, phone). Each found value is a protected entity. The words of the texts
that hold it are terms that may disclose it: over the whole corpus, PMI(entity; term) / IC(entity) says which share of
the entity's information content a term reveals. Terms at or over the disclosure threshold are spans of their own,
wherever they stand in such a text: generalised to their kind (a name, an acronym, a word; no taxonomy is at hand from
which nearer hypernyms could come), or removed where they reveal nearly all.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import fresh, mix64, table, with_columns, written

KINDS = ("email", "ip", "card", "phone")
#: The share of an entity's information content that a term may reveal; the distinct texts in which entity and term must
#: meet before the corpus counts as evidence; from which share a term is removed and not generalised; rows (flagged
#: pairs, entities, terms) that may be broadcast (8 bytes each), above which they are joined.
THRESHOLD, SUPPORT, REMOVE, BROADCAST_PAIRS = 0.5, 2, 0.95, 4_000_000

#: Terms whose counts one task merges.
TERMS_A_TASK = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NEAR = re.compile(r"[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of KINDS, then by start; leftmost, non-overlapping within a kind."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip("0")) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All words of the whole text with their places, lower-cased; no term lies in a base span."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for m in _NEAR.finditer(text):
        i = bisect.bisect_left(starts, m.end()) - 1  # the last span that starts before the word ends
        if i < 0 or ends[i] <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def _vocabulary(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The distinct terms."""
    return {x[0] for x in terms(text, spans)} if spans else {x.lower() for x in set(_NEAR.findall(text))}


@functools.lru_cache(1 << 17)
def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _hashes(words) -> np.ndarray:
    return np.array([_hash(x) for x in words], np.int64)


def _keys(entities: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Keys of pairs of entities with terms, by their hashes; one entity may stand for all."""
    return mix64(mix64(entities.view(np.uint64)) + terms.view(np.uint64)).view(np.int64)


def _within(found: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Places of the sought numbers in sorted ones, -1 for those that aren't there."""
    at = np.minimum(np.searchsorted(found, sought), max(0, len(found) - 1))
    return np.where(found[at] == sought, at, -1) if len(found) else np.full(len(sought), -1)


def corpus_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, entities, terms): the hashes of all entities and of all words of every distinct text with a base span, written.

    Exact copies of a whole text are one piece of evidence, not many.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, t in zip(pdf["h"], pdf["t"], strict=True):
                if spans := base_spans(t):
                    rows.append((h, _hashes({_entity(k, t[a:b]) for k, a, b in spans}), _hashes(_vocabulary(t, spans))))
            yield pd.DataFrame(rows, columns=["h", "entities", "terms"])

    t = F.col(f"`{text}`")
    found = docs.select(F.xxhash64(F.coalesce(t, F.lit(""))).alias("h"), t.alias("t")).where("t rlike '[0-9@]'").mapInPandas(run, "h long, entities array<long>, terms array<long>")
    return written(found.dropDuplicates(["h"]), "pii-sets")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_PAIRS else df


def _term_counts(docs: DataFrame, text: str, wanted: DataFrame, copied: DataFrame) -> DataFrame:
    """(t, n_term) of the wanted terms (a column t): the distinct texts of the whole corpus that hold each, with or without a base span.

    Texts that occur once are summed in their task; the terms of those that are copied (hashes h) meet by their hash.
    """
    n_wanted = wanted.count()
    few, parts = n_wanted <= BROADCAST_PAIRS, 1 + max(0, min(n_wanted, BROADCAST_PAIRS)) // TERMS_A_TASK
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["t"].to_numpy(np.int64)) if few else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sought = shared.value
        sums = np.zeros(0 if sought is None else len(sought), np.int64)
        for pdf in batches:
            rows = []
            for h, t, once in zip(pdf["h"], pdf["t"], pdf["once"], strict=True):
                x = _hashes(_vocabulary(t, base_spans(t)))
                if sought is not None:
                    at = _within(sought, x)
                    if once:
                        sums[at[at >= 0]] += 1
                        continue
                    x = x[at >= 0]
                if len(x):
                    rows.append((False, h, x, np.ones(len(x), np.int64)))
            yield pd.DataFrame(rows, columns=["summed", "h", "terms", "counts"])
        held = np.flatnonzero(sums)
        part = held * parts // max(1, len(sums))  # ranges of the sorted terms
        for p in np.unique(part).tolist():
            i = held[part == p]
            yield pd.DataFrame([(True, p, sought[i], sums[i])], columns=["summed", "h", "terms", "counts"])

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("h"), t.alias("t")).join(_few(copied.withColumn("again", F.lit(True))), "h", "left")
    made = rows.select("h", "t", F.col("again").isNull().alias("once")).mapInPandas(run, "summed boolean, h long, terms array<long>, counts array<long>")
    made = written(made, "pii-terms-held")

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sums of a range of terms over all tasks; its rows come one after the other."""
        now, t, n = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            for p, terms_, counts in zip(pdf["h"].tolist(), pdf["terms"], pdf["counts"], strict=True):
                if p != now:
                    if len(t):
                        yield pd.DataFrame({"t": t, "n": n})
                    now, t, n = p, np.empty(0, np.int64), np.empty(0, np.int64)
                u, back = np.unique(np.concatenate([t, terms_]), return_inverse=True)
                t, n = u, np.bincount(back, np.concatenate([n, counts])).astype(np.int64)
        if len(t):
            yield pd.DataFrame({"t": t, "n": n})

    # sums of tasks meet as arrays: as rows they would be tasks times terms
    summed = made.where("summed").repartition(parts, "h").sortWithinPartitions("h").mapInPandas(merged, "t long, n long")
    copies = made.where("NOT summed").dropDuplicates(["h"]).select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("t"), F.col("x.counts").alias("n"))
    return summed.unionByName(copies).groupBy("t").agg(F.sum("n").alias("n_term"))


def disclosures(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(e, t, share), hashes of entity and term, for terms that reveal at least `threshold` of an entity's information content; written.

    Over the distinct texts of the corpus: PMI = log(n * n(e,t) / (n(e) * n(t))), IC = log(n / n(e)), share = PMI / IC.
    Pairs that meet in fewer than `support` texts are no evidence. An entity in every text has no information content to
    reveal.
    """
    texts = written(docs.groupBy(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h")).agg(F.count("*").alias("k")), "pii-texts")
    n, copied = texts.count(), texts.where("k > 1").select("h")
    sets = corpus_sets(docs, text)
    entities = sets.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_entity"))
    # an entity of fewer texts than support meets no term often enough
    several = written(entities.where((F.col("n_entity") >= support) & (F.col("n_entity") < n)), "pii-entities")
    of = sets.select("h", F.explode("entities").alias("e")).join(_few(several.select("e")), "e").groupBy("h").agg(F.collect_list("e").alias("es"))
    pairs = sets.join(of, "h").select(F.explode("es").alias("e"), "terms").select("e", F.explode("terms").alias("t"))
    both = pairs.groupBy("e", "t").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    share = lambda k: F.log(n * F.col("n_both") / (F.col("n_entity") * F.col(k))) / F.log(n / F.col("n_entity"))
    # a term is in no fewer texts of the corpus than of those with base spans: what falls short by the latter count does so by both
    least = sets.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n_least"))
    met = written(both.join(_few(several), "e").join(least, "t").where(share("n_least") >= threshold).drop("n_least"), "pii-met")
    total = _term_counts(docs, text, written(met.select("t").distinct(), "pii-terms"), copied)
    return written(met.join(total, "t").withColumn("share", share("n_term")).where(F.col("share") >= threshold).select("e", "t", "share"), "pii-flags")


def _flagged(found: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted keys of the flagged pairs and whether each is to be removed, if they are few enough to broadcast."""
    if found.count() > BROADCAST_PAIRS:
        return None
    got = found.select(_pair_key("e", "t").alias("k"), (F.col("share") >= REMOVE).alias("remove")).toPandas()
    keys = got["k"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], got["remove"].to_numpy(bool)[order]


def _pair_key(e: str, t: str) -> Column:
    return F.pandas_udf(lambda e, t: pd.Series(_keys(e.to_numpy(np.int64), t.to_numpy(np.int64))), "long")(e, t)


def _all_spans(text: str, flagged) -> list[tuple[str, int, int]]:
    """Base spans, and every occurrence in the text of the terms that are flagged for one of its entities."""
    base = base_spans(text)
    if not base or not len(flagged[0]):
        return base
    found = terms(text, base)
    words = sorted({x[0] for x in found})
    hashes, remove, marked = _hashes(words), np.zeros(len(words), bool), np.zeros(len(words), bool)
    for entity in {_entity(k, text[a:b]) for k, a, b in base}:
        at = _within(flagged[0], _keys(_hashes([entity]), hashes))
        marked |= at >= 0
        remove |= (at >= 0) & flagged[1][at]
    kinds = {w: "gone" if gone else "term" for w, gone, m in zip(words, remove, marked, strict=True) if m}
    more = [(kinds[w], a, b) for w, a, b in found if w in kinds]
    return base + sorted(more)


def general(term: str) -> str:
    """The kind of a term, by its form."""
    return "ACRONYM" if len(term) > 1 and term.isupper() else "NAME" if term[:1].isupper() else "WORD"


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base spans as [KIND], terms as their general form, and terms that reveal all left out. Overlapping spans merge, the first kind wins."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= at:
            out += [text[at:a], "" if kind == "gone" else f"[{general(text[a:b]) if kind == 'term' else kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


MADE = "pii_n_email long, pii_n_ip long, pii_n_card long, pii_n_phone long, pii_base string, pii_spans string, pii_text string"


def sanitise(df: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """df with pii_n_*, pii_base and pii_spans (kind:start:end, comma-joined) and pii_text, the sanitised text.

    Null texts count as empty and stay null in pii_text. Other columns pass through; columns of these names are replaced.
    Corpus counts cover all rows of df. Without evidence (SUPPORT) there are base spans only.
    """
    base = df.drop(*T._parse_datatype_string(MADE).names)
    found = disclosures(base, text)
    flagged = _flagged(found)
    if flagged is None:
        # too many pairs for each worker: every text gets its own pairs by a join on the keys that it asks for
        return _joined_flags(base, text, found, with_text)
    shared = df.sparkSession.sparkContext.broadcast(flagged)
    make = lambda: lambda texts: _columns([_row(t, _all_spans(t or "", shared.value), with_text) for t in texts], with_text)
    return with_columns(base, text, make, MADE if with_text else MADE.rpartition(",")[0])


def _columns(rows: list[list], with_text: bool) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(6 + with_text)]


def _row(t: str | None, spans: list[tuple[str, int, int]], with_text: bool) -> list:
    counts = {k: 0 for k in KINDS}
    for k, _, _ in spans:
        if k in counts:
            counts[k] += 1
    return [*counts.values(), _joined([s for s in spans if s[0] in counts]), _joined(spans), *([redacted(t, spans) if t is not None else None] if with_text else [])]


def _joined_flags(base: DataFrame, text: str, found: DataFrame, with_text: bool) -> DataFrame:
    """The same by a shuffle: each text asks for the keys of its entities with its terms, and gets those that are flagged."""

    def asked(t: str | None) -> list[int]:
        spans = base_spans(t)
        words = _hashes(_vocabulary(t, spans)) if spans else np.empty(0, np.int64)
        return [k for e in {_entity(k, t[a:b]) for k, a, b in spans} for k in _keys(_hashes([e]), words).tolist()]

    flags = found.select(_pair_key("e", "t").alias("k"), (F.col("share") >= REMOVE).alias("gone"))
    # rows travel whole, so that no column can clash; numbers of rows are written before they are used twice
    rows = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.monotonically_increasing_id().alias("i"), F.col(f"`{text}`").alias("t"))
    rows = written(with_columns(rows, "t", lambda: lambda texts: [[asked(t) for t in texts]], "asked array<long>").drop("t"), "pii-rows")
    got = rows.select("i", F.explode("asked").alias("k")).join(flags, "k").groupBy("i").agg(F.collect_list(F.struct("k", "gone")).alias("got"))
    own = fresh(base, "pii_in")
    full = rows.join(got, "i", "left").select("row.*", F.struct(F.col(f"row.`{text}`").alias("t"), "got").alias(own))

    def one(x: dict) -> list:
        pairs = sorted((g["k"], g["gone"]) for g in x["got"] or [])
        flagged = (np.array([k for k, _ in pairs], np.int64), np.array([gone for _, gone in pairs], bool))
        return _row(x["t"], _all_spans(x["t"] or "", flagged), with_text)

    make = lambda: lambda values: _columns([one(x) for x in values], with_text)
    return with_columns(full, own, make, MADE if with_text else MADE.rpartition(",")[0]).drop(own)


def base_digest(spans: Column) -> Column:
    return F.sha2(spans.cast("binary"), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", *[F.col(f"pii_n_{k}").alias(f"n_{k}") for k in KINDS], base_digest(F.col("pii_base")).alias("base_sha256"), F.col("pii_spans").alias("spans"))
