"""The ten operators on small fixtures: brute force, nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import embeddings, html, jaccard, licenses, media, mixing, ngram, pieces, pii, quality
from folioforge.llm.common import shingle_set, word_hashes
from folioforge.llm.components import connected

TEXT = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# ---- words ------------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "A", "b", "é", "É", "x1", "　", "日本"]), max_size=12), st.sampled_from([" ", "\n", "\t\t", "\x0b "]))
def test_word_hashes_follow_the_words(parts, gap):
    text = gap.join(parts)
    assert len(word_hashes(text)) == len(words(text))
    assert len(set(word_hashes(text).tolist())) == len(set(words(text)))
    assert len(shingle_set(text)) == len(shingles(text))


# ---- 1 ----------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    d = spark.createDataFrame(
        [(1, "intro words here. Released under the MIT License. more words follow"), (2, "this work is LICENSED under the gnu general public license, version 3."), (3, None), (4, ""), (5, "two words"), (6, "all rights reserved"), (None, "All rights reserved."), (7, "nothing " * 3000 + "Licensed under the Apache License, Version 2.0.")],
        TEXT,
    ).withColumn("license_id", F.lit("clash"))
    got = sorted(((r["doc_id"], r["license_id"]) for r in licenses.scan(d).collect()), key=repr)
    assert got == sorted([(1, "MIT"), (2, "GPL-3.0"), (6, "all-rights-reserved"), (None, "all-rights-reserved"), (7, "Apache-2.0")], key=repr)
    assert licenses.scan(d.limit(0)).count() == 0
    assert licenses.collision_probability(1, 3) > 0.998


def test_license_scan_by_brute_force(spark, sf):
    """Every place of every text against every template, exactly; on documents with planted notices, whole, cut and edited."""
    rng = np.random.default_rng(11)
    cut = lambda t: [w for w in re.split(r'[\x09-\x0D\x20.,;:!?()\[\]"]+', t.translate(LOWER)) if w]
    triples = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    notices = {k: triples(cut(t)) for k, t in licenses.TEMPLATES.items()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    for i in range(120):
        w = list(licenses.TEMPLATES.values())[i % len(licenses.TEMPLATES)].split()
        if i % 3 == 1 and len(w) > 14:
            w[int(rng.integers(len(w)))] = "edited"
        if i % 3 == 2:
            w = w[: max(3, len(w) - int(rng.integers(3)))]
        noise = [f"n{int(x)}" for x in rng.integers(0, 50, 40)]
        at = int(rng.integers(40))
        docs.append((10_000 + i, " ".join(noise[:at] + w + noise[at:])))
    want = set()
    for d, text in docs:
        t = triples(cut(text or ""))
        near = {k: math.ceil(1.2 * len(n)) for k, n in notices.items()}
        for at in range(len(t)):
            met = {k for k, n in notices.items() if set(n) & set(t[at : at + 3])}
            share = {k: len(set(notices[k]) & set(t[max(0, at - near[k]) : at + 3 + near[k]])) / len(set(notices[k])) for k in met}
            best = max(share.values(), default=0)
            want |= {(d, k) for k, s in share.items() if s >= 0.8 and s == best}
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(spark.createDataFrame(docs, TEXT).repartition(3)).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)


# ---- 2 ----------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard_components(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = rng.choice(vocabulary, int(rng.integers(3, 90))).tolist()
        for _ in range(int(rng.integers(1, 8))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = "edit" + str(int(rng.integers(1000)))
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(rng.choice(vocabulary, 50))
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(vocabulary, 12))) for i in range(15)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE\ttwo"), (2005, "one two"), (2005, "one two"), (None, "one two"), (2006, "x " * 20000)]
    got = jaccard.components(spark.createDataFrame(rows, TEXT).repartition(3))
    assert sorted(((r["doc_id"], r["n"], r["component_id"]) for r in got.collect()), key=repr) == brute_components(rows)
    docs = spark.createDataFrame([(d, t, "src") for d, t in rows], TEXT + ", th string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    comp = brute_components(rows)
    assert kept.where("doc_id IS NOT NULL").count() == len({c for d, n, c in comp if n and d is not None}) - 1 + sum(1 for d, n, _ in comp if not n)
    assert jaccard.components(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_jaccard_routes_agree(spark, sf, monkeypatch):
    """Shuffle joins for broadcasts, many shards of fingerprints, small blocks and cells, and the index without fingerprints."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = lambda: sorted(map(tuple, jaccard.components(docs).select("doc_id", "n", "component_id").collect()))
    one = rows()
    assert one == brute_components([tuple(r) for r in docs.collect()]) or sorted(one, key=repr) == brute_components([tuple(r) for r in docs.collect()])
    for name, value in (("BROADCAST_ROWS", -1), ("SHARD_TOKENS", 1000), ("BLOCK", 2), ("CELL", 1), ("TOKENS_AT_ONCE", 500)):
        monkeypatch.setattr(jaccard, name, value)
    assert rows() == one
    monkeypatch.setattr(jaccard, "MOST_TOKENS", 0)
    assert rows() == one


def test_keep_one_has_no_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c", "x", 1), (1, "a b c", "w", 1), (2, "A b c", "y", 2), (3, "other", "z", 3)], "doc_id long, text string, th string, _id int").withColumns({"_text_hash": F.lit(1), "row": F.lit("r"), "again": F.lit(0), "own_id": F.lit(5)})
    got = jaccard.keep_one(d)
    assert got.columns == d.columns and sorted((r["doc_id"], r["th"]) for r in got.collect()) == [(1, "w"), (3, "z")]


def test_keep_one_keeps_unrelated_rows_of_null_or_repeated_ids(spark):
    clean = [f"unrelated clean text number{i} on topic{i} alone" for i in range(6)]
    rows = [(None, t) for t in clean[:3]] + [(7, t) for t in clean[3:5]] + [(8, clean[5]), (None, clean[0]), (9, clean[5].upper())]
    kept = jaccard.keep_one(spark.createDataFrame(rows, TEXT))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, t) for t in clean[:3]] + [(7, t) for t in clean[3:5]] + [(8, clean[5])], key=repr)


def test_connected(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60), (51, 50)], "a long, b long")
    assert dict(connected(e).collect()) == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
    assert connected(e.limit(0)).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    d = spark.createDataFrame([(i, "w " * (i % 7), ["a", "b", "c", None][i % 4], 1) for i in range(400)] + [(1000, None, "z", 1)], TEXT + ", source string, size int")
    t = {r["source"]: r for r in mixing.source_targets(d.select("source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    total = sum(r["source_size"] for r in t.values())
    # water filling, step by step
    order = sorted((s for s in t if s is not None)) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    want, open_, left = {s: 0.0 for s in order}, set(order), 1.5 * total
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            want[s] += unit * weight[s]
            if want[s] >= 2 * t[s]["source_size"]:
                left += want[s] - 2 * t[s]["source_size"]
                want[s] = 2.0 * t[s]["source_size"]
                open_.discard(s)
    assert all(abs(t[s]["target"] - want[s]) < 1e-6 for s in order)
    got = mixing.mix(d)
    assert got.columns == d.columns
    taken = Counter()
    for r in got.collect():
        taken[r["source"]] += r["text"].split().__len__() if r["text"] else 0
    assert all(abs(taken[s] - want[s]) <= 0.2 * max(1, want[s]) for s in order)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, mixing.mix(d.repartition(5)).collect()), key=repr)
    assert mixing.mix(d.limit(0)).count() == 0


# ---- 4 ----------------------------------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=700))
def test_media_round_trip(text):
    data = text.encode()
    n, size, sha, crc, stored, _, feature = media.digest(text)
    want = data + b"\xff" * (size - len(data))
    assert size % 576 == 0 and size > 0 and size - len(data) < 576 + 576 * (not data)
    assert (n, sha, crc) == (len(data), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert stored > size and media.digest(text)[-1] == feature


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (24, 24)])
def test_bmp_and_netpbm(shape):
    a = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_bmp(a))[:, :, 0] == a).all() and (media.decode(media.encode_pgm(a))[:, :, 0] == a).all()
    means = media.area_resize(a.astype(float), 2, 2)
    assert abs(means.mean() - a.mean()) < 1e-9


def test_netpbm_kinds(spark):
    assert media.decode(b"P1\n# c\n2 1\n1 0").tolist() == [[[0], [255]]]
    assert media.decode(b"P4\n2 1\n\x80").tolist() == [[[0], [255]]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[[258]]]
    d = spark.createDataFrame([(1, bytearray(b"P5 1 1 255\n\x07")), (2, None), (3, bytearray(b"junk")), (4, bytearray(b"P5 9 9 255\n\x01"))], "i int, image binary")
    got = {r["i"]: r for r in media.media_tiles(d).collect()}
    assert got[1]["media_height"] == 1 and got[1]["media_error"] is None and got[2]["media_error"] == "null" and got[3]["media_error"] and got[4]["media_tile"] is None
    assert media.text_media(spark.createDataFrame([], TEXT)).count() == 0
    same = media.text_media(spark.createDataFrame([(1, None), (2, "")], TEXT)).collect()
    assert same[0][1:] == same[1][1:]


# ---- 5 ----------------------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab@.-+ 0123459()é%_"), max_size=40))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_method(spark):
    rows = [(i, f"{a} Zorblatt writes from zor@blatt.example {b}") for i, (a, b) in enumerate([("today", "again"), ("later", "often"), ("now", "here")])]
    rows += [(10 + i, f"mail x{i}@y{i}.example here and there") for i in range(30)] + [(99, None), (100, ""), (101, "clean text"), (102, "4111 1111 1111 1111 and 10.0.0.1 or +84 912 345 678")]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, TEXT)).collect()}
    assert "Zorblatt" not in got[0]["pii_text"] and "[EMAIL]" in got[0]["pii_text"] and got[101]["pii_text"] == "clean text"
    assert got[99]["pii_text"] is None and got[99]["pii_spans"] == "" and got[100]["pii_text"] == ""
    assert got[102]["pii_text"] == "[CARD] and [IP] or [PHONE]"
    assert all(got[d]["pii_base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or "")) for d, t in rows)


def test_pii_join_route_agrees(spark, monkeypatch):
    rows = [(i, f"Zorblatt {x} zor@blatt.example") for i, x in enumerate("abc")] + [(9, None)] + [(20 + i, f"see u{i}@v.example") for i in range(9)]
    d = spark.createDataFrame(rows, TEXT)
    one = sorted(map(tuple, pii.sanitise(d).collect()), key=repr)
    d = d.withColumns({c: F.lit(7) for c in ("row", "i", "t", "got", "asked", "pii_in", "k")})
    one = sorted(map(tuple, pii.sanitise(d).collect()), key=repr)
    assert any("term:" in r[-2] or "gone:" in r[-2] for r in one)
    monkeypatch.setattr(pii, "BROADCAST_PAIRS", -1)
    assert sorted(map(tuple, pii.sanitise(d).collect()), key=repr) == one


def test_pii_flags_by_brute_force(spark):
    """Which words are spans, with which kind, by counting over distinct texts as the docstring says; general forms in the text."""
    rng = np.random.default_rng(6)
    people = [("Ann", "ann@one.example", "ACME"), ("Bob", "+84 912 345 678", "zeta"), ("Cem", "10.1.2.3", "Quux")]
    common = [c * 3 for c in "abcdefghijklm"]
    rows = []
    for i in range(60):
        w = rng.choice(common, 12).tolist()
        if i % 2:
            name, value, other = people[int(rng.integers(3))]
            w = w[:4] + ([name] if rng.random() < 0.8 else []) + w[4:8] + [value] + w[8:] + ([other] if rng.random() < 0.6 else [])
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[1][1]) for i in range(5)] + [(200, "Ann and zeta met"), (201, None)]
    texts = {t or "" for _, t in rows}
    sets = {t: ({pii._entity(k, t[a:b]) for k, a, b in plain_spans(t)}, {w for w, _, _ in pii.terms(t, plain_spans(t))}) for t in texts}
    n, n_e, n_t, n_b = len(texts), Counter(), Counter(), Counter()
    for e, w in sets.values():
        n_e.update(e)
        n_t.update(w)
        n_b.update((x, y) for x in e for y in w)
    share = {(x, y): math.log(n * c / (n_e[x] * n_t[y])) / math.log(n / n_e[x]) for (x, y), c in n_b.items() if c >= 2 and 2 <= n_e[x] < n}
    assert any(0.5 <= s < 0.95 for s in share.values())
    for r in pii.sanitise(spark.createDataFrame(rows, TEXT).repartition(3)).collect():
        t = dict(rows)[r["doc_id"]] or ""
        top = {w: max([share.get((e, w), 0) for e in sets[t][0]], default=0) for w in sets[t][1]}
        more = sorted(("gone" if top[w] >= 0.95 else "term", a, b) for w, a, b in pii.terms(t, plain_spans(t)) if top[w] >= 0.5)
        assert r["pii_spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t) + more)
    assert pii.redacted("Jane MET ann", [("term", 0, 4), ("term", 5, 8), ("term", 9, 12)]) == "[NAME] [ACRONYM] [WORD]"
    assert pii.sanitise(spark.createDataFrame([], TEXT)).count() == 0


def test_pii_of_many_spans_is_linear():
    import time

    text, begun = " ".join(f"user{i}@host{i}.example and more" for i in range(40000)), time.time()
    assert len(pii.terms(text, pii.base_spans(text))) == 80000 and time.time() - begun < 10


def test_pii_sees_the_whole_text(spark):
    far = " ".join(["so", "it", "was", "with", "many", "other", "words", "in", "between"] * 20)
    rows = [(i, f"Jane Zorblatt {x} {far} zor@blatt.example {far} {y} Zorblatt") for i, (x, y) in enumerate([("today", "again"), ("later", "often")])]
    rows += [(10 + i, f"{far} x{i}@y{i}.example") for i in range(30)] + [(50, "Zorblatt alone")]
    d = spark.createDataFrame(rows, TEXT)
    got = {r["doc_id"]: r["pii_text"] for r in pii.sanitise(d).collect()}
    assert all("Zorblatt" not in got[i] and "Jane" not in got[i] and "between" in got[i] for i in (0, 1))
    assert got[50] == "Zorblatt alone" and all(got[10 + i] == f"{far} [EMAIL]" for i in range(30))


def test_pii_counts_documents(spark):
    """Fixed words around an entity in otherwise different documents are evidence; exact copies of one document are one."""
    rows = [(i, f"report{'abcdef'[i]}x\nsigned by contact Jane Zorblatt at zor@blatt.example") for i in range(6)]
    rows += [(20 + i, "one copied note by Quux quux@corp.example") for i in range(5)] + [(40 + i, f"see user{i}@v.example") for i in range(9)]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, TEXT).repartition(3)).collect()}
    assert all("Zorblatt" not in got[i]["pii_text"] and f"report{'abcdef'[i]}x" in got[i]["pii_text"] for i in range(6))
    assert all(got[20 + i]["pii_text"] == "one copied note by Quux [EMAIL]" for i in range(5))
    terms = {pii._hash(x): x for x in ("jane", "zorblatt", "quux", "see")}
    found = pii.disclosures(spark.createDataFrame(rows + [(60, "Zorblatt elsewhere"), (61, "Zorblatt elsewhere")], TEXT).repartition(3)).collect()
    share = {terms[r["t"]]: r["share"] for r in found if r["t"] in terms}
    assert share.keys() == {"jane", "zorblatt"} and abs(share["jane"] - 1) < 1e-9
    assert abs(share["zorblatt"] - math.log(17 * 6 / (6 * 7)) / math.log(17 / 6)) < 1e-9  # of 17 distinct texts


# ---- 6 ----------------------------------------------------------------------------------------------------------------


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by its definition, over dictionaries: log10 of each token's probability in a text."""
    toks = [words(t) + ["</s>"] for t in texts]
    level = {order: Counter(g for t in toks for p in [["<s>"] * (order - 1) + t] for g in zip(*[p[k:] for k in range(order)], strict=False))}
    for n in range(order - 1, 0, -1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    level[1] = Counter({g: c for g, c in level[1].items() if g != ("<s>",)})
    distinct = len({w for t in toks for w in t})
    discount = {n: ngram._discounts([sum(c == k for c in level[n].values()) for k in (1, 2, 3, 4)]) for n in level}

    def p(history, w):
        n = len(history) + 1
        lower = p(history[1:], w) if n > 1 else 1 / (distinct + 1)
        begun = [c for g, c in level[n].items() if g[:-1] == history]
        if not begun:
            return lower
        c, d = level[n][(*history, w)], discount[n]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in begun) * lower) / sum(begun)

    def score(text):
        t = ["<s>"] * (order - 1) + words(text) + ["</s>"]
        return [math.log10(p(tuple(t[k - order + 1 : k]), t[k])) for k in range(order - 1, len(t))]

    return score, p, distinct, Counter(w for t in toks for w in t)


@pytest.mark.parametrize("order, least", [(3, 1000), (3, 0), (2, 1000), (2, 2)])
def test_kneser_ney(spark, monkeypatch, order, least):
    """least: how often a word must come to be dealt as a frequent one."""
    monkeypatch.setattr(ngram, "HOT_LEAST", least)
    monkeypatch.setattr(ngram, "GATHER", 40)
    rng = np.random.default_rng(7)
    rows = [(1, "a b a b c"), (2, "A b c d"), (3, "a b"), (4, None), (5, "e f a b"), (6, "a b c")] + [(10 + i, " ".join(rng.choice(list("abcdefgh"), 12, p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05]))) for i in range(12)]
    model = ngram.fit(spark.createDataFrame(rows, TEXT).repartition(3), order=order)
    plain, p, distinct, c = kneser_ney([t for _, t in rows], order)
    assert (model.order, model.tokens, model.distinct) == (order, sum(c.values()), len(c)) and (least < 1000) == (len(model.hot) > 1)
    for history in [("a", "b"), ("<s>", "<s>"), ("c", "zz"), ("zz", "a")]:
        assert abs(sum(p(history[1 - order :], w) for w in [*c, "?"]) - 1) < 1e-9
    new = rows + [(70, "zz a zz"), (80, "b " * 500), (81, "a zz b c zz zz a b"), (82, "h g f e d c b a")]
    for r in ngram.score(spark.createDataFrame(new, TEXT), model).collect():
        t = words(dict(new)[r["doc_id"]]) + ["</s>"]
        assert abs(r["score"] - sum(plain(dict(new)[r["doc_id"]]))) < 1e-6
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (model.tokens + 0.5 * (model.distinct + 1))) for w in t)) < 1e-6
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(w in c for w in t))


def test_counts_over_a_byte_stay_exact():
    x = np.array([1, 254, 255, 3, 70_000, 2**33])
    assert ngram._counts_at(ngram._small(x), np.array([5, 0, 2, 4, 1, 3])).tolist() == [2**33, 1, 255, 70_000, 254, 3]


def test_language_model_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], TEXT)
    model = ngram.fit(d.limit(0))
    assert model.tokens == 0 and ngram.score(d, model).first()["score"] == 0.0


def test_arrays_by_shipping(spark, tmp_path, monkeypatch):
    """The route of stores that can't be opened as folders: arrays go through Parquet and addFile."""
    from folioforge.llm import arrays

    monkeypatch.setattr(arrays.Store, "folder", property(lambda self: None))
    at = arrays.store(spark, "shipped")
    name, data = at.put("x", np.arange(5))
    _, ready = arrays.filled(spark, spark.createDataFrame([(name, bytearray(data))], arrays.ROW), at, "shipped-rows")
    assert ready.get("x").tolist() == [0, 1, 2, 3, 4]


# ---- 7 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table():
    rows = [("<unk>", 0.0, "other"), ("▁", -9.0, "piece"), ("a", -5.0, "piece"), ("b", -5.5, "piece"), ("ab", -2.0, "piece"), ("▁a", -3.0, "piece"), ("▁ab", -6.0, "piece"), ("ba", -4.0, "piece"), ("bab", -3.5, "piece")]
    return pieces.from_table(rows, 0, True)


def encoded(spark, p, texts):
    """Ids of each text through the lattice, the fold and the mapped arrays."""
    d = spark.createDataFrame(list(enumerate(texts)), TEXT)
    return [r["ids"] for r in pieces.encode(d, p).orderBy("doc_id").collect()]


def test_viterbi_in_two_ways(spark, table):
    texts = ["ab", "a b", "abab bab ba", "ab" * 25, "ab" * 40, "é b", "", "  ab", "aé𝒳b"]
    plain = pieces.Encoder(table)
    assert encoded(spark, table, texts) == [x.tolist() for x in plain(texts)]
    words = sorted({w for t in texts for w in plain.find(pieces.escaped(t)) if 1 < len(w) <= pieces.LATTICE_CHARS})
    rows = pieces.encoded_words(spark.createDataFrame([(0, w) for w in words], "shard int, word string"), table).collect()
    assert {r["word"]: "".join(table.names[i] if i >= 0 else chr(-1 - i) for i in r["ids"]) for r in rows} == {w: w for w in words}


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("abcd"), min_size=2, max_size=5), min_size=1, max_size=12, unique=True), st.lists(st.text(st.sampled_from("abcd"), min_size=2, max_size=14), min_size=1, max_size=6))
def test_merges_of_any_table(spark, names, words):
    """Merge order against merging plainly, for tables whose pieces need not come from merges."""
    rows = [("<unk>", 0.0, "other")] + [(c, -100.0, "piece") for c in "abc"] + [(n, -float(k), "piece") for k, n in enumerate(names)]
    p = pieces.from_table(rows, 0, False)
    rank = {n: k for k, n in enumerate(names)}

    def plain(w):
        parts = list(w)
        while True:
            ready = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
            if not ready:
                return [p.names.index(x) if x in p.names else -1 - ord(x) for x in parts]
            k = min(ready)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    words = sorted(set(words))
    got = pieces.encoded_words(spark.createDataFrame([(0, w) for w in words], "shard int, word string").coalesce(1), p)
    known = {r["word"]: [p.names.index(chr(-1 - i)) if i < 0 and chr(-1 - i) in p.names else i for i in r["ids"]] for r in got.collect()}
    assert known == {w: plain(w) for w in words if w in known} and all(len(plain(w)) == len(w) for w in words if w not in known)
    assert all(pieces.Encoder(p).one(w) == tuple(i if i >= 0 else 0 for i in plain(w)) for w in words)


def test_like_the_library(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    p, path = pieces.load(), pieces.MODEL_FILE
    texts = ["The quick brown fox, 1234!", " leading  and   trailing ", "línea\n\nnueva\ttab", "日本語 𝒳 text", "x" * 500, "", "<s> </s> <0x41>", "ab" * 300 + " end"]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [x.tolist() for x in pieces.Encoder(p)(texts)] == [library.encode(t) for t in texts] == encoded(spark, p, texts)
    spec = proto.ModelProto()
    spec.ParseFromString(open(path, "rb").read())
    spec.trainer_spec.model_type = 1
    for x in spec.pieces:
        x.score = max(x.score, -40000.0)
    unigram = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    u = replace(p, unigram=True, scores=tuple(max(s, -40000.0) for s in p.scores))
    assert [x.tolist() for x in pieces.Encoder(u)(texts)] == [unigram.encode(t) for t in texts] == encoded(spark, u, texts)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "▁")], TEXT + "").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(d, p, round_trip="ok"), p).collect()}
    assert all(got[i]["decoded"] == t and got[i]["ok"] for i, t in enumerate(texts))
    assert got[90]["ids"] == [] and got[90]["ok"] and not got[91]["ok"] and got[91]["decoded"] == " "
    assert pieces.encode(d.limit(0), p).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert all(r["ids"] == library.encode(r["text"] or "") for r in pieces.encode(docs, p).collect())


def test_words_and_units_of_any_text():
    """Words don't cross units; the ids are the library's, and are known to spell the text again unless it has U+2581."""
    import sentencepiece

    p = pieces.load()
    library, plain = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE), pieces.Encoder(p)
    odd = pieces.from_table([("<unk>", 0.0, "other"), ("a\nb", -1.0, "piece"), ("a", -2.0, "piece"), ("▁\t", -3.0, "piece")], 0, False)

    @settings(max_examples=200, deadline=None)
    @given(st.text(st.sampled_from("  \n\t▁aébT.,(1日𝒳"), max_size=30))
    def check(t):
        for q in (p, odd):
            cut, lines, find = pieces.unit_cutter(q), pieces.own_lines(q), re.compile(pieces.word_pattern(q)).findall
            units = cut(t) if t else []
            assert "".join(pieces.spelled(u, lines) for u in units) == pieces.escaped(t).replace(pieces.SPACE, " ")
            assert [w for u in units for w in find(pieces.escaped(u) or pieces.SPACE if pieces.spelled(u, lines)[0] == " " else u)] == find(pieces.escaped(t))
        ids, size, exact = plain.arrays([t])
        assert ids.tolist() == library.encode(t) and size.tolist() == [len(ids)] and exact.tolist() == [True]
        got = pieces.Encoder(odd)([t])[0].tolist()
        assert not t or got == [i for w in find(pieces.escaped(t)) for i in pieces.Encoder(odd).one(w)]

    check()


def test_lattice_of_few_words(spark):
    """Punctuation and digits, which no piece joins to letters, make no further words of the lattice; pieces that merges never make are no edges."""
    p = pieces.load()
    d = spark.createDataFrame([(1, "enst, enst. enst! enst1"), (2, "enst enst)")], TEXT)
    assert [r["word"] for r in pieces.distinct_words(d, p, "text", 4).collect()] == ["▁enst"]
    q = pieces.from_table([("<unk>", 0.0, "other"), ("ab", -1.0, "piece"), ("bc", -2.0, "piece"), ("abcd", -3.0, "piece"), ("abc", -4.0, "piece"), ("bcd", -5.0, "piece"), ("xyz", -6.0, "piece")], 0, False)
    assert q.merges() == {1: (1, False), 2: (1, False), 3: (3, True), 4: (2, False), 5: (2, False)}
    assert {r["piece"] for r in pieces.piece_table(spark, q).collect()} == {"ab", "bc", "abcd", "abc", "bcd"}
    spaces = ["a" + " " * k + "b" for k in range(1, 45)]
    assert encoded(spark, p, spaces) == [x.tolist() for x in pieces.Encoder(p)(spaces)]


def test_edges_of_a_word_are_numbers(spark, monkeypatch):
    """What a task holds for all its words is one number an edge, wide enough for the longest words, the last starts and the greatest ids."""
    held, lattice = [], pieces.lattice

    def seen(*args):
        held.append(lattice(*args))
        return held[-1]

    monkeypatch.setattr(pieces, "lattice", seen)
    chars = "".join(chr(0x4E00 + k) for k in range(pieces.LATTICE_CHARS))
    for names in ([chars[: k + 2] for k in range(len(chars) - 1)], [chars[-k - 2 :] for k in range(len(chars) - 1)]):
        p = pieces.from_table([("<unk>", 0.0, "other")] + [("", 0.0, "other")] * 70_000 + [(c, -1e6, "piece") for c in chars] + [(n, -float(k), "piece") for k, n in enumerate(names)], 0, False)
        words = [chars, chars[1:], chars[:-1], chars[:30] + chars[:30], chars[58:] * 30, chars[:2] * 30]
        got = pieces.encoded_words(spark.createDataFrame([(0, w) for w in words], "shard int, word string"), p).collect()
        assert dict(held[-1].dtypes)["edges"] == "array<bigint>"
        one = pieces.Encoder(p).one
        known = {r["word"]: tuple(p.names.index(chr(-1 - i)) if i < 0 else i for i in r["ids"]) for r in got}
        assert known == {w: one(w) for w in known} and chars in known and len(known[chars]) == 1
        assert all(len(one(w)) == len(w) for w in words if w not in known)


# ---- 8 ----------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(240):
        v = base[i % 40] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.2])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (901, rows[0][1], 0), (902, None, 0), (903, [0.0] * 16, 0), (904, [float("nan")] * 16, 0), (905, rows[0][1], None), (906, [1.0, None], 1), (907, [], 1), (908, [1.0], 1), (909, [2.0], 1)]
    got = {}
    for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    up = list(range(len(good)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(good)
    for i, (_, a, la) in enumerate(good):
        for j, (_, b, lb) in enumerate(good):
            if i != j and la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i] += 1
                up[top(i)] = top(j)
    least = {}
    for i, (d, _, _) in enumerate(good):
        least[top(i)] = min(least.get(top(i), d), d)
    found = sum(got[d][0][0] for d, _, _ in good)
    assert found >= 0.9 * sum(links) and all(got[d][0][0] <= links[i] for i, (d, _, _) in enumerate(good))
    assert sum(got[d][0][1] == least[top(i)] for i, (d, _, _) in enumerate(good)) >= 0.95 * len(good)
    assert all(got[d] == [(0, d, True)] for d in (902, 903, 904, 905, 906, 907)) and got[908] == [(1, 908, True)]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_multi_index_of_many_cells(spark, monkeypatch):
    """Grids of 8 x 8 cells and more: recall against brute force, no link below the threshold, blocks of split cells."""
    monkeypatch.setattr(embeddings, "PER_CELL", 4)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    fitted = []
    monkeypatch.setattr(embeddings, "_fit", lambda c, fit=embeddings._fit: fitted.append(fit(c)) or fitted[-1])
    rng = np.random.default_rng(9)
    base = rng.standard_normal((700, 32))
    x = np.concatenate([base, base[:300] + 0.1 * rng.standard_normal((300, 32)), base[:200] + 0.17 * rng.standard_normal((200, 32)), base[:40]])
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    assert min(len(b) for b in fitted[0].by_dim[32][:2]) >= 8
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    assert links.sum() > 500 and all(got[i] <= n for i, n in enumerate(links)) and sum(got.values()) >= 0.97 * links.sum()


def test_visits_are_all_sums_within_the_bound():
    rng = np.random.default_rng(1)
    a, b = rng.random((50, 9)), rng.random((50, 7))
    got = set(zip(*(x.tolist() for x in embeddings._visits(a, b, 0.4)), strict=True))
    assert got == {(r, i, j) for r in range(50) for i in range(9) for j in range(7) if a[r, i] + b[r, j] <= 0.4}
    x, book = rng.standard_normal((30, 6)), rng.standard_normal((5, 6))
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    own = d.argmin(1)
    want = ((d - d[np.arange(30), own][:, None]) / (2 * np.maximum(np.sqrt(((book[own][:, None] - book[None]) ** 2).sum(2)), 1e-150))) ** 2
    assert np.allclose(embeddings._borders(x, book), want)


# ---- 9 ----------------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = np.random.default_rng(2)
    vocabulary = "the of and contract payment goods party shall deliver price term law".split()
    rows = [(i, " ".join(rng.choice(vocabulary, 60)) if i % 2 else " ".join(f"{w}$$$###" for w in rng.choice(vocabulary, 60)).upper(), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "word " * 50000)], TEXT).withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5000, 1), (1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (rows[i][2] == 1) for i in held) >= 0.97 * len(held)
    assert got[900] == got[901] and 0 <= got[902] <= 1
    assert 0 < quality.score(docs, quality.fit(docs, labels.limit(0))).first()["quality_score"] < 1
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_quality_by_brute_force(spark, sf):
    """Sizes by the library itself, the curve's optimum, and held-out accuracy and calibration on the labelled documents."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    model = quality.fit(docs, labels)
    text = dict(docs.collect())
    size = lambda t, words: sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_dict_id=False).compress(t[k : k + quality.BLOCK])) for k in range(0, len(t), quality.BLOCK))
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    for d in sorted(text)[:60]:
        t = (text[d] or "").encode()
        g, b = size(t, model.good), size(t, model.bad)
        m = [(b - g) / (b + g), (b + g) / 2 / len(t)] if t else [0, 0]
        x = [m[0], m[1], m[1] ** 0.5, m[1] ** 2, math.log(len(t) or 1)]
        assert abs(got[d] - 1 / (1 + math.exp(-sum(a * w for a, w in zip(x, model.weights, strict=False)) - model.weights[-1]))) < 1e-9
    known = {}
    for r in labels.where("quality IS NOT NULL").collect():
        known[r["doc_id"]] = min(known.get(r["doc_id"], 1), r["quality"])
    held = [d for d in known if d in text and zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum((got[d] >= 0.5) == (known[d] == 1) for d in held) >= 0.95 * len(held)
    assert abs(sum(got[d] for d in held) - sum(known[d] for d in held)) <= 0.05 * len(held)


def test_logistic_is_the_optimum():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 2)) * [1, 30] + [5, 0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 5 + x[:, 1] / 30)))).astype(float)
    w = np.array(quality._logistic(x, y, 0.0))
    z, wide = (x - x.mean(0)) / x.std(0), x.std(0)
    slope, at = w[:-1] * wide, w[-1] + w[:-1] @ x.mean(0)
    loss = lambda s, c: -(y * (z @ s + c) - np.logaddexp(0, z @ s + c)).sum() + 0.5 * (quality.RIDGE * s @ s + 1e-6 * c * c)
    best = loss(slope, at)
    assert all(loss(slope + d, at + e) >= best - 1e-9 for d in np.eye(2) * 1e-3 for e in (-1e-3, 0, 1e-3)) and all(loss(slope - d, at) >= best - 1e-9 for d in np.eye(2) * 1e-3)


def test_quality_is_fitted_on_whole_texts(spark):
    rng = np.random.default_rng(3)
    vocabulary = "the of and contract payment goods party shall deliver price term law".split()
    head = [" ".join(rng.choice(vocabulary, 4000))[:16384].ljust(16384, "x") for _ in range(30)]
    rows = [(i, t + (" ".join(rng.choice(vocabulary, 3000)) if i % 2 else "$#" * 20000)) for i, t in enumerate(head)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    whole = quality.fit(spark.createDataFrame(rows, TEXT), labels)
    cut = quality.fit(spark.createDataFrame([(i, t[:16384]) for i, t in rows], TEXT), labels)
    assert whole.bad != cut.bad and whole.weights != cut.weights
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(spark.createDataFrame(rows, TEXT), whole).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i, _ in rows)


# ---- 10 ---------------------------------------------------------------------------------------------------------------


WORDS = "Words of the article, one after the other, go on and on in this part"
SIDE = "<p>Other words that no reader of the page asked for, in some length</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b&nbsp;c</p><p>d</p>", "a & b c d"),
        ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>one, two<br>three<p><b>four</b>ty</article><div class='comments'><p>so long a comment, really</p></div><footer>f</footer></body>", "T one, two three fourty"),
        ("<header>Site</header><div class=sidebar><p>side words, many of them, and more</p></div><main><section><p>First part, with words.</p></section><section><p>Second.</p></section><form>f<input></form><aside>x</aside></main>", "First part, with words. Second."),
        ("<div id=content><p>" + "word, " * 30 + "</p><div class='cookie-notice'>we use cookies</div><script>var t='</p>';</script><p>end</p></div><div><a href=a>l</a><a href=b>m</a></div>", ("word, " * 30).strip() + " end"),
        ("<article><p>cut off <b>he", "cut off he"),
        # names that speak of others, contradict each other, or stand on what holds the article
        (f'<div class="content no-sidebar"><p>{WORDS}</p><p>{WORDS}</p></div><div>{SIDE}</div>', f"{WORDS} {WORDS}"),
        (f'<div class="post tags-news share-open"><p>{WORDS}</p></div>', WORDS),
        (f'<div class="has-sidebar"><div class="sidebar">{SIDE}</div><div class="entry"><p>{WORDS}</p></div></div>', WORDS),
        (f'<form id="aspnet"><div id="main"><p>{WORDS}</p></div></form>', WORDS),
        (f"<div class=sidebar><p>{WORDS}</p></div>", WORDS),
        # text in odd places
        (f"<article><p title=don't>{WORDS}</article>", WORDS),
        (f'<article><p title="a > b">{WORDS}</p></article>', WORDS),
        (f"<article><p>{WORDS} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", f"{WORDS} x=2"),
        (f"<article><p>{WORDS}</p><pre>a  b\nc</pre><ul><li>one<li>two</ul><table><tr><td>k<td>v</table><figure><figcaption>cap</figcaption></figure></article>", f"{WORDS} a b c one two k v cap"),
        (f"<main><header><h1>Title</h1></header><div><p>{WORDS}</p></div></main>", f"Title {WORDS}"),
        (f"<div><h2>Title</h2><div><p>{WORDS}</p><p>{WORDS}</p></div></div><div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></div>", f"Title {WORDS} {WORDS}"),
        (f"<div>{WORDS}<br>{WORDS}</div><div><a>l</a></div>", f"{WORDS} {WORDS}"),
        (f"<body>{WORDS}</body>", WORDS),
        # what is not the article
        (f"<article><p>{WORDS}</p><div class=advert>{SIDE}</div><div class='related posts-related'><a>x</a></div><section id=comments>{SIDE * 9}</section></article>", WORDS),
        (f"<div id=page><div id=content><p>{WORDS}</p></div><div class=comment-list>{SIDE * 20}</div></div>", WORDS),
        (f"<article><p>{WORDS}</p><div role=complementary>{SIDE}</div><p style='display: none'>x</p><p hidden>y</p><noscript>z</noscript><select><option>o</select></article>", WORDS),
        (f"<div><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>{WORDS}</p></div>", WORDS),
        (f"<article><p>{WORDS}</p></article><article><p>{WORDS}</p></article><aside>{SIDE}</aside>", f"{WORDS} {WORDS}"),
        ("<nav><a>only</a><a>links</a></nav>", ""),
        ("no markup at all &lt;here", "no markup at all <here"),
        ("<!-- c --><p>x < y</p></i></div>", "x < y"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


PARAGRAPHS = [f"Paragraph {i} has enough words, commas and text to read like an article about what matters to people." for i in range(6)]
NAMES = "social-science search-engines side-effects banner-year comment-on-law header-compression skip-list login-security promo-code-review related-work tags".split()


@pytest.mark.parametrize("name", NAMES)
def test_names_of_an_article_are_no_proof(name):
    body, want = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), " ".join(PARAGRAPHS)
    for own in ("class", "id"):
        assert html.main_text(f'<body><div {own}="{name}">{body}</div><div class="box">Something of 24 charact</div></body>') == want
    got = html.main_text(f'<body><nav><a href="x">menu</a></nav><article><h1>T</h1>{body}<section id="{name}"><h2>Sub</h2><p>More of it.</p></section></article><footer>foot</footer></body>')
    assert got == f"T {want} Sub More of it."


def test_references_are_kept_and_menus_are_not():
    body, want = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), " ".join(PARAGRAPHS)
    titles = [f"Smith and others, a study of things, part {i}" for i in range(5)]
    long_list = "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(titles)) + "</ul>"
    short = "<ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul>"
    assert html.main_text(f"<article>{body}{long_list}</article>") == want + " " + " ".join(titles)
    assert html.main_text(f"<article>{body}<h2>See also</h2>{short}</article>") == want + " See also One Two Three"
    assert html.main_text(f"<article>{body}{short}</article>") == html.main_text(f"<article>{short}{body}</article>") == want


@pytest.mark.parametrize(
    "junk",
    [
        '<div class="comments"><h3>Comments</h3><div class="comment"><p>I disagree, really, with all of this.</p></div></div>', '<div id="comments"><p>I disagree, really.</p></div>', '<div class="share-buttons"><a>x</a></div>', '<div class="ad">Buy this now, please do.</div>', "<aside>Side</aside>",
        '<div class="cookie-banner">We use cookies.</div>', '<div class="newsletter-signup"><p>Join us</p><input></div>', '<div id="sidebar"><p>Latest news, and others.</p></div>', '<div class="related-posts"><a>One more story of it</a></div>', "<ul><li><a>A</a></li><li><a>B</a></li><li><a>C</a></li></ul>",
        '<div class="breadcrumb"><a>Home</a> &gt; <a>News</a></div>', '<div class="site-notice">Notice: this site, now.</div>', '<section class="comments">' + '<div class="comment"><p>I say a word, or two, of it all.</p></div>' * 60 + "</section>",
    ],
)
def test_what_is_not_the_article(junk):
    body, want = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), "T " + " ".join(PARAGRAPHS)
    for page in (f"<body><article><h1>T</h1>{body}</article>{junk}</body>", f"<body>{junk}<article><h1>T</h1>{body}</article></body>", f"<body><article><h1>T</h1>{body}{junk}</article></body>", f"<body><div class=wrap><div><h1>T</h1>{body}</div>{junk}</div></body>"):
        assert html.main_text(page) == want


def test_main_text_is_what_a_plain_reading_of_the_article_gives(spark, sf):
    import html as entities

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        text = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|ul|li|div)\b[^>]*>", " ", re.sub(r"<script.*?</script>", "", inner, flags=re.S)))
        assert html.main_text(r["html"]) == " ".join(entities.unescape(text).split())


@pytest.mark.parametrize("page", ["<b>" * 30000 + "</i>" * 30000, "<i><div>" + "<b>" * 30000 + "</i>" * 30000, "<p><div>" + "<b>" * 20000 + "<p></p>" * 20000, "<div class=ad>" * 30000 + "x", "<article><div class=ad>" * 15000 + "x", "<div>" * 30000 + "x", "<a title='" * 3000])
def test_parsing_is_linear(page):
    import time

    begun = time.time()
    html.main_text(page)
    assert time.time() - begun < 5


def test_extract_keeps_columns(spark):
    d = spark.createDataFrame([(1, "<p>x</p>", "clash"), (2, None, "y")], "page_id int, html string, main_text string")
    assert [tuple(r) for r in html.extract(d).orderBy("page_id").collect()] == [(1, "<p>x</p>", "x"), (2, None, "")]
    assert html.extract(d.limit(0)).count() == 0


# ---- ids ----------------------------------------------------------------------------------------------------------------


def test_ids_and_other_columns_stay_exact(spark):
    """64-bit numbers beside nulls, in the id and in a column that only passes through."""
    big = 2**60 + 1
    d = spark.createDataFrame([(big, "a b c a@b.example", None), (None, "a b c", big + 2), (3, None, 5)], TEXT + ", other long").coalesce(1)
    want = {(big, None), (None, big + 2), (3, 5)}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    p = pieces.load()
    for out in (pii.sanitise(d), html.extract(d, html="text"), pieces.encode(d, p), pieces.decode(pieces.encode(d, p), p), quality.score(d, quality.fit(d, labels)), jaccard.keep_one(d), mixing.mix(d.withColumn("source", F.lit("s")), weights=(1,))):
        assert {(r["doc_id"], r["other"]) for r in out.collect()} <= want and {r["doc_id"] for r in out.collect()} >= {big}
    for out in (media.text_media(d), ngram.score(d, ngram.fit(d))):
        assert {r["doc_id"] for r in out.collect()} == {big, None, 3}
    assert media.media_tiles(d.withColumn("image", F.lit(None).cast("binary"))).where(f"doc_id = {big} OR other = {big + 2}").count() == 2


def test_mixing_has_no_clashing_columns(spark):
    d = spark.createDataFrame([(i, "w w", "s", "x") for i in range(20)], TEXT + ", source string, mix_target string").withColumns({c: F.lit("y") for c in ("_mix_key", "mix_copies", "mix_source_size", "row", "t", "copies", "draw", "source_key")})
    got = mixing.mix(d)
    assert got.columns == d.columns and got.count() > 0


# ---- all --------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_by_brute_force(spark, sf):
    """Each stage on what the one before kept: scores, components, spans, copies and the library's ids."""
    import corpus_pipeline
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, good, unique, clean, mixed = [], docs, None, None, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        good = stage(spark, good, sf)
        assert good.columns == docs.columns, name
        good = spark.createDataFrame(good.collect(), docs.schema)
        kept.append([tuple(r) for r in good.collect()])
    good, unique, clean, mixed = kept
    score = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert sorted(r[0] for r in good) == sorted(d for d, s in score.items() if s >= 0.5)
    comp = brute_components([(r[0], r[1]) for r in good])
    assert sorted(r[0] for r in unique) == sorted({c for _, n, c in comp if n} | {d for d, n, _ in comp if not n})
    spans = {r["doc_id"]: r["pii_spans"] for r in pii.sanitise(spark.createDataFrame(unique, docs.schema)).collect()}
    text = {r[0]: r[1] for r in unique}
    for r in clean:
        parts = [x.split(":") for x in spans[r[0]].split(",") if x]
        assert r[1] == pii.redacted(text[r[0]], [(k, int(a), int(b)) for k, a, b in parts]) and r[4] == len(r[1])
    size, total = Counter(r[0] for r in mixed), Counter()
    for r in clean:
        total[r[3]] += len(words(r[1]))
    targets = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([(r[3], len(words(r[1]))) for r in clean], "source string, size long")).collect()}
    for r in clean:
        rate = targets[r[3]] / total[r[3]] if total[r[3]] else 0
        assert size[r[0]] in (math.floor(rate), math.floor(rate) + 1)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    out = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(mixed, docs.schema), sf)
    want = Counter((r[0], tuple(library.encode(r[1]))) for r in mixed)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == want


def test_pipeline_runs(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids"] and out.count() > 0
