"""Exact top-k, whitening and the audit of filters: brute force, nulls, ties, repeated rows, empty tables, clashing columns."""

import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import filters, topk, whitening
from folioforge.llm.queries import ORACLES, QUERIES
from folioforge.llm.vectors import pack, unpack, whole

VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("name", ["op11_exact_topk", "op13_filter_audit"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    df = QUERIES[name](spark, sf)
    assert [d[0] for d in cur.description] == df.columns
    want = sorted(cur.fetchall())
    assert want and sorted(map(tuple, df.collect())) == want


def odd_vectors(dim=3):
    """Copies, repeated rows, unsound vectors, other lengths and numbers beyond every bound."""
    nan, inf = float("nan"), float("inf")
    rows = [(100 + i, [1.0] * dim) for i in range(60)] + [(140, [1.0] * dim), (140, [1.0] * dim), (None, [1.0] * dim), (None, None)]
    rows += [(160, None), (180, [1.0, nan, 2.0]), (200, [1.0, None, 2.0]), (220, [inf, 0.0, 0.0]), (240, []), (241, []), (260, [0.5]), (261, [-0.5]), (262, [0.25])]
    return rows + [(280, [1e30, -1e30, 1e300]), (281, [1e30, 1.0, 0.0]), (300, [0.0] * dim), (301, [-0.0] * dim), (300, [2.0, 0.0, 0.0])]


def is_sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    return tuple(clip(math.floor(x * scale)) if math.isfinite(x * scale) else (2**63 - 1 if x > 0 else -(2**63)) for x in v)


def brute_top(rows, k=20):
    good = [(i, floors(v, 64.0)) for i, v in rows if is_sound(v)]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = []
    for at, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            others = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=True))), j is None, j or 0) for b_at, (j, w) in enumerate(good) if b_at != at and len(w) == len(v))
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(others[:k])]
    return sorted(out, key=repr)


def found_top(df, **kw):
    return sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, **kw).collect()), key=repr)


def test_top_k_of_odd_rows(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("x", F.lit("clash")).withColumn("q", F.lit(1)).withColumn("annulus", F.lit(2))
    assert found_top(df) == brute_top(rows)
    assert found_top(df.limit(0)) == [] and found_top(df.where("vec_id % 20 = 1")) == []
    assert topk.search(df, F.col("vec_id") == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_top_k_of_clusters_stops_early(spark, monkeypatch):
    """Many annuli, blocks split in both directions, ties in every score; a query of a cluster never meets most of the others."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 12] + rng.standard_normal(8).round(1) * 0.3]) for i in range(3000)]
    rows += [(4000 + i, [float(x) for x in centres[3]]) for i in range(500)]
    for name, value in {"PER_ANNULUS": 40, "ROUNDS": (50, 300), "BLOCK_NUMBERS": 1 << 9, "BLOCK_QUERIES": 3, "FIT_ROWS": 700}.items():
        monkeypatch.setattr(topk, name, value)
    met = []
    visited = topk._visits
    monkeypatch.setattr(topk, "_visits", lambda *a: met.append(visited(*a)) or met[-1])
    assert found_top(spark.createDataFrame(rows, VECTORS)) == brute_top(rows)
    queries = sum(1 for i, _ in rows if i % 20 == 0)
    assert sum(v.count() for v in met) < 0.5 * queries * 3000 / 40


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(9)
    for scale in (1, 40, 10**6):
        x = np.floor(rng.standard_normal((400, 6)) * scale)
        index = topk.Index.fit(x[:100], 400 * topk.PER_ANNULUS // 16)
        annulus, r = index.keys(x)
        names = np.unique(annulus)
        square = (x**2).sum(1)
        d = topk.Directory(index, names, *(np.array([f(v[annulus == a]) for a in names]) for f, v in ((np.min, r), (np.max, r), (np.max, square), (len, r))))
        assert len(names) > 10
        bound = d.bounds(x)
        for k, a in enumerate(names):
            assert (bound[:, k][:, None] >= x @ x[annulus == a].T).all()


def test_packed_vectors():
    for v in ([], [0], [127, -128], [128], [-(2**63), 2**63 - 1], [70000, -5]):
        x = np.array(v, np.int64)
        assert unpack(pack(x)).tolist() == v
    assert whole(np.array([-0.0, -1e-300, 0.999, 1e300, -1e300]), 64.0).tolist() == [0, -1, 63, 2**63 - 1, -(2**63)]
    assert len(pack(np.zeros(64, np.int64))) == 65


# ---- 12 ---------------------------------------------------------------------------------------------------------------


def test_symmetric_qr_against_lapack():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 6, 40, 90):
        b = rng.standard_normal((n, n))
        for a in (b @ b.T, b + b.T, np.eye(n) * 3, np.multiply.outer(b[0], b[0]) if n else b, np.diag(rng.standard_normal(n)), (b @ b.T) * 1e12, np.zeros((n, n))):
            values, vectors = whitening.symmetric_qr(a)
            size = max(1e-300, np.abs(a).max(initial=0))
            assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max(initial=0) <= 1e-12 * size * max(1, n)
            assert np.abs(vectors.T @ vectors - np.eye(n)).max(initial=0) < 1e-12
            assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-12 * size * max(1, n)


def test_moments_merge_as_one_sample():
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (500, 5)) + np.array([10**9, 0, -5, 3, 7])
    m = whitening.Moments.none(5)
    for part in np.split(x, [0, 1, 60, 61, 300]):
        own = whitening.Moments.none(5)
        own.add(part)
        own.count(part)
        m = m.merge(own)
    assert m.n == 500 and m.sums == x.sum(0).tolist()
    assert np.abs(m.m2 / 500 - np.cov(x.T, bias=True)).max() < 1e-6 * 1000**2


def brute_whitening(rows):
    x = {}
    for d in {len(v) for _, v in rows if is_sound(v)} - {0}:
        own = [(i, floors(v, 256.0)) for i, v in rows if is_sound(v) and len(v) == d]
        fit = np.array(sorted({v for _, v in own}), np.float64).reshape(-1, d)
        sums = [sum(c) for c in zip(*{v for _, v in own}, strict=True)]
        x[d] = own, fit, sums
    return x


def test_whitening_by_numpy(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.query(spark, sf).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(256 * np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], np.float64))
    fit = np.unique(x, axis=0)
    v = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    want = (x - fit.mean(0)) @ vectors / np.sqrt(values)
    mine = got["whitened"].to_numpy().reshape(-1, 4)
    for k in range(4):
        assert min(np.abs(mine[:, k] - want[:, k]).max(), np.abs(mine[:, k] + want[:, k]).max()) < 1e-9
    assert np.abs(got["explained"].to_numpy().reshape(-1, 4) - values / np.trace(v)).max() < 1e-12
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert (got["n"] == len(fit)).all() and (got["deviation"].to_numpy()[::4] == ((len(fit) * x - fit.sum(0)) ** 2).sum(1)).all()


def test_whitening_of_odd_rows(spark, monkeypatch):
    rows = odd_vectors() + [(500 + i, [float(i), float(i * i % 7), 1.0]) for i in range(50)]
    rows = [(i, v) for i, v in rows if i not in (280, 281)]
    df = spark.createDataFrame(rows, VECTORS).repartition(9).withColumn("component", F.lit("clash")).withColumn("x", F.lit("clash"))
    one = sorted(map(tuple, whitening.whiten(df).collect()), key=repr)
    monkeypatch.setattr(whitening, "FAN", 2)
    two = sorted(map(tuple, whitening.whiten(df.repartition(23)).collect()), key=repr)
    assert [r[:4] for r in one] == [r[:4] for r in two] and all(abs((a[4] or 0) - (b[4] or 0)) < 1e-9 for a, b in zip(one, two, strict=True))
    want = []
    for d, (own, fit, sums) in brute_whitening(rows).items():
        v = (fit - fit.mean(0)).T @ (fit - fit.mean(0)) / len(fit)
        values = np.linalg.eigvalsh(v)[::-1]
        for i, x in own:
            dev = sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            want += [(i, k + 1, len(fit), dev, bool(values[k] > 1e-9 * max(1, values[0]))) for k in range(min(4, d))]
    assert sorted([(*r[:4], r[4] is not None) for r in one], key=repr) == sorted(want, key=repr)
    assert all(r[6] < 1e-9 and (r[5] > 0) == (r[4] is not None) or r[4] is None for r in one)
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_beyond_bounds(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])]
    got = sorted(map(tuple, whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert [r[:3] for r in got] == sorted((i, k, 3) for i in (1, 2, 3, 3) for k in (1, 2))
    assert all(r[3] is None for r in got if r[0] < 3)
    alone = whitening.whiten(spark.createDataFrame([(7, [1.0, 2.0])], VECTORS)).collect()
    assert [tuple(r) for r in alone] == [(7, 1, 1, 0, None, 0.0, 0.0), (7, 2, 1, 0, None, 0.0, 0.0)]


# ---- 13 ---------------------------------------------------------------------------------------------------------------


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for i in filters.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == sum(1 for _ in filters.swaps(n)) + 1


def brute_audit(docs, labels):
    """Every order applied to every document, one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}

    def fails(d, text, f):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        if f == "A":
            return len(words) < 50
        if f == "B":
            return 100 * len(set(words)) < 65 * len(words)
        if f == "C":
            return 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)
        if f == "D":
            return bool(re.search("[#$%&*|]", text))
        return d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs)

    rows = [(d, s or "", {f for f in "ABCDE" if fails(d, t or "", f)}) for d, t, s in docs]
    out, shapley = [], {}
    for part in {s for _, s, _ in rows}:
        own = [r for r in rows if r[1] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                failing = sum(f in r[2] for r in own)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[2] == {f} for r in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", " \x0b\n", "A" * 5, "ÀÉ é", "w " * 60, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), " ".join(f"W{i}" for i in range(60)), "x\x1cy z " * 55, "100% " + " ".join(f"v{i}" for i in range(70)), "long " * 20000, "a|b"]
    docs = [(int(i) if rng.random() > 0.1 else None, texts[int(rng.integers(len(texts)))], [None, "", "s1", "s2"][int(rng.integers(4))]) for i in rng.integers(0, 150, 220)]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(0, 160, 90)] + [(None, 1, 1), (3, None, None)]
    df = spark.createDataFrame([(*d, 0, "clash") for d in docs], "doc_id long, text string, source string, mask int, digest string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filters.audit(df, lab).collect())) == brute_audit(docs, labels)
    assert sorted(map(tuple, filters.audit(df, lab.limit(0)).collect())) == brute_audit(docs, [])
    assert filters.audit(df.limit(0), lab).count() == 0
