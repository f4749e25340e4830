"""Rankings of blocks of queries against all pairs: ties, copies, nulls, odd vectors, many blocks."""

import math
import random
from functools import reduce

from pyspark.sql import functions as F

from folioforge.operators import retrieval as Q
from folioforge.operators import scoring
from folioforge.plans import catalog


def ranked(scores, k):
    """scores: (query, id, score) with none last and not-a-number first."""
    out = []
    for q in {s[0] for s in scores}:
        key = lambda s: (s[2] is None, not (s[2] is not None and math.isnan(s[2])), -(s[2] or 0), s[1])
        out += [(q, i, r + 1) for r, (_, i, _) in enumerate(sorted((s for s in scores if s[0] == q), key=key)[:k])]
    return sorted(out)


def got(df, key):
    return sorted((r["query_id"], r[key], r["rank"]) for r in df.collect())


def test_bm25_top_k_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + [f"rare{i}" for i in range(60)]
    docs = {i: " ".join(rng.choice(words[:12] if rng.random() < 0.8 else words) for _ in range(rng.randrange(0, 25))) for i in range(90)}
    docs |= {i: docs[i - 100] for i in range(100, 140)} | {200: None, 201: "", 202: "Unasked"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    q = d.where("doc_id % 6 = 0").selectExpr("doc_id AS query_id", "text AS query")
    tokens = {i: (t or "").lower().split() for i, t in docs.items()}
    n, avg = len(docs), sum(len(tokens[i]) for i in docs if docs[i] is not None) / (len(docs) - 1)
    df = {w: sum(w in t for t in tokens.values()) for t in tokens.values() for w in t}
    idf = lambda w: math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
    score = lambda a, b: sum(idf(w) * tokens[b].count(w) * 2.2 / (tokens[b].count(w) + 1.2 * (0.25 + 0.75 * len(tokens[b]) / avg)) for w in tokens[a] if w in tokens[b])
    want = ranked([(a, b, round(score(a, b), 5)) for a in docs if a % 6 == 0 for b in docs if set(tokens[a]) & set(tokens[b])], 7)
    assert len(want) > 100 and got(Q.bm25_top_k(d, q, 7, 5), "doc_id") == want
    for name, value in (("GRID", 60), ("PRODUCTS", 50), ("DENSE_WORDS", 3)):
        monkeypatch.setattr(scoring, name, value)
    monkeypatch.setattr(Q, "ASKED_WORDS", 40)
    assert got(Q.bm25_top_k(d, q, 7, 5), "doc_id") == want
    assert Q.bm25_top_k(d, q.limit(0), 7, 5).count() == 0 and Q.bm25_top_k(d.limit(0), q, 7, 5).count() == 0


def test_vector_top_k_equals_all_pairs(spark):
    rng = random.Random(5)
    vectors = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(80)}
    vectors |= {i: vectors[i - 100] for i in range(100, 130)} | {200: [0.0] * 6, 201: [1e-170] * 6, 202: [float("nan")] * 6, 203: [1e200] * 6, 204: [1.0, None, 0.0, 0.0, 0.0, 0.0], 205: [1.0, 2.0], 206: [3.0, 1.0], 207: None, 210: []}

    def cosine(a, b):
        if any(x is None for x in a + b):
            return None
        dot = lambda x, y: reduce(lambda t, pq: t + pq[0] * pq[1], zip(x, y, strict=True), 0.0)  # noqa: E731  (sum() makes up for rounding)
        norm = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return -1.0 if norm == 0 else dot(a, b) / norm

    v = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(4)
    q = v.where("vec_id % 5 = 0 OR vec_id >= 200").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    pairs = [(a, b, cosine(x, y)) for a, x in vectors.items() for b, y in vectors.items() if (a % 5 == 0 or a >= 200) and x is not None and y is not None and len(x) == len(y)]
    assert got(Q.vector_top_k(v, q, 9), "vec_id") == ranked(pairs, 9)
    exact = {(a, b): s for a, b, s in pairs}
    assert all(r["score"] == s or math.isnan(s) for r in Q.vector_top_k(v, q, 9).collect() if (s := exact[r["query_id"], r["vec_id"]]) is not None)


def test_rankings_make_no_row_for_a_pair(spark, sf):
    for name in ("bm25_topk", "cosine_topk"):
        assert "Join" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_ties_beyond_k_are_the_smallest_ids(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).repartition(7)
    assert got(Q.bm25_top_k(d, d.where("doc_id = 3").selectExpr("doc_id AS query_id", "text AS query"), 5, 5), "doc_id") == [(3, i, i + 1) for i in range(5)]
