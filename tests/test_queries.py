"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted(([r[c] for c in order] for r in df.collect()), key=repr)
    other = sorted(([r[names.index(c)] for c in order] for r in cur.fetchall()), key=repr)
    close = lambda v: round(v, 6) if isinstance(v, float) else v
    assert [[close(v) for v in r] for r in mine] == [[close(v) for v in r] for r in other]


def test_deliveries_fold_each_run(spark, sf):
    want, last = [], {}
    e = sorted((r["event_id"], r["user_id"]) for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    for i, u in e:
        n, now = i % 5 + 1, last.get(u, 0)
        want.append((i, "ACCEPTED" if n == now + 1 else "DUPLICATE" if n == now else "GAP" if n > now else "OUT_OF_ORDER"))
        last[u] = n if n == now + 1 else now
    assert sorted((r["arrival"], r["delivery"]) for r in catalog.QUERIES["sequence_deliveries"](spark, sf).collect()) == want


def test_sliding_limit_folds_each_user(spark, sf):
    want, kept = [], {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])):
        t = r["ts"].timestamp()
        mine = kept[r["user_id"]] = [x for x in kept.get(r["user_id"], []) if x > t - 3600]
        want.append((r["event_id"], len(mine) < 3))
        if len(mine) < 3:
            mine.append(t)
    assert sorted((r["event_id"], r["allowed"]) for r in catalog.QUERIES["sliding_limit"](spark, sf).collect()) == sorted(want)


def test_near_duplicates_against_all_pairs(spark, sf):
    from folioforge.operators import documents as D

    rows = D.with_words(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "text").collect()
    sets = {r["doc_id"]: {tuple(r["words"][i : i + 5]) for i in range(max(1, len(r["words"]) - 4))} if r["words"] else set() for r in rows}
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert dict(catalog.QUERIES["near_duplicate_clusters"](spark, sf).collect()) == {d: top(d) for d in ids}


def test_bootstrap_interval_holds_the_rate(spark, sf):
    got = catalog.QUERIES["cluster_bootstrap"](spark, sf).collect()
    assert got and all(0 <= r["low"] <= r["rate"] + 1e-9 and r["rate"] <= r["high"] + 1e-9 <= 1 + 2e-9 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, catalog.QUERIES["cluster_bootstrap"](spark, sf).collect()))


def test_topics_by_their_first_words(spark, sf):
    import re
    import unicodedata

    from folioforge.operators.compare import TOPICS

    def fold(t):
        t = unicodedata.normalize("NFD", (t or "").lower().replace("đ", "d"))
        return re.sub(r"\s+", " ", "".join(c for c in t if unicodedata.category(c) != "Mn")).strip()

    def first(t):
        hits = [(m.start(), k, name) for k, (name, p) in enumerate(TOPICS) if (m := re.search(rf"\b(?:{p})\b", t))]
        return min(hits)[2] if hits else None

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert dict(catalog.QUERIES["topics"](spark, sf).collect()) == {r["doc_id"]: first(fold(r["source"])) or first(fold((r["text"] or "")[:80])) for r in rows}


def test_critical_tokens_against_python(spark, sf):
    import re

    from folioforge.functions import numbers as N

    folded = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", N.skeleton(F.col("text")).alias("t")).collect()}
    digits = lambda x: re.sub("[.,]", "", x)

    def tokens(t):
        out = ["money:" + digits(x) for x in re.findall(N.MONEY, t, re.A)]
        out += ["number:" + digits(x) for x in re.findall(N.GROUPED, re.sub(N.MONEY, "¤", t, flags=re.A), re.A)]
        out += ["percent:" + x.replace(",", ".") for x in re.findall(N.PERCENT, t, re.A)]
        for p in N.DATES:
            out += ["date:" + "/".join(y.rjust(2, "0") for y in re.findall(r"\d+", x, re.A)) for x in re.findall(p, t, re.A)]
        return out + ["contract:" + x for x in re.findall(N.CONTRACT_NUMBER, t, re.A)] + ["id:" + x for x in re.findall(N.LONG_NUMBER, t, re.A)]

    got = dict(catalog.QUERIES["critical_tokens"](spark, sf).collect())
    assert got == {d: tokens(t or "") for d, t in folded.items()} and any(got.values())


def test_candidates_keep_the_best_of_every_nation(spark, sf):
    got = catalog.QUERIES["ranked_candidates"](spark, sf).collect()
    per = {}
    for r in got:
        assert r["score"] == sum({"SAME_ARTICLE": 1, "SAME_KEY": 2}[s] for s in r["sources"]) and r["node_a"] < r["node_b"]
        per.setdefault(r["c_nationkey"], []).append((r["node_a"], r["node_b"]))
    assert all(len(v) == len(set(v)) <= 40 for v in per.values())


def test_reading_issues_of_every_line(spark, sf):
    from folioforge.functions import text as T

    got = {(r["doc_id"], r["line_no"]): r for r in catalog.QUERIES["reading_issues"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == sum((r["text"] or "").count("\n") + 1 for r in rows if r["text"] is not None)
    allowed = set(T._LETTERS + "0123456789 \t\r\x0b\x0c" + ".,;:!?()-/%\"'@")
    for r in rows:
        for k, line in enumerate((r["text"] or "").split("\n")):
            if line:
                assert abs(got[r["doc_id"], k]["garbage"] - sum(c not in allowed for c in line) / len(line)) < 1e-9
