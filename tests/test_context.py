"""Parts and findings of contracts by hand, explicit targets, and a long text against references."""

import time

from pyspark.sql import functions as F

from folioforge.operators import compare as C
from folioforge.operators import context as CX
from folioforge.operators import documents as D

NODES = "dossier string, file string, node_id string, page int, ord int, text string"
BODY = [
    ("d", "f", "n1", 1, 1, "Hợp đồng. Xem Phụ lục 01 và phụ lục số 7."), ("d", "f", "n2", 1, 2, "Theo phụ lục 7, phụ lục 9a."), ("d", "f", "n3", 2, 3, "Phụ lục 1\nBảng giá"), ("d", "f", "n4", 3, 4, "Giá là 5"),
    ("d", "f", "n5", 4, 5, "PHỤ LỤC SỐ 2: sửa đổi Điều 3.2 và Điều 1 ngày 01/02/2024"), ("d", "f", "n6", 5, 6, "Phụ lục 2 nhắc lại, bổ sung điều 4"), ("d", "g", "n7", 1, 7, "Phụ lục 3"), ("d", "g", "n8", 2, 8, "kèm theo hợp đồng"), ("d", "h", "n9", 1, 9, "Không có số"), ("e", "f", "m1", 1, 1, None),
]


def context(spark):
    nodes = spark.createDataFrame(BODY, NODES)
    files = spark.createDataFrame([("d", "f", "body"), ("d", "g", "annex"), ("d", "h", "annex"), ("e", "f", "body")], "dossier string, file string, role string")
    return CX.placed(nodes, nodes.select("dossier", "file", "page", "text").groupBy("dossier", "file", "page").agg(F.max_by("text", F.lit(1)).alias("text")), files)


def test_parts_and_findings(spark):
    found = context(spark).cache()
    assert {r["node_id"]: r["part"] for r in found.collect()} == {"n1": "body", "n2": "body", "n3": "annex:1", "n4": "annex:1", "n5": "annex:2", "n6": "annex:2", "n7": "annex:3:g", "n8": "annex:3:g", "n9": "annex:file:h", "m1": "body"}
    facts = spark.createDataFrame([("d", "n4", "price", "5"), ("d", "n6", "price", "6"), ("d", "n4", "term", "1"), ("d", "n8", "term", "1"), ("d", "n1", "price", "9")], "dossier string, node_id string, item_key string, value string")
    got = sorted((r["kind"], r["subject"], r["state"], r["relation"], ",".join(r["nodes"]), ",".join(r["details"]["clauses"]), ",".join(r["details"]["values"]), ",".join(r["details"]["parts"])) for r in CX.findings(found, facts).collect())
    assert got == [
        ("AMENDMENT_SIGNAL", "annex:2", "NEEDS_REVIEW", "AMENDS", "n5,n6", "1,3.2,4", "", ""), ("CONTEXT_CONFLICT", "price", "NEEDS_REVIEW", None, "n4,n6", "", "5,6", "annex:1,annex:2"),
        ("CONTEXT_GAP", "annex:2", "NEEDS_REVIEW", None, "n5", "", "", ""), ("CONTEXT_GAP", "annex:7", "NEEDS_REVIEW", None, "n1", "", "", ""),
        ("PART_LINK", "annex:", "PASS", "REFERENCES", "n1,n2", "", "", ""), ("PART_LINK", "annex:1", "PASS", "REFERENCES", "n1", "", "", ""), ("PART_LINK", "annex:3", "PASS", "REFERENCES", "n8", "", "", ""),
    ]
    assert CX.findings(found.limit(0)).count() == 0


CHAIN = "struct<diem:string,khoan:string,dieu:string,phu_luc:string>"


def provisions(spark):
    at = lambda k=None, a=None, p=None, d=None: (d, k, a, p)
    rows = [
        ("d", "a1", 1, at(a="1"), "Điều 1. Giá"), ("d", "a11", 2, at("1", "1"), "1. Giá là 5."), ("d", "a12", 3, at("2", "1"), "2. Theo khoản 1 và khoản 9."), ("d", "a3", 4, at(a="3"), "Điều 3"), ("d", "a31", 5, at("1", "3"), "1. Như khoản 2 Điều 1; khoản 1 cũng vậy."),
        ("d", "a32", 6, at("2", "3"), "2. Theo Điều 1 của Luật Thương mại. Theo Điều 3 Nghị định 5."), ("d", "x", 7, at("7", "3"), "Xem khoản 7."), ("d", "y", 8, at("7", "3"), "Xem Điều 8."), ("d", "z", 9, at("5", "3"), "Xem khoản 7 Điều 3; Điều 1."),
    ]
    return spark.createDataFrame(rows, f"dossier string, node_id string, ord int, chain {CHAIN}, text string")


def test_explicit_targets(spark):
    """An address takes the article of the one before it, else its node's own; laws, unknown and ambiguous targets are dropped."""
    got = sorted((r["node_a"], r["node_b"]) for r in CX.explicit_targets(provisions(spark), ["dossier"]).collect())
    assert got == [("a12", "a11"), ("a31", "a11"), ("a31", "a12"), ("z", "a1")]


def test_three_sources_dealt_round_by_round(spark):
    nodes = provisions(spark)
    explicit = CX.explicit_targets(nodes, ["dossier"]).select("node_a", "node_b")
    banded = C.banded_pairs(nodes.withColumn("g", F.col("chain.dieu")), ["g"], "ord")
    verbatim = C.verbatim_pairs(nodes, "text", "ord")
    sources = {"EXPLICIT_REF": explicit, "SAME_ARTICLE": banded, "VERBATIM": verbatim}
    place = {r["node_id"]: r["ord"] for r in nodes.collect()}
    pairs = {}
    for name, d in sources.items():
        for r in d.collect():
            pairs.setdefault(tuple(sorted((r["node_a"], r["node_b"]), key=lambda n: (place[n], n))), set()).add(name)
    scored = [(a, b, sorted(s), sum(C.WEIGHTS[x] for x in s)) for (a, b), s in pairs.items()]
    turns, dealt = {}, []
    for a in {p[0] for p in scored}:
        turns[a] = sorted((p for p in scored if p[0] == a), key=lambda p: (-p[3], p[1]))
    while any(turns.values()):
        dealt += sorted((q.pop(0) for q in turns.values() if q), key=lambda p: (-p[3], place[p[0]], p[0], p[1]))
    for k in (3, 7, 100):
        got = [(r["node_a"], r["node_b"], r["sources"], r["score"]) for r in C.rank_candidates(sources, nodes.select("node_id", "ord"), top_k=k).collect()]
        assert sorted(got) == sorted(dealt[:k]) and len(got) == min(k, len(dealt))


def test_long_texts_and_repeats(spark):
    """A text of a hundred thousand words, most of them repeated; hashes with repeats only propose."""
    long_text = " ".join(f"w{i % 40000}" for i in range(100_000))
    part = " ".join(f"w{i}" for i in range(500, 540))
    docs = spark.createDataFrame([(1, long_text), (2, "a b c d e " * 50), (3, None), (4, part), (5, part + " more words here")], "doc_id int, text string")
    refs = spark.createDataFrame([(7, part), (8, "a b c d e f g h i j"), (9, "short one"), (10, None)], "item_id int, text string")
    begun = time.time()
    got = sorted((r["doc_id"], r["item_id"], round(r["contained"], 3)) for r in D.contaminated(docs, refs, "doc_id", "item_id").collect())
    assert got == [(1, 7, 1.0), (4, 7, 1.0), (5, 7, 1.0)] and time.time() - begun < 60
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100).withColumn("text", F.concat("text", F.lit(" end"))))
    clusters = dict(D.near_duplicate_clusters(twice).collect())
    assert clusters[101] == 1 and clusters[104] == 4 and clusters[5] == 5 or clusters[5] == 4
    assert clusters[102] == 2 and clusters[3] == 3 and clusters[103] == 103
