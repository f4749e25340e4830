import pytest
from pyspark.sql import functions as F

from folioforge.operators import compare as C
from folioforge.operators import documents as D
from folioforge.operators import events as E
from folioforge.operators import graph as G
from folioforge.operators import relational as R
from folioforge.operators import retrieval as Q
from folioforge.operators import stats as S
from folioforge.operators import tables as T


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_segments(spark):
    text = "Chương I\nmở đầu\nĐiều 1. Giá\nnội dung\n1. khoản một\na) điểm a\ntiếp\n2. khoản hai\nChương II\nbỏ\nPhụ lục 1\nx"
    got = D.segment_clauses(D.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]))
    assert rows(got, "label", "level", "text") == sorted([("Điều 1", 1, "Giá\nnội dung"), ("1.", 2, "khoản một"), ("a)", 3, "điểm a\ntiếp"), ("2.", 2, "khoản hai"), ("Phụ lục 1", 1, "x")], key=repr)
    parents = {r["label"]: r["parent_no"] for r in got.collect()}
    number = {r["label"]: r["node_no"] for r in got.collect()}
    assert parents["a)"] == number["1."] and parents["2."] == number["Điều 1"] and parents["Phụ lục 1"] is None


def test_ladder_order(spark):
    kind = "struct<currency:string,tax_basis:string,unit:string,scope:string,condition:string,source_role:string,validity:string,period_start:string,money:long,normalized_value:string>"
    base = dict(currency=None, tax_basis=None, unit=None, scope=None, condition=None, source_role="body", validity=None, period_start=None, money=5, normalized_value=None)
    cases = [
        (base, base, "COMPARABLE_MATCH"),
        (base, base | {"money": 6}, "COMPARABLE_DIFFERENCE"),
        (base | {"currency": "VND"}, base | {"currency": "USD", "scope": "x"}, "NOT_COMPARABLE"),
        (base | {"currency": "VND", "tax_basis": "ex_vat"}, base, "NEEDS_EVIDENCE"),
        (base | {"tax_basis": "ex_vat"}, base, "COMPARABLE_MATCH"),
        (base | {"period_start": "2024"}, base, "NEEDS_EVIDENCE"),
        (base | {"source_role": "annex", "validity": "1"}, base | {"source_role": "annex", "validity": "2"}, "NOT_COMPARABLE"),
        (base | {"money": None, "normalized_value": "a"}, base | {"money": None, "normalized_value": "a"}, "COMPARABLE_MATCH"),
        (base | {"money": None}, base, "NEEDS_EVIDENCE"),
        (base | {"unit": "m"}, base | {"unit": "kg"}, "COMPARABLE_MATCH"),
        (base | {"unit": "VND"}, base | {"unit": "USD"}, "NOT_COMPARABLE"),
    ]
    d = spark.createDataFrame([(i, tuple(a.values()), tuple(b.values())) for i, (a, b, _) in enumerate(cases)], f"i int, l {kind}, r {kind}")
    got = dict(d.select("i", C.decision()).collect())
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_two_source_pairs(spark):
    f = spark.createDataFrame(
        [("k", 1, "body", None, "10", None, False), ("k", 2, "body", None, "12", None, True), ("k", 3, "annex", "1", "10", None, False), ("k", 4, "annex", "1", "10", None, False), ("k", 5, "annex", "2", "11", None, False), ("m", 6, "annex", "1", "1", None, False), ("m", 7, "annex", "2", "2", None, False)],
        "item_key string, ord long, source_role string, validity string, raw_value string, normalized_value string, is_price boolean",
    )
    got = C.two_source_pairs(f).select("item_key", "l.ord", F.col("r.ord").alias("r"))
    assert rows(got) == [("k", 1, 2), ("k", 2, 3), ("k", 2, 5), ("m", 6, 7)]


def test_pair_symmetry_and_jaccard(spark):
    d = spark.createDataFrame([(2, 1), (1, 2)], "a int, b int")
    assert d.select(C.pair_key(F.col("a"), F.col("b"))).distinct().count() == 1
    j = spark.createDataFrame([([], []), ([1], [1, 2])], "a array<int>, b array<int>").select(C.jaccard(F.col("a"), F.col("b")), C.containment(F.col("a"), F.col("b")))
    assert [tuple(r) for r in j.collect()] == [(0.0, 0.0), (0.5, 1.0)]


def test_greedy_and_alignment(spark):
    s = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.8), ("g", 2, 1, 0.85), ("g", 2, 2, 0.1)], "g string, a int, b int, s double")
    assert rows(C.greedy_one_to_one(s, ["g"], "a", "b", "s"), "a", "b") == [(1, 1), (2, 2)]
    left = spark.createDataFrame([("f", 1, 3, ["thanh", "toan"], ["a"]), ("f", 2, 4, ["khac"], ["x", "y"])], "f string, art_id int, number int, title_words array<string>, words array<string>")
    right = spark.createDataFrame([("f", 7, 9, ["thanh", "toan", "tien"], ["b"]), ("f", 8, 4, ["nua"], ["x", "y"])], left.schema)
    assert rows(C.align_articles(left, right, ["f"]), "l_art_id", "r_art_id") == [(1, 7), (2, 8)]


def test_candidates_round_robin(spark):
    pos = spark.createDataFrame([(i, i) for i in range(1, 7)], "node_id int, ord int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 6)], "node_a int, node_b int")
    got = C.rank_candidates({"SAME_KEY": pairs, "VERBATIM": spark.createDataFrame([(3, 1)], pairs.schema)}, pos, top_k=2)
    assert rows(got, "node_a", "node_b", "score") == [(1, 3, 6), (5, 6, 2)]
    assert C.topic_of is not None


def test_interval_and_topic(spark):
    d = spark.createDataFrame([("gia < 5", "gia >= 5"), ("gia < 5", "gia > 3"), ("gia < 5", "tien > 3"), ("x", "y")], "a string, b string")
    assert [r[0] for r in d.select(C.interval_overlap(F.col("a"), F.col("b"))).collect()] == ["DISJOINT", "PARTIAL", None, None]
    t = spark.createDataFrame([(None, "Thanh toán và bảo hành"), ("Giao hàng", "thanh toán"), (None, "x")], "c string, t string")
    assert [r[0] for r in t.select(C.topic_of(F.col("c"), F.col("t"))).collect()] == ["PAYMENT", "DELIVERY", None]


def test_frames(spark):
    slot = "map<string,struct<state:string,value:string>>"
    g = lambda v: ("GROUNDED", v)
    side = f"struct<profile:string,scope:string,family:string,slots:{slot}>"
    a = ("p", "s", "OBLIGATION", {"bearer": g("A"), "action": g("pay"), "amount": g("5")})
    cases = [(a, a, "COMPARABLE_MATCH"), (a, (*a[:3], {**a[3], "amount": g("6")}), "COMPARABLE_DIFFERENCE"), (a, (*a[:3], {**a[3], "action": ("UNKNOWN", None)}), "NEEDS_EVIDENCE"), (a, ("q", *a[1:]), "NOT_COMPARABLE")]
    d = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(cases)], f"i int, l {side}, r {side}")
    assert [r[0] for r in d.orderBy("i").select(C.compare_frames()).collect()] == [c[2] for c in cases]


def test_addresses(spark):
    d = spark.createDataFrame([("Bãi bỏ khoản 3 và khoản 4 Điều 7",), ("điểm c khoản 1 Điều 3 và Điều 9",), ("không",)], "t string")
    got = [[G_ for G_ in r[0]] for r in d.select(F.transform(G.parse_addresses(F.col("t")), G.canonical_address)).collect()]
    assert got == [["khoan 3 dieu 7", "khoan 4 dieu 7"], ["diem c khoan 1 dieu 3", "dieu 9"], []]


def test_resolution_and_order(spark):
    kind = G.ADDRESS
    nodes = spark.createDataFrame([("n1", (None, None, "7", None), "1) abc 3. def"), ("n2", (None, "1", "7", None), "x"), ("n3", (None, None, "8", None), "x"), ("n4", (None, None, "8", None), "x")], f"node_id string, chain {kind}, text string")
    refs = spark.createDataFrame([("r1", (None, "1", "7", None)), ("r2", (None, "3", "7", None)), ("r3", (None, None, "8", None)), ("r4", (None, "9", "7", None))], f"ref_id string, address {kind}")
    got = {r["ref_id"]: (r["state"], r["node_id"]) for r in G.resolve_addresses(refs, nodes, []).collect()}
    assert got == {"r1": ("UNIQUE", "n2"), "r2": ("ANCESTOR", "n1"), "r3": ("AMBIGUOUS", None), "r4": ("NOT_FOUND", None)}
    c = spark.createDataFrame([("p", 1, 10, "a"), ("p", 2, 5, "b"), ("p", 2, 20, "c"), ("p", 3, 15, "d"), ("p", 3, 30, "e")], "p string, item_no int, position int, node_id string")
    assert rows(G.disambiguate_by_order(c, ["p"]), "item_no", "node_id") == [(1, "a"), (2, "c"), (3, "e")]


def test_relation_graph(spark):
    n = spark.createDataFrame(
        [("d", "f1", "a1", None, "CLAUSE", "Điều 1", "“Hàng” có nghĩa là vật"), ("d", "f1", "a2", None, "CLAUSE", "Điều 2", "theo Điều 1 và Điều 9; giao Hàng đúng hạn"), ("d", "f2", "b1", None, "CLAUSE", "Điều 1", "Sửa đổi Điều 1")],
        "dossier_id string, file_id string, node_id string, parent_id string, node_type string, label string, text string",
    )
    edges, issues = G.relation_graph(n)
    got = rows(edges, "from_node", "to_node", "type")
    assert ("a1", "b1", "SAME_CLAUSE") in got and ("a2", "a1", "REFERENCES") in got and ("a2", "a1", "USES_DEFINED_TERM") in got and ("a1", "a1", "DEFINES") in got
    assert rows(issues, "node_id", "target", "issue") == [("a2", "9", "MISSING_TARGET")]


def test_ancestors_and_reach(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "node int, parent int")
    assert G.ancestors(n, [], "node", "parent").where("node = 8").count() == 8
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "s int, t int")
    assert rows(G.reachable(e, spark.createDataFrame([(1,)], "s int"), "s", "t")) == [(1,), (2,), (3,)]


def test_boq_and_schedule(spark):
    li = spark.createDataFrame(
        [("ok", "line", "2", "5", "10", None), ("ok", "subtotal", None, None, "10", None), ("ok", "tax", None, None, "1", 10), ("ok", "total", None, None, "11", None), ("bad", "line", "2", "5", "11", None), ("bad", "subtotal", None, None, "12", None), ("bad", "total", None, None, "13", None)],
        "t string, role string, quantity string, price string, amount string, tax_rate int",
    )
    got = {r["t"]: (r["state"], r["issues"]) for r in T.check_boq(li, ["t"]).collect()}
    assert got == {"ok": ("PASS", []), "bad": ("NEEDS_REVIEW", ["LINE_AMOUNT_MISMATCH", "SUBTOTAL_MISMATCH", "TOTAL_MISMATCH"])}
    s = spark.createDataFrame([("a", "Đợt 1", "30%"), ("a", "Đợt 2", "70%"), ("b", "x", "50"), ("b", "x", "60"), ("c", "y", "-1")], "t string, l string, p string")
    assert {r["t"]: r["issues"] for r in T.payment_schedule(s, ["t"], "l", "p").collect()} == {"a": [], "b": ["DUPLICATE_LABEL", "SUM_NOT_100"], "c": ["INVALID_PERCENT", "SUM_NOT_100"]}


def test_table_shapes(spark):
    r = spark.createDataFrame([(1, [["STT", "Nội dung", "Thành tiền"], ["1", "Bơm", "1.234.000"], ["2", "Van", ""], ["3", "Ống", "1.234"]])], "t int, rows array<array<string>>")
    assert rows(T.table_facts(r, ["t"]), "row_no", "label", "review_state") == [(1, "Bơm", "PASS"), (2, "Van", "MISSING"), (3, "Ống", "NEEDS_REVIEW")]
    m = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 |",)], "x string").select(T.rectangular(T.markdown_table(F.col("x")))).first()[0]
    assert m == [["a", "b"], ["1", None]]
    w = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (1, 2.0, 3.0, 0.1, 1.1), (1, 0.0, 1.0, 5.0, 6.0)], "p int, x0 double, x1 double, y0 double, y1 double")
    assert sorted(r["line_no"] for r in T.physical_lines(w, ["p"]).collect()) == [0, 0, 1]
    assert T.column_bounds(w, ["p"], 0.5).first()["bounds"] == [1.5]
    f = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "c")], "t int, o int, v string")
    assert [r["v"] for r in T.fill_down(f, ["t"], ["v"], "o").orderBy("o").collect()] == ["a", "a", "c"]


def test_retrieval(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "a a"), (2, "zzz")], "query_id int, query string")
    got = Q.bm25(d, q).collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 1)] and got[0]["score"] > 0
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(Q.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, -1.0]


def test_statistics(spark):
    w = spark.range(1).select(S.wilson(F.lit(0), F.lit(0)).alias("z"), S.wilson(F.lit(8), F.lit(10)).alias("w"), S.zero_failure_bound(F.lit(59)).alias("b")).first()
    assert tuple(w["z"]) == (0.0, 1.0) and abs(w["w"]["low"] - 0.4901625) < 1e-6 and abs(w["b"] - 0.0495) < 1e-3
    r = spark.createDataFrame([("m", i, i != 0) for i in range(70)] + [("u", 1, True)], "metric string, unit_id int, passed boolean")
    specs = spark.createDataFrame([("m", 0.9), ("u", 0.9), ("none", 0.5)], "metric string, threshold double")
    assert {x["metric"]: x["state"] for x in S.evaluate_metrics(r, specs).collect()} == {"m": "PASS", "u": "UNDERPOWERED", "none": "NOT_RUN"}
    c = spark.createDataFrame([("a", 50), ("b", 30), ("c", 2)], "s string, n int")
    assert sum(x["quota"] for x in S.allocate(c, "s", "n", 20, 3).collect()) == 20
    e = spark.createDataFrame([("a b c", "a x c"), ("", "a")], "r string, h string").select(S.word_error_rate(F.col("r"), F.col("h"))).collect()
    assert [round(x[0], 3) for x in e] == [0.333, 1.0]
    p = spark.createDataFrame([([], []), ([], [1]), ([1], []), ([1, 2], [2, 3])], "p array<int>, e array<int>").select(S.precision_recall_f1(F.col("p"), F.col("e"))).collect()
    assert [tuple(x[0]) for x in p] == [(1, 1, 1), (1, 0, 0), (0, 1, 0), (0.5, 0.5, 0.5)]


def test_two_pass_matching(spark):
    g = spark.createDataFrame([(1, "s", "t"), (2, "s", "u")], "g int, src string, tgt string")
    p = spark.createDataFrame([(7, "s", "u"), (8, "s", "x")], "p int, src string, tgt string")
    assert rows(S.greedy_rank_match(g, p, [["src", "tgt"], ["src"]], "g", "p")) == [(1, 8, 2), (2, 7, 1)]


def test_deliveries_and_limits(spark):
    e = spark.createDataFrame([("r", i, n) for i, n in enumerate([1, 1, 3, 2, 1, 3, None])], "run string, arrival int, n long")
    got = [r["delivery"] for r in E.classify_deliveries(e, ["run"], "arrival", "n").orderBy("arrival").collect()]
    assert got == ["ACCEPTED", "DUPLICATE", "GAP", "ACCEPTED", "OUT_OF_ORDER", "ACCEPTED", "OUT_OF_ORDER"]
    h = spark.createDataFrame([("k", float(t)) for t in (0, 1, 2, 11, 12)], "k string, t double")
    assert [r["allowed"] for r in E.sliding_limit(h, "k", "t", 2, 10).orderBy("t").collect()] == [True, True, False, True, True]


def test_audit_chain(spark):
    a = spark.createDataFrame([("r", 1, "x"), ("r", 2, "y")], "run string, o int, p string")
    c = E.write_chain(a, ["run"], ["o"], "p")
    assert E.verify_chain(c, ["run"], ["o"], "digest", "previous").count() == 0
    assert E.verify_chain(c.withColumn("digest", F.lit("z")), ["run"], ["o"], "digest", "previous").count() == 1


def test_idempotence(spark):
    t = spark.createDataFrame([("a", "1")], "k string, d string")
    n = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "k string, d string")
    fresh, known, conflicts = R.idempotent_insert(t, n, ["k"], "d")
    assert rows(fresh) == [("b", "1")] and rows(known) == [("a", "1")] and rows(conflicts) == [("a", "2")]
    assert rows(R.keep_latest_upsert(spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 1), ("b", 0)], "k string, v int"), ["k"], "v")) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize("parts", [1, 3])
def test_duplicates_do_not_depend_on_partitions(spark, parts):
    d = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "z"), (4, None), (5, None)], "i int, t string").repartition(parts)
    assert rows(D.exact_duplicates(d, "i", F.col("t"))) == [(2, 1)]  # null texts are no copies
