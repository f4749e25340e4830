"""Operators whose inputs the star schema lacks, on hand-made rows."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import numbers as N
from folioforge.operators import compare as C
from folioforge.operators import documents as D
from folioforge.operators import events as E
from folioforge.operators import facts as X
from folioforge.operators import graph as G
from folioforge.operators import retrieval as Q
from folioforge.operators import stats as S
from folioforge.operators import tables as T
from folioforge.sources import readers as R
from folioforge.sources import writers as Wr


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("words, want", [("ba mười", None), ("ba linh hai", None), ("trăm", None), ("mươi", None), ("hai ba", None), ("nghìn", None), ("không", 0), ("mười lăm nghìn", 15000), ("không trăm linh năm", 5), ("hai mươi mốt triệu", 21_000_000)])
def test_number_words_ask_for_their_digits(spark, words, want):
    assert spark.createDataFrame([(words,)], "x string").select(N.vn_words_to_number(F.col("x")).alias("y")).first()["y"] == want


def test_payload_shapes(spark):
    p = lambda *objects: spark.createDataFrame([(json.dumps(o),) for o in objects], "payload string")
    assert rows(R.legacy_pages(p({"document_id": "d", "pages": [{"page": 1, "text": "a"}, {"page": 2, "text": None}]}))) == [("d", 1, "a", "DEGRADED"), ("d", 2, "", "DEGRADED")]
    facts, issues = R.result_facts(p({"result": {"document_id": "d", "facts": [{"fact_id": "f", "key": "k", "raw_value": "1", "page": 3}]}, "issues": [{"code": "C", "message": "m"}]}))
    assert rows(facts, "document_id", "fact_id", "key", "page") == [("d", "f", "k", 3)] and rows(issues) == [("d", "C", "m")]
    nodes = R.ocr_nodes(p({"document_id": "d", "clauses": [{"id": "a", "label": "Điều 1", "text": "x", "page": 1}, {"id": "b", "parent": "a", "label": "1.1. y", "text": "y", "page": 1}]}))
    assert rows(nodes, "ord", "node_id", "parent_id", "level") == [(0, "a", None, "ARTICLE"), (1, "b", "a", "SUBCLAUSE")]
    demo = R.demo_pages(p({"meta": {"document_id": "d"}, "data": [{"page": 1, "content": "abc"}]}))
    assert rows(demo, "page_no", "raw_text_digest") == [(1, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "Phụ lục 1.txt").write_text("x\ny")
    (tmp_path / "t" / "main.txt").write_text("z")
    assert rows(R.read_texts(spark, str(tmp_path / "t")), "text", "role") == [("x\ny", "annex"), ("z", "body")] or rows(R.read_texts(spark, str(tmp_path / "t")), "text") == [("x\ny",), ("z",)]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r><w:r><w:footnoteReference w:id="7"/></w:r></w:p><w:p/></w:body></w:document>')
        z.writestr("word/footnotes.xml", f'<w:footnotes xmlns:w="{w}"><w:footnote w:id="7"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>')
    assert R.docx_text((tmp_path / "a.docx").read_bytes()) == "one two[1]\n[1] note"
    (tmp_path / "m.csv").write_text("id,n\na,1\n")
    assert rows(R.read_manifest(spark, str(tmp_path / "m.csv"), "id string, n int")) == [("a", 1)]
    spark.createDataFrame([("u1", "x"), ("u2", "y")], "url string, text string").write.parquet(str(tmp_path / "cache"))
    got, missing = R.read_frozen_pages(spark, str(tmp_path / "cache"), spark.createDataFrame([("u2",), ("u3",)], "url string"))
    assert rows(got) == [("u2", "y")] and rows(missing) == [("u3",)]
    d = spark.createDataFrame([(1, None, "b")], "i int, n string, s string")
    Wr.write_csv(d, str(tmp_path / "csv"), ["s", "i"])
    Wr.write_json(d, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["s", "i"] and spark.read.json(str(tmp_path / "json")).first()["i"] == 1
    assert d.select(Wr.canonical_json(F.struct("i", "n"))).first()[0] == '{"i":1,"n":null}'
    assert list(spark.range(1).select(Wr.sorted_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))).first()[0]) == ["a", "b"]


def test_sessions_and_snapshots(spark):
    s = spark.createDataFrame([("t", "d", 1, "a"), ("t", "d", 3, "b"), ("t", "e", 9, "c"), ("u", "d", 9, "d")], "tenant_id string, dossier_id string, created_ms long, snapshot_id string")
    assert R.latest_snapshot(s, "t", "d").first()["snapshot_id"] == "b"
    assert R.load_session(spark.createDataFrame([('{"a":1}',)], "x string"), "x", "struct<a:int>").first()["x"]["a"] == 1
    n = spark.createDataFrame([("thân [1]\n[1] ghi chú\n[2] nữa",), ("không",)], "x string").select(R.split_notes(F.col("x")).alias("y"))
    assert [tuple(r["y"]) for r in n.collect()] == [("thân [1]", "[1] ghi chú\n[2] nữa"), ("không", "")]


def test_tables_of_words(spark):
    c = spark.createDataFrame([(1, 0, 0, "STT"), (1, 1, 0, "1"), (1, 2, 0, "2"), (1, 3, 0, "3"), (1, 1, 1, "10"), (1, 2, 1, "40"), (1, 3, 1, "x")], "t int, row_no int, col_no int, cell string")
    assert rows(T.anchor_column(c, ["t"])) == [(1, 0)]
    lines = spark.createDataFrame([(1, 1, "1", "a", 0.0), (1, 2, "", "b", 10.0), (1, 3, "2", "c", 20.0), (1, 4, "", "d", 30.0), (1, 5, "", "e", 60.0)], "t int, o int, anchor string, x string, top double")
    assert rows(T.logical_rows(lines, ["t"], "anchor", "x", "top", "o"), "logical_row", "x", "needs_review") == [(1, "a b", False), (2, "c d", False), (3, "e", True)]
    h = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abxx"), ("", "a")], "a string, b string")
    assert [r["header_similarity"] for r in T.header_similarity(h, "a", "b").collect()] == [100.0, 50.0, 0.0]
    assert [r[0] for r in spark.createDataFrame([(["(VND)", ""],), (["Bơm", "1"],)], "r array<string>").select(T.is_header_continuation(F.col("r"))).collect()] == [True, False]


def test_page_shapes(spark):
    v = spark.createDataFrame([("d", 5, 3), ("d", 6, 4), ("d", 9, 4), ("d", None, 7), ("e", 1, 9)], "d string, printed int, page int")
    assert rows(D.page_number_offset(v, "d", "printed", "page")) == [("d", 2)]
    n = spark.createDataFrame([("f", p, o, t) for p in (1, 2) for o, t in ((1, "Công ty A"), (2, f"dòng {p}"), (3, "1. mục"))] + [("g", 1, 1, "TOP"), ("h", 1, 1, "TOP")], "file_id string, page int, ord int, text string")
    assert rows(D.page_furniture(n), "file_id", "text") == sorted([("f", "Công ty A"), ("f", "Công ty A"), ("g", "TOP"), ("h", "TOP")])
    words = " ".join(f"word{i}" for i in range(30)).replace("0", "o")
    p = spark.createDataFrame([("d", 1, words), ("d", 2, words + "x"), ("d", 3, words.replace("word", "sord")), ("e", 1, words)], "d string, p int, t string")
    assert rows(D.near_duplicate_pages(p, "d", "p", F.col("t"))) == [("d", 2, 1)]
    h = spark.createDataFrame([("a", 1, "Điều 1"), ("a", 2, "Điều 2"), ("b", 2, "dieu  2"), ("b", 1, "ĐIỀU 1"), ("c", 1, "x")], "d string, o int, h string")
    sig = dict(D.heading_signature(h, "d", "o", "h").collect())
    assert sig["a"] == sig["b"] != sig["c"]
    docs = spark.createDataFrame([(1, "one two three four five six", "s1"), (2, "other words that are here alone", "s1"), (3, "ONE two three four five six", "s2"), (4, "", None), (5, None, None)], "doc_id long, text string, sig string")
    assert rows(D.near_duplicate_clusters(docs)) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]
    assert rows(D.near_duplicate_clusters(docs, signature="sig")) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert rows(D.clusters_across_splits(spark.createDataFrame([(1, "dev"), (1, "heldout"), (2, "dev")], "c int, s string"), "c", "s"), "c") == [(1,)]
    t = spark.createDataFrame([("thân\nĐại diện bên A\nký",), ("không có",)], "x string")
    assert [r[0] for r in t.select(D.trim_tail(F.col("x"))).collect()] == ["thân", "không có"]
    a = spark.createDataFrame([(1, 1, "Tổng cộng:"), (1, 2, ""), (1, 3, "1.234.000"), (1, 4, "Total"), (1, 5, "x")], "d int, o int, t string")
    assert rows(D.amount_after_total(a, ["d"], "o", "t"), "o", "amount") == [(1, "1.234.000"), (4, None)]
    pg = spark.createDataFrame([("f", 1, "Hợp đồng"), ("f", 2, "Phụ lục 01\nx"), ("f", 3, "y"), ("f", 4, "PHỤ LỤC 02"), ("f", 5, "z")], "f string, p int, t string")
    assert rows(D.annex_ranges(pg, "f", "p", "t"), "annex", "start_page", "end_page") == [("01", 2, 3), ("02", 4, 5)]
    u = [("HỢP ĐỒNG mua", ""), ("Số: 12/2024", ""), ("Bên A: x", ""), ("Bên B: y", ""), ("nội dung", "")]
    doc = spark.createDataFrame([("f", i, t) for i, (t, _) in enumerate(u + u)], "f string, o int, t string")
    assert [r["unit_no"] for r in D.unit_scopes(doc, "f", "o", "t").orderBy("o").collect()] == [1] * 5 + [2] * 5


def test_pairs_and_candidates(spark):
    f = spark.createDataFrame([("m", 1, "f1", "d1", "m1"), ("m", 2, "f2", "d1", "m2"), ("m", 3, "f3", "d2", "m1"), (None, 4, "f4", "d2", "m1")], "key string, scope int, frame_id string, document_id string, milestone string").withColumn("scope", F.lit(0))
    assert rows(C.same_key_candidates(f, ["scope"]), "node_a", "node_b") == [("f1", "f3"), ("f2", "f3")]
    slot = "map<string,struct<state:string,value:string>>"
    k = spark.createDataFrame([("RIGHT", {"bearer": ("GROUNDED", "A"), "action": ("GROUNDED", "Pay")}), ("RIGHT", {"bearer": ("UNKNOWN", None), "action": ("GROUNDED", "pay")}), ("DEFINITION", {"param": ("GROUNDED", "Hàng")})], f"f string, s {slot}")
    assert [r[0] for r in k.select(C.alignment_key(F.col("f"), F.col("s"))).collect()] == ["MODAL|a|pay", None, "DEFINITION|hàng"]
    q = spark.createDataFrame([([1, 2], [1, 2]), ([1, 2], [2, 1]), ([1, 2], [1, 3]), ([1], [1, 2])], "l array<int>, r array<int>")
    assert [r["positions"] for r in C.quantity_differences(q, "l", "r").collect()] == [[1], None]
    n = spark.createDataFrame([(1, 1, "thời hạn thanh toán tiền hàng là 07 ngày"), (2, 2, "thời hạn thanh toán tiền hàng là 10 ngày"), (3, 3, "thời hạn thanh toán tiền hàng là 07 ngày")], "node_id int, ord int, text string")
    assert rows(C.value_mismatch_pairs(n, "text", "ord")) == [(1, 2), (2, 3)]
    g = C.group_hits(spark.createDataFrame([("e", "01-02", 5, 2), ("e", "0102", 6, 1), ("e", "x", 7, 3)], "k string, raw string, node int, o int"), ["k"], "raw", "node", "o")
    assert rows(g, "canonical", "first_seen") == [("0102", 1), ("x", 3)]
    p = spark.createDataFrame([("i", "annex", str(v), str(v), None) for v in range(4)] + [("i", "body", None, "9", None), ("j", "annex", "1", "1", None)], "item_key string, source_role string, validity string, raw_value string, normalized_value string")
    assert rows(C.pairing_coverage(p, most=3)) == [("i", 4, "PAIRING_COVERAGE_CAPPED")] and C.pairing_coverage(p).count() == 0


def test_graph_plans(spark):
    u = spark.createDataFrame([("d", 1, "Thay thế cụm từ tại khoản 2 Điều 3"), ("d", 2, "Bãi bỏ Điều 5 và Điều 6"), ("d", 3, "nội dung")], "d string, node_id int, text string")
    assert rows(G.plan_edges(u, ["d"]), "node_id", "op", "address") == [(1, "SUBSTITUTION", "khoan 2 dieu 3"), (2, "REPEAL", "dieu 5"), (2, "REPEAL", "dieu 6")] and G.plan_edges(u, ["d"], cap=2).count() == 2
    a = spark.createDataFrame([((None, "2", None, None), (None, None, "3", "1")), ((None, None, "9", None), (None, None, "3", None)), (("a", None, None, None), None)], f"c {G.ADDRESS}, p {G.ADDRESS}")
    assert [r[0] for r in a.select(G.canonical_address(G.inherit_address(F.col("c"), F.col("p")))).collect()] == ["khoan 2 dieu 3 phu luc 1", "dieu 9", "diem a"]
    assert [tuple(x) for x in spark.createDataFrame([("1. Sửa “2. x” đây\na) Bỏ\n",)], "t string").select(G.split_operations(F.col("t"))).first()[0]] == [("1", "Sửa ” đây"), ("a", "Bỏ")]
    e = spark.createDataFrame([("A", "EXACT", True, False, "VALID", "VALID"), ("A", "FUZZY", True, False, "VALID", "VALID"), ("B", "EXACT", True, False, "VALID", "VALID")], "op string, method string, standard boolean, implicit boolean, source_citation string, target_citation string")
    cal = spark.createDataFrame([("A", True, 70, 0.9), ("B", True, 10, 0.9)], "op string, approved boolean, n int, wilson_low double")
    assert [r["review_state"] for r in G.review_state(e, cal, True).orderBy("op", "method").collect()] == ["PASS", "NEEDS_REVIEW", "NEEDS_REVIEW"]
    r = spark.createDataFrame([(1, i, "CONFLICT", "VALID", "VALID", i, 100 + i) for i in range(8)] + [(1, 9, "SAME", "VALID", "VALID", 50, 51)], "d int, o int, label string, citation_a string, citation_b string, node_a int, node_b int")
    assert rows(G.pair_conflicts(r, spark.createDataFrame([(100, 0)], "node_a int, node_b int"), ["d"], "o"), "o") == [(1,), (2,), (3,), (4,), (5,)]
    n = spark.createDataFrame([(0, i, str(i % 3)) for i in range(9)], "s int, node_id int, clause string")
    edges = spark.createDataFrame([(0, 0, 7, "AMENDS"), (0, 8, 0, "SAME_CLAUSE"), (0, 0, 5, "PARENT_OF")], "s int, from_node int, to_node int, type string")
    assert rows(G.related_nodes(spark.createDataFrame([(0, 0)], "s int, node_id int"), n, edges, ["s"]), "node_id") == [(3,), (6,), (7,), (8,)]
    assert G.grounded_span("a  b\nc", "b c") == "b\nc" and G.grounded_span("a", "x") is None
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "n int, p int")
    assert rows(G.ancestors(cycle, [], "n", "p")) == sorted([(a, b, (b - a - 1) % 3 + 1) for a in (1, 2, 3) for b in (1, 2, 3)], key=repr)
    deep = spark.range(200).selectExpr("id AS n", "CASE WHEN id > 0 THEN id - 1 END AS p")
    assert G.ancestors(deep, [], "n", "p").count() == 199 * 200 // 2
    assert G.reachable(deep.where("p IS NOT NULL"), spark.createDataFrame([(12,)], "n long"), "n", "p").count() == 13


def test_events_in_order(spark):
    e = spark.createDataFrame([("r", f"2024-01-01 00:00:0{s}", d, 9) for s, d in ((0, 1), (0, 2), (1, 2), (2, 5), (2, 9))], "run string, ts string, done int, total int")
    assert [r["done"] for r in E.progress_events(e, ["run"], "ts", "done", "total").orderBy("done").collect()] == [1, 2, 5, 9]
    known = spark.createDataFrame([("a", "1")], "k string, d string")
    new, conflicts = E.submit_once(known, spark.createDataFrame([("a", "2"), ("b", "1")], "k string, d string"), "k", "d")
    assert rows(new) == [("b", "1")] and rows(conflicts) == [("a", "2")]
    h = spark.createDataFrame([("k", 1.0, i) for i in (3, 1, 2)] + [("k", None, 4)], "k string, t double, i int").repartition(3)
    assert rows(E.sliding_limit(h, "k", "t", 2, 10, ["i"]), "i", "allowed") == [(1, True), (2, True), (3, False), (4, None)]
    big = spark.createDataFrame([("r", i, i + 1, 2**60 + 1 if i else None) for i in range(3000)], "run string, arrival int, n long, other long")
    got = E.classify_deliveries(big, ["run"], "arrival", "n")
    assert got.where("delivery = 'ACCEPTED'").count() == 3000 and got.where(f"other = {2**60 + 1}").count() == 2999


def test_frames_and_chunks(spark):
    f = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4), ("b", 5)], "doc string, o int")
    assert [r["o"] for r in X.round_robin(f, "doc", "o").orderBy("turn").collect()] == [1, 3, 2, 5, 4]
    n = spark.createDataFrame([("d", 1, "Điều 1 (mới)", "một hai ba bốn"), ("d", 2, "Điều 2", "hai ba bốn năm"), ("e", 3, "mới", "x y z")], "d string, node_id int, label string, text string")
    assert rows(X.reused_phrases(n, ["d"])) == [("d", 1)]
    crumbs = G.breadcrumbs(spark.createDataFrame([("d", 1, None, "A"), ("d", 2, 1, "B")], "d string, node_id int, parent int, label string"), ["d"], "node_id", "parent", "label")
    assert rows(X.clause_chunks(spark.createDataFrame([("d", 2, "t")], "d string, node_id int, text string"), crumbs, ["d"]), "chunk") == [("A > B\nt",)]


def test_search_filters(spark):
    q = spark.createDataFrame([("giá hàng",), ("x",)], "q string")
    assert [r[0] for r in q.select(Q.expand_query(F.col("q"), {"giá": "price", "hàng": "goods"})).collect()] == ["giá hàng price goods", "x"]
    s = spark.createDataFrame([("q", i, i, f"s{i}", "ok" if i != 2 else "old") for i in range(1, 7)], "q string, segment_id int, rank int, n string, stored_text string")
    spans = spark.createDataFrame([(i, "ok") for i in range(1, 7)], "segment_id int, span_text string")
    assert rows(Q.recall_verified(s, spans, ["q"], 1), "segment_id", "rank") == [(1, 1)]
    hits = spark.createDataFrame([("bảo hành 12 tháng",), ("thanh toán, mã số thuế",)], "t string")
    assert rows(Q.filter_topics(hits, F.col("t"), [("WARRANTY", "bao hanh")])) == [("bảo hành 12 tháng",)] and Q.filter_topics(hits, F.col("t"), []).count() == 2
    h = spark.createDataFrame([("q", "SECTION", "1"), ("q", "CLAUSE", "1"), ("q", "CLAUSE", "2")], "q string, kind string, n string")
    assert rows(Q.drop_repeated_headings(h, ["q"], "kind", "n"), "kind", "n") == [("CLAUSE", "2"), ("SECTION", "1")]
    nodes = spark.createDataFrame([("q", i, 1 if i > 1 else None, i) for i in range(1, 5)], "q string, node int, parent int, o int")
    assert rows(Q.children_of_hits(nodes.where("node IN (1, 3)"), nodes, ["q"], "node", "parent", "o"), "node") == [(2,), (4,)]
    fr = spark.createDataFrame([(1, "phạt 8%", "8%", "VALID"), (2, "phạt 8%", "8%", "VALID"), (3, "phạt 9%", "9%", "INVALID")], "o int, evidence string, raw string, citation_status string")
    assert rows(Q.semantic_query(fr, "mức phạt", "o")) == [("8%",)]
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vec_id int, embedding array<double>")
    qs = v.where("vec_id < 9").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    one = rows(Q.vector_top_k(v, qs, 3))
    old, Q.QUERY_ROWS = Q.QUERY_ROWS, 4
    assert rows(Q.vector_top_k(v, qs, 3)) == one
    Q.QUERY_ROWS = old


def test_evaluation_shapes(spark):
    d = spark.createDataFrame([(["Hợp", "đồng", "số", "1"], ["hop", "dong", "so", "7"]), (["a"], ["a"]), ([], ["x"])], "a array<string>, b array<string>")
    assert [[tuple(x) for x in r["disputes"]] for r in S.disputed_spans(d, "a", "b").collect()] == [[(3, 4, ["1"], ["7"])], [], [(0, 0, [], ["x"])]]
    n = spark.createDataFrame([("d", i) for i in (1, 2, 3)], "d string, node int")
    assert rows(S.node_pairs(n, "d", "node", spark.createDataFrame([("d", 2, 1)], "d string, node int, ancestor int")), "node_a", "node_b") == [(1, 3), (2, 3)]
    b = spark.createDataFrame([(1, "r1", "p1", 0.9), (1, "r1", "p2", 0.8), (1, "r2", "p1", 0.85), (1, "r2", "p2", 0.1)], "page int, ref string, pred string, iou double")
    assert rows(S.box_matches(b, ["page"], "ref", "pred", "iou"), "ref", "pred") == [("r1", "p2"), ("r2", "p1")]
    t = spark.createDataFrame([(["a", "b"], "c"), ([], "c"), (None, "d")], "ts array<string>, t string")
    assert [r["slot_target"] for r in S.expand_targets(t, "ts", "t").collect()] == ["a", "b", "c", "d"]
    bare = spark.range(1).select(S.zero_failure_bound(F.lit(0)).alias("none"), S.zero_failure_bound(F.lit(100)).alias("many")).first()
    assert bare["none"] == 1.0 and abs(bare["many"] - (1 - 0.05 ** (1 / 100))) < 1e-12
