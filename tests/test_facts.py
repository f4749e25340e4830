from pyspark.sql import functions as F

from folioforge.operators import facts as X


def test_facts(spark):
    n = spark.createDataFrame([("d", 1, "Giá 1.500.000 đồng đã gồm VAT, phạt 8%, ngày 05/03/2024, MST: 0101234567"), ("d", 2, None)], "d string, node_id int, text string")
    got = {r["kind"]: (r["normalized_value"], r["unit"], r["tax_basis"]) for r in X.extract_facts(n, ["d"]).collect()}
    assert got == {"MONEY": ("1500000", "VND", "incl_vat"), "PERCENT": ("8", "percent", None), "DATE": ("2024-03-05", None, None), "TAX_CODE": ("0101234567", None, None)}
    v = spark.createDataFrame([("Tổng giá trị hợp đồng: 2.000.000",), ("Giá trị hợp đồng là hai tỷ",), ("x",)], "t string")
    assert [r[0] for r in v.select(X.contract_value(F.col("t"))).collect()] == ["2000000", "2000000000", None]


def test_events_and_pairs(spark):
    n = spark.createDataFrame([("d", 1, 1, "CLAUSE", "CONFIRMED", "Article 1", "Payment"), ("d", 2, 2, "FIELD", "CONFIRMED", "x", "thanh toán"), ("d", 3, 3, "CLAUSE", "DRAFT", "Điều 1", "Thanh toán và bảo hành")], "d string, node_id int, ord int, node_type string, status string, label string, text string")
    got = X.contract_events(n, {"PAY": ["thanh toan"], "WARRANTY": ["bao hanh"]}, ["d"], "ord")
    assert sorted((r["node_id"], r["event_type"], r["state"]) for r in got.collect()) == [(3, "PAY", "NEEDS_REVIEW"), (3, "WARRANTY", "NEEDS_REVIEW")]
    assert [r["number"] for r in X.bilingual_pairs(n, ["d"], "ord").collect()] == ["1"]


def test_windows_and_hierarchy(spark):
    d = spark.createDataFrame([(1, "a" * 900 + "\n" + "b" * 1500), (2, ""), (3, None), (4, "short")], "k int, text string")
    got = sorted((r["k"], r["start"], r["end"]) for r in X.seeking_windows(d, "k").collect())
    assert got[0] == (1, 0, 901) and got[1][1] == 701 and got[-1] == (4, 0, 5)
    h = spark.createDataFrame([(1, 1, "Điều 1", ""), (1, 2, "1.1. a", ""), (1, 3, "text", ""), (1, 4, "Điều 2", ""), (1, 5, "text", "")], "f int, o int, label string, node_type string")
    assert [r["parent_ord"] for r in X.hierarchy(h, ["f"], "o").orderBy("o").collect()] == [None, 1, 2, None, 4]
    b = spark.createDataFrame([("một hợp-", "đồng"), ("dài", "tiếp"), ("hết.", "Mới"), ("a", "Điều 2. b")], "a string, b string")
    assert [r[0] for r in b.select(X.boundary_action(F.col("a"), F.col("b"))).collect()] == ["MERGE_HYPHEN", "MERGE", "NEW_PARAGRAPH", "NEW_HEADING"]


def test_page_wraps(spark):
    rows = [(1, 1, 1, "Công ty ABC trang 1"), (1, 1, 2, "một câu rất dài " * 5), (1, 1, 3, "1/2"), (1, 2, 1, "Công ty ABC trang 2"), (1, 2, 2, "tiếp tục câu ấy.")]
    got = X.page_wraps(spark.createDataFrame(rows, "f int, p int, o int, t string"), ["f"], "p", "o", "t").collect()
    assert [(r["p"], r["next_line"]) for r in got] == [(1, "tiếp tục câu ấy.")]
