"""Page breaks, segments, clauses and tables against cases made by hand and a plain reading in Python."""

import hashlib
import re

from pyspark.sql import functions as F

from folioforge.functions.text import merge_texts
from folioforge.operators import reconstruct as R
from folioforge.plans import catalog, structure

BLOCKS = "doc long, page long, block_no long, type string, text string, y0 double, y1 double, page_height double, font_size double, bold boolean"


def pages(spark, *texts, doc=1, kind="paragraph", **more):
    """A page for each list of texts; a text is a paragraph, or a row of a table if it begins with a bar."""
    rows = []
    for p, own in enumerate(texts, 1):
        for k, t in enumerate(own):
            extra = more.get(f"at{p}_{k}", {})
            rows.append((doc, p, k, extra.get("type", "table_row" if (t or "").startswith("|") else kind), t, extra.get("y0"), extra.get("y1"), extra.get("h"), extra.get("size"), extra.get("bold")))
    return rows if spark is None else R.resolved_pages(spark.createDataFrame(rows, BLOCKS))


def broken(spark, *texts, **more):
    return pages(spark, *texts, **more)[1].orderBy("previous_page").collect()


# Texts of two pages, and what their break is: action, relationship, entity, node and parent.
CASES = [
    ((["Bên A thanh toán trong vòng"], ["ba mươi ngày."]), ("MERGE_BLOCKS", "CONTINUE_PARAGRAPH", "PARAGRAPH", None, None)),
    ((["Điều 5. Giá", "Hết câu."], ["5.1 Đơn giá là"]), ("NEW_CLAUSE", "NEW_CLAUSE", "CLAUSE", "5.1", "5")),
    ((["Hết câu."], ["Điều 6. Phạt"]), ("NEW_SECTION", "NEW_SECTION", "SECTION", "6", None)),
    ((["Điều 5. Giá", "5.2 Giá là"], ["không đổi."]), ("MERGE_BLOCKS", "CONTINUE_CLAUSE", "CLAUSE", "5.2", "5")),
    ((["Điều 5. Giá", "5.2 Gồm:", "(a) máy"], ["(b) bơm"]), ("CONTINUE_LIST", "LIST_CONTINUE", "LIST_ITEM", "5.2.b", "5.2")),
    ((["Điều 5. Giá", "(iii) máy"], ["(iv) bơm"]), ("CONTINUE_LIST", "LIST_CONTINUE", "LIST_ITEM", "5.iv", "5")),
    ((["1) máy"], ["2) bơm"]), ("CONTINUE_LIST", "LIST_CONTINUE", "LIST_ITEM", "2", None)),
    ((["(a) máy"], ["b) bơm"]), ("CONTINUE_LIST", "LIST_CONTINUE", "LIST_ITEM", "b", None)),
    ((["(h) máy"], ["(i) bơm"]), ("ATTACH_CHILD", "NEW_CLAUSE", "LIST_ITEM", "i", None)),
    ((["5.2 Gồm."], ["(a) máy"]), ("ATTACH_CHILD", "NEW_CLAUSE", "LIST_ITEM", "5.2.a", "5.2")),
    ((["Hết câu."], ["Câu mới."]), ("NEW_PARAGRAPH", "NEW_PARAGRAPH", "PARAGRAPH", None, None)),
    ((["Chưa hết..."], ["đoạn sau"]), ("MERGE_BLOCKS", "CONTINUE_PARAGRAPH", "PARAGRAPH", None, None)),
    ((["Hết câu."], ["chữ thường"]), ("NEEDS_REVIEW", "UNKNOWN", None, None, None)),
    ((["chưa hết"], ["Chữ Hoa"]), ("NEEDS_REVIEW", "UNKNOWN", None, None, None)),
    ((["Điều 5. A", "5.1 B.", "Điều 6. C."], ["tiếp"]), ("NEEDS_REVIEW", "UNKNOWN", None, None, None)),
    ((["| STT | Giá |", "| 1 | |"], ["| STT | Giá |", "| | 5 |"]), ("CONTINUE_ROW", "ROW_CONTINUE", "TABLE_ROW", None, None)),
    ((["| STT | Giá |", "| 1 | 2 |"], ["| STT | Giá |", "| 2 | 5 |"]), ("CONTINUE_TABLE", "TABLE_CONTINUE", "TABLE", None, None)),
    ((["| STT | Giá |", "| 1 | 2 |"], ["| 7 | 5 |"]), ("NEEDS_REVIEW", "UNKNOWN", "TABLE", None, None)),
    ((["| a | b |"], ["| a | b | c |"]), ("MERGE_BLOCKS", "CONTINUE_PARAGRAPH", "PARAGRAPH", None, None)),
]


def test_rules_of_a_break(spark):
    rows = [r for k, (texts, _) in enumerate(CASES) for r in pages(None, *texts, doc=k)]
    got = {r["doc"]: r for r in R.resolved_pages(spark.createDataFrame(rows, BLOCKS))[1].collect()}
    for k, (texts, want) in enumerate(CASES):
        r = got[k]
        assert (r["action"], r["relationship"], r["entity_type"], r["node_id"], r["parent_id"]) == want, texts
        assert r["requires_review"] == (want[0] == "NEEDS_REVIEW") and (r["confidence"] >= 0.85) != r["requires_review"]


def test_signals_of_a_break(spark):
    low, high = {"y0": 85.0, "y1": 90.0, "h": 100.0}, {"y0": 15.0, "y1": 20.0, "h": 100.0}
    (r,) = broken(spark, ["trong vòng"], ["ba ngày"], at1_0=low | {"size": 11.0}, at2_0=high | {"size": 11.5})
    assert r["reasons"] == ["NO_END_PUNCTUATION", "BOTTOM_TO_TOP", "SAME_STYLE"]
    (r,) = broken(spark, ["trong vòng"], ["ba ngày"], at1_0={"size": 11.0}, at2_0={"size": 14.0})
    assert (r["action"], r["proposed"], round(r["confidence"], 4)) == ("NEEDS_REVIEW", "CONTINUE_PARAGRAPH", 0.801)
    (r,) = broken(spark, ["trong vòng"], ["ba ngày"], at1_0={"bold": True}, at2_0={"bold": False})
    assert r["action"] == "NEEDS_REVIEW"
    # furniture by type, by repetition at the edges, and blank text stand aside; so do pages of nothing else
    top = {"y0": 1.0, "y1": 5.0, "h": 100.0}
    many = broken(spark, ["Trang 1", "trong vòng", "  "], ["Trang 2", "ba ngày."], ["Trang 3"], ["Trang 4", "Câu mới."], at1_0=top, at2_0=top, at3_0=top, at4_0=top)
    assert [x["action"] for x in many] == ["MERGE_BLOCKS", "NEEDS_REVIEW", "NEEDS_REVIEW"]
    assert broken(spark, ["một trang"]) == [] and R.boundaries(pages(spark, ["x"])[0].limit(0)).count() == 0


def test_a_paragraph_over_four_pages(spark):
    b = pages(spark, ["Đầu.", "Bên A giao hàng-"], ["hóa và dịch"], ["vụ trong "], ["ba ngày. ", "Xong."], [None, "Trang mới."])
    got = R.segments(*b).orderBy("segment_no").collect()
    assert [(r["text"], r["page_start"], r["page_end"], r["was_merged"]) for r in got] == [
        ("Đầu.", 1, 1, False), ("Bên A giao hànghóa và dịch vụ trong ba ngày. ", 1, 4, True), ("Xong.", 4, 4, False), ("Trang mới.", 5, 5, False),
    ]
    whole = got[1]
    assert [whole["text"][s["char_start"] : s["char_end"]] for s in whole["source"]] == ["Bên A giao hàng", "hóa và dịch", "vụ trong ", "ba ngày. "]


def test_hyphens(spark):
    cases = {("nghiên-", "cứu"): "nghiêncứu", ("x-", "cứu"): "x- cứu", ("12-", "cứu"): "12- cứu", ("nghiên-", "Cứu"): "nghiên- Cứu", ("a ", " b"): "a b", ("", "b"): "b", ("a", ""): "a", ("từ­", "ngữ"): "từngữ", (None, "b"): "b"}
    df = spark.createDataFrame([(a, b) for a, b in cases], "a string, b string").select(merge_texts(F.col("a"), F.col("b")).alias("t"))
    assert [r["t"] for r in df.collect()] == list(cases.values())


def test_numbers_that_open_a_block(spark):
    cases = {
        "Điều 1. Giá": ("section", "1", 1, 0), "ARTICLE 12": ("section", "12", 1, 0), "Điều 5a": None, "Khoản 2 nêu": ("khoan_label", "2", 2, 0), "1. Giá": ("decimal", "1", 1, 0), "1.2.3 Giá": ("decimal", "1.2.3", 3, 0), "30 ngày": None, "1.5kg": None,
        "(a) x": ("alpha_paren", "a", None, 1), "(i) x": ("roman_paren", "i", None, 2), "(IV) x": ("roman_paren", "iv", None, 2), "(viii)": ("roman_paren", "viii", None, 2), "(abc) x": ("alpha_paren", "abc", None, 1), "2) x": ("number_paren", "2", None, 1), "b) x": ("alpha_close_paren", "b", None, 1), "(1) x": None, "": None, "  ": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").select(R.numbering(F.col("t")).alias("m")).collect()
    assert [r["m"] and (r["m"]["kind"], r["m"]["value"], r["m"]["level"], r["m"]["tier"]) for r in df] == list(cases.values())


def plain_clauses(found):
    """(node, parent, clause_id, level, texts) by a stack, from (segment_no, text)."""
    nodes, stack = {}, []
    for no, text in found:
        t = text.strip()
        kind = None
        for name, tier, p in (("section", 0, r"(?:Điều|ĐIỀU|Article|ARTICLE|Section|SECTION)\s+(\d+)\b"), ("khoan", 0, r"(?:Khoản|KHOẢN)\s+(\d+)\b"), ("paren", 1, r"\(([A-Za-z]+)\)(?=[\s.,;:)]|$)"), ("decimal", 0, r"(\d+(?:\.\d+)+)(?=[\s.]|$)|(\d+)\.(?=\s|$)"), ("number", 1, r"(\d+)\)(?=\s|$)"), ("letter", 1, r"([A-Za-z])\)(?=\s|$)")):
            if m := re.match(p, t):
                value, kind = next(g for g in m.groups() if g).lower(), name
                break
        if kind is None:
            if stack:
                nodes[stack[-1][0]]["texts"].append(text)
            else:
                nodes[no] = {"parent": None, "id": f"_unnumbered_{len(nodes) + 1}", "level": 1, "texts": [text]}
                stack.append((no, 0, 1))
            continue
        if kind == "paren" and (value in "ivx" if len(value) == 1 else re.fullmatch(r"x{0,3}(ix|iv|v?i{0,3})", value)):
            tier = 2
        stated = {"section": 1, "khoan": 2, "decimal": value.count(".") + 1}.get(kind)
        while stack and ((stack[-1][1] > 0 or stack[-1][2] >= stated) if tier == 0 else stack[-1][1] >= tier):
            stack.pop()
        level = stated if tier == 0 else stack[-1][2] + 1 if stack else tier + 1
        above = stack[-1][0] if stack else None
        nodes[no] = {"parent": above, "id": f"{nodes[above]['id']}.{value}" if tier and above is not None else value, "level": level, "texts": [text]}
        stack.append((no, tier, level))
    return {no: (n["parent"], n["id"], n["level"], hashlib.md5(" ".join(n["texts"]).strip().encode()).hexdigest()) for no, n in nodes.items()}


def test_clauses_of_whole_documents(spark, sf):
    by = {}
    for r in R.segments(*R.resolved_pages(structure._numbered(spark, sf))).orderBy("doc", "segment_no").collect():
        by.setdefault(r["doc"], []).append((r["segment_no"], r["text"]))
    want = {(d, no): v for d, found in by.items() for no, v in plain_clauses(found).items()}
    got = {(r["doc_id"], r["node"]): (r["parent"], r["clause_id"], r["level"], r["text"]) for r in catalog.QUERIES["reconstructed_clauses"](spark, sf).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 100


def test_clauses_by_hand(spark):
    b = pages(spark, ["Lời đầu.", "Điều 5 – Thanh toán.", "5.2 Đợt:", "(a) một;", "(i) nhỏ;", "(ii) nhỏ."], ["(b) hai.", "Thêm.", "5.10 Khác.", "Điều 6"])
    got = R.clauses(R.segments(*b)).orderBy("node").collect()
    assert [(r["clause_id"], r["parent_id"], r["level"], r["title"], r["page_end"]) for r in got] == [
        ("_unnumbered_1", None, 1, None, 1), ("5", None, 1, "Thanh toán.", 1), ("5.2", "5", 2, None, 1), ("5.2.a", "5.2", 3, None, 1), ("5.2.a.i", "5.2.a", 4, None, 1), ("5.2.a.ii", "5.2.a", 4, None, 1),
        ("5.2.b", "5.2", 3, None, 2), ("5.10", "5", 2, None, 2), ("6", None, 1, None, 2),
    ]
    assert got[6]["text"] == "(b) hai. Thêm."


def test_tables_of_whole_customers(spark, sf):
    orders = {}
    for r in spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderkey").collect():
        orders.setdefault(r["o_custkey"], []).append([str(r["o_orderkey"]), "" if r["o_orderkey"] % 3 == 0 else str(r["o_orderdate"])[:10], r["o_orderstatus"]])
    want = []
    for c, rows in orders.items():
        out, last, at = [], None, 0  # last: the row before, if it can still take a half
        while at < len(rows):
            if last is not None and at % 2 == 0 and "" in last[0]:
                a, b = last[0], rows[at]
                out[-1] = ([y if not x else x if not y or x == y else f"{x} {y}" for x, y in zip(a, b, strict=True)], sorted({(at - 1) // 2, at // 2}))
                last = None
            else:
                last = (rows[at], at)
                out.append((rows[at], [at // 2]))
            at += 1
        want += [(c, 1, k, v, p, 0, (len(rows) - 1) // 2) for k, (v, p) in enumerate(out, 1)]
    got = sorted(tuple(r) for r in catalog.QUERIES["reconstructed_tables"](spark, sf).collect())
    assert got == sorted(want) and any(len(r[4]) > 1 for r in want)


def test_tables_by_hand(spark):
    b = pages(spark, ["| a | b |", "| 1 | |", "between", "| x | y | z |", "| 5 | 6 | 7 |"], ["| x | y | z |", "| 8 | | 9 |"], ["| x | y | z |", "| | k | |"], ["| x | y | z |", "| 3 | | |"], ["text"], ["| x | y | z |", "| 4 | 4 | 4 |"])
    got = R.table_rows(*b).orderBy("table_no", "row_no").collect()
    assert [(r["table_no"], r["values"], r["pages"]) for r in got] == [(1, ["1", ""], [1]), (2, ["5", "6", "7"], [1]), (2, ["8", "k", "9"], [2, 3]), (2, ["3", "", ""], [4]), (3, ["4", "4", "4"], [6])]
    assert {r["table_no"]: (r["page_start"], r["page_end"]) for r in got} == {1: (1, 1), 2: (1, 4), 3: (6, 6)}
