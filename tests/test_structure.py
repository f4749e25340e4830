"""Outlines, repaired trees, frames of clauses and periods against plain readings and a sheet made by hand."""

import random

from pyspark.sql import functions as F

from folioforge.operators import frames as FR
from folioforge.operators import structure as S
from folioforge.plans import catalog, structure


def test_outlines_against_a_plain_stack(spark):
    random.seed(7)
    rows, want = [], []
    for doc in range(1000):
        stack = []
        for at in range(random.randrange(1, 30)):
            level = random.choice([None, 1, 1, 2, 2, 3, 4, 6])
            if level is not None:
                while stack and stack[-1][1] >= level:
                    stack.pop()
            parent = stack[-1][0] if stack else None
            want.append((doc, at, parent, len(stack) + (level is not None), level is not None and level > (stack[-1][1] if stack else 0) + 1))
            if level is not None:
                stack.append((at, level))
            rows.append((doc, at, level))
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc long, at long, level int")
    assert sorted(((r["doc"], r["at"], r["parent"], r["depth"], r["skipped"]) for r in S.outline(df, ["doc"], "at", "level").collect()), key=repr) == sorted(want, key=repr)
    assert S.outline(df.limit(0), ["doc"], "at", "level").count() == 0


HEADING = {"Điều 1. Giá": "ARTICLE", "Phụ lục 2 - Bảng giá": "ANNEX", "Chương 3": "SECTION", "Khoản a": "SUBCLAUSE", "Mục 4: Phạt": "SECTION"}
OPENS = {"Phụ lục 2 quy định giá": "ANNEX"} | HEADING


def plain_repair(nodes):
    """The same by one walk over each file's nodes."""
    out, files = [], {}
    for n in nodes:
        files.setdefault(n["file"], []).append(n)
    for f, own in files.items():
        own.sort(key=lambda n: (n["page"], n["ord"], n["node_id"]))
        roots = [n["node_id"] for n in own if n["type"] == "SECTION" and n["parent_id"] is None]
        single, first = len(roots) <= 1, roots[0] if roots else f"root:{f}"
        good = {n["node_id"] for n in own if n["type"] == "SECTION" and (n["node_id"] in roots or n["label"] in HEADING)}
        ids = {n["node_id"] for n in own}
        section, clause, scopes = first if single else None, None, {first: first}
        if not roots:
            out.append((f, first, "SECTION", "DOCUMENT", None, first, True, True, "STRUCTURE_ROOT_DERIVED"))
        for n in own:
            i, kind, level, issue = n["node_id"], n["type"], OPENS.get(n["label"], n["type"] if n["type"] in ("TABLE", "FIELD") else "BLOCK"), None
            if i in roots:
                parent, scope, level = None, i, "DOCUMENT"
                section = i if single else section
            elif n["type"] == "SECTION" and i not in good:
                parent, kind, level, issue = clause or section or first, "UNNUMBERED_BLOCK", "BLOCK", "AMBIGUOUS_HEADING_AS_BLOCK"
                scope = scopes.get(parent, parent)
            elif n["type"] == "SECTION":
                parent, scope = (first if single or n["parent_id"] not in good else n["parent_id"]), i
                section, clause = i, None
            elif n["type"] == "CLAUSE":
                parent = section or first
                scope, clause, level = scopes.get(parent, parent), i, "ARTICLE" if level == "BLOCK" else level
            else:
                document = n["type"] == "FIELD" and n["structured_key"] == "party_a"
                parent = n["parent_id"] if n["parent_id"] in ids and n["parent_id"] not in roots else (section or first) if document else (clause or section or first)
                scope = scopes.get(parent, parent)
            scopes[i] = scope
            out.append((f, i, kind, level, parent, scope, issue is not None or parent != n["parent_id"], False, issue))
    return sorted(out, key=repr)


def test_repair_of_whole_conversations(spark, sf):
    nodes = [r.asDict() for r in structure._nodes(spark, sf).collect()]
    got = sorted((tuple(r) for r in catalog.QUERIES["repaired_structure"](spark, sf).collect()), key=repr)
    assert got == plain_repair(nodes) and {r[8] for r in got} == {None, "AMBIGUOUS_HEADING_AS_BLOCK", "STRUCTURE_ROOT_DERIVED"}


def test_repair_by_hand(spark):
    """A flat file gets a root and clauses; a sentence about an annex stays content of its clause; parties belong to the document."""
    n = [("f", "c1", "CLAUSE", "Điều 1. Giá", None, 1, 1, None), ("f", "b1", "BLOCK", "x", None, 1, 2, None), ("f", "s1", "SECTION", "Phụ lục 2 quy định giá", "gone", 1, 3, None), ("f", "p", "FIELD", "Bên A", None, 1, 4, "party_a"), ("f", "a", "SECTION", "Phụ lục 1", "gone", 2, 1, None), ("f", "b2", "BLOCK", "y", "gone", 2, 2, None), ("f", "b3", "BLOCK", "z", "b1", 2, 3, None)]
    nodes = spark.createDataFrame(n, "file string, node_id string, type string, label string, parent_id string, page int, ord int, structured_key string")
    got = {r["node_id"]: (r["type"], r["level"], r["parent_id"], r["scope_id"], r["issue"]) for r in S.repaired(nodes, spark.createDataFrame([("f", "body")], "file string, role string")).collect()}
    assert got == {
        "root:f": ("SECTION", "DOCUMENT", None, "root:f", "STRUCTURE_ROOT_DERIVED"), "c1": ("CLAUSE", "ARTICLE", "root:f", "root:f", None), "b1": ("BLOCK", "BLOCK", "c1", "root:f", None), "s1": ("UNNUMBERED_BLOCK", "BLOCK", "c1", "root:f", "AMBIGUOUS_HEADING_AS_BLOCK"),
        "p": ("FIELD", "FIELD", "root:f", "root:f", None), "a": ("SECTION", "ANNEX", "root:f", "a", None), "b2": ("BLOCK", "BLOCK", "a", "a", None), "b3": ("BLOCK", "BLOCK", "b1", "root:f", None),
    }


# Sentences and what their only frame says; slots that aren't named are not grounded.
SHEET = [
    ("Bên B phải thanh toán 30% giá trị trong vòng 07 ngày làm việc kể từ ngày ký.", "OBLIGATION", {"actor": "B", "modality_negation": "REQUIRED", "action": "PAY", "object_scope": "giá trị", "amount": "30", "unit": "percent", "deadline": "07", "deadline_unit": "business-day", "temporal_trigger": "SIGNING"}, {"beneficiary", "currency", "condition", "exception"}),
    ("Bên B không được thanh toán cho bên A.", "PROHIBITION", {"actor": "B", "modality_negation": "PROHIBITED", "action": "PAY", "object_scope": "cho bên A"}, {"beneficiary", "amount", "unit", "deadline", "deadline_unit", "condition", "exception"}),
    ("Bên A được phép chấm dứt hợp đồng nếu bên B chậm, trừ khi có thỏa thuận", "RIGHT", {"actor": "A", "modality_negation": "PERMITTED", "action": "TERMINATE", "condition": "bên B chậm", "exception": "có thỏa thuận"}, {"beneficiary", "amount", "unit", "deadline", "deadline_unit"}),
    ("Bên B được thanh toán.", "OBLIGATION", {"beneficiary": "B", "action": "PAY"}, {"amount", "unit", "deadline", "deadline_unit", "condition", "exception"}),
    ("Bên B phải thanh toán 1.500.000,50 đồng theo khoản 2 Điều 5", "OBLIGATION", {"actor": "B", "modality_negation": "REQUIRED", "action": "PAY", "amount": "1500000.5", "currency": "VND", "unit": "money"}, {"beneficiary", "deadline", "deadline_unit", "condition", "exception"}),
    ("Hai bên nghiệm thu công trình sau khi giao hàng", "OBLIGATION", {"actor": "A"}, set()),
    ("Bên A bồi thường 500 USD nếu vi phạm nghĩa vụ", "REMEDY", {"actor": "A", "modality_negation": "REQUIRED", "action": "COMPENSATE", "qualifier": "BREACH", "amount": "500", "currency": "USD", "unit": "money", "condition": "vi phạm nghĩa vụ"}, {"beneficiary", "deadline", "deadline_unit", "exception"}),
    ("Bên A thanh toán theo khoản 2 Điều 5", "OBLIGATION", {"actor": "A", "modality_negation": "REQUIRED", "action": "PAY"}, {"beneficiary", "deadline", "deadline_unit", "condition", "exception"}),
    ("Nếu Bên A thanh toán chậm, phạt", "OBLIGATION", {"actor": "A", "action": "PAY", "object_scope": "chậm", "condition": "Bên A thanh toán chậm"}, {"beneficiary", "amount", "unit", "deadline", "deadline_unit", "exception"}),
    ("“Hàng hóa” nghĩa là thiết bị nêu tại Phụ lục", "DEFINITION", {"parameter": "Hàng hóa", "definition": "thiết bị nêu tại Phụ lục"}, {"amount", "unit", "deadline", "deadline_unit", "condition", "exception"}),
    ("Đơn giá: 12.000 VND", "PARAMETER", {"parameter": "unit_price", "amount": "12", "currency": "VND", "unit": "money"}, {"deadline", "deadline_unit", "condition", "exception"}),
    ("Tổng cộng 1.200.000", "PARAMETER", {"parameter": "total_price", "amount": "1200000", "unit": "money"}, {"deadline", "deadline_unit", "condition", "exception"}),
    ("Bên B thực hiện công việc khác.", "OBLIGATION", {"actor": "B"}, {"beneficiary", "amount", "unit", "deadline", "deadline_unit", "condition", "exception"}),
    ("Bên A giao hàng kể từ ngày kết thúc tháng.", "OBLIGATION", {"actor": "A", "modality_negation": "REQUIRED", "action": "DELIVER", "object_scope": "kể từ ngày kết thúc tháng", "temporal_trigger": "AFTER:kết thúc tháng"}, {"beneficiary", "amount", "unit", "deadline", "deadline_unit", "condition", "exception"}),
]


def test_slots_of_a_sheet(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SHEET)], "id int, text string")
    got = {}
    for r in FR.extract_frames(df, ["id"], {"^đơn giá": "unit_price"}).collect():
        got.setdefault(r["id"], []).append(r)
    for i, (text, family, grounded, absent) in enumerate(SHEET):
        frames = got[i]
        if i == 5:  # delivery is an action of this clause, so acceptance isn't looked for
            assert [f["slots"]["action"]["value"] for f in frames] == ["DELIVER"]
            continue
        assert len(frames) == 1, text
        r = frames[0]
        assert r["family"] == family, text
        assert {k: v["value"] for k, v in r["slots"].items() if v["state"] == "GROUNDED"} == grounded, text
        assert {k for k, v in r["slots"].items() if v["state"] == "ABSENT"} == absent, text
    late = {i: [k for k, v in got[i][0]["slots"].items() if v["reason"] == "deferred_by_reference"] for i in (4, 7)}
    assert late == {4: [], 7: ["amount", "unit"]}


def test_clauses_with_several_actions(spark):
    df = spark.createDataFrame([(1, "Bên A phải giao hàng và bên B phải thanh toán 5 USD; ; Hai bên phải nghiệm thu máy."), (2, None), (3, "")], "id int, text string")
    got = FR.extract_frames(df, ["id"], {}).orderBy("at", "start").collect()
    assert [(r["id"], r["at"], r["slots"]["action"]["value"], r["slots"]["actor"]["value"], r["slots"]["amount"]["state"]) for r in got] == [(1, 0, "DELIVER", "A", "UNKNOWN"), (1, 0, "PAY", None, "UNKNOWN"), (1, 2, "ACCEPT", "BOTH", "ABSENT")]
    assert ("unresolved_slot:actor",) in [tuple(r) for r in FR.review_reasons(FR.extract_frames(df, ["id"], {}), []).collect()]


def test_amounts(spark):
    cases = {"1.234,5": "1234.5", "1,234.50": "1234.5", "1,234": "1234", "1,5": "1.5", "1.234": "1.234", "1.234.567": "1234567", "12 000": "12000", "1.2.3,": None, "": None, "x": None, "100": "100"}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(FR.decimal_amount(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == list(cases.values())


def test_coverage_by_hand(spark):
    p = spark.createDataFrame([("a", 1, 5), ("a", 3, 8), ("a", 8, 9), ("a", 12, None), ("a", 4, 4), ("a", 9, 2), ("a", None, 3), ("b", 1, 2), ("b", 2, 3)], "k string, s int, e int")
    assert sorted((tuple(r) for r in FR.coverage(p, ["k"], "s", "e").collect()), key=repr) == sorted([("a", 1, 3, 1), ("a", 3, 5, 2), ("a", 5, 9, 1), ("a", 9, 12, 0), ("a", 12, None, 1), ("b", 1, 3, 1)], key=repr)
    assert [tuple(r) for r in FR.gaps(p, ["k"], "s", "e").collect()] == [("a", 9, 12)] and FR.coverage(p.limit(0), ["k"], "s", "e").count() == 0
