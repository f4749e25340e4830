"""Bounded tables, marks of aligned letters against a plain table of edits, and the losses of a trial by hand."""

import random
import unicodedata

from pyspark.sql import functions as F

from folioforge.functions.sequence import edit_matches, mark_errors
from folioforge.operators import stats as S
from folioforge.operators import tables as T
from folioforge.operators import trials as TR


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def cost_of(a, b, matches):
    """What the alignment costs: between matches, the longer side's length."""
    cost, i, j = 0, 0, 0
    for p, q in [*matches, (len(a), len(b))]:
        cost += max(p - i, q - j)
        i, j = p + 1, q + 1
    return cost


def test_alignments_cost_the_least():
    rng = random.Random(5)
    for _ in range(500):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 25)))
        b = "".join(c for c in a if rng.random() < 0.8) if rng.random() < 0.5 else "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 25)))
        got = edit_matches(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert cost_of(a, b, got) == plain_distance(a, b), (a, b)
    long = "năm mươi triệu đồng " * 5000
    assert len(edit_matches(long, long.replace("triệu", "triêu", 3))) == len(long) - 3


def test_mark_errors(spark):
    assert mark_errors("đồng ý", "dong y") == (3, 5) and mark_errors("", "") == (0, 0) and mark_errors("12", "12") == (0, 0)
    assert mark_errors("giá", unicodedata.normalize("NFD", "giá")) == (0, 3) and mark_errors("giá trị", "gia tr") == (1, 5)
    rows = [(1, "điều khoản", "dieu khoản"), (2, None, "a"), (3, "7", "7"), (4, None, None)]
    got = {r["id"]: (r["marks"]["errors"], r["marks"]["letters"], r["marks"]["rate"]) for r in S.mark_error_rates(spark.createDataFrame(rows, "id int, a string, b string"), "a", "b").collect()}
    assert got == {1: (2, 9, 2 / 9), 2: (0, 0, None), 3: (0, 0, None), 4: (0, 0, None)}


def test_bounded_tables(spark):
    tables = [("a", ["Đợt", "Thanh toán"], 3, 2), ("b", ["Payment"], 5, 1), ("c", ["Other", None], 1, 2), ("d", ["MILESTONE", None], 2, 2), ("e", ["payment"], 2, 0), ("f", ["payment"], None, None), ("g", ["payment"], 2, 1), ("h", ["payment", "x"], 3, 2), ("i", None, 1, 1)]
    rows = [("a", i, ["x", "y", "beyond"], ["p1", None, "far"]) for i in range(3)] + [("b", i, [str(i)], [f"p{i}"]) for i in range(5)] + [("c", 0, ["x"], None), ("e", 0, ["x"], None), ("g", 1, ["late"], None)]
    rows += [("d", 0, ["1", None], ["p1", ""]), ("d", 1, ["2"], None), ("h", 0, ["1", "2"], ["p1", "p2"]), ("h", 1, ["3", "4"], ["p2", "p3"]), ("h", 2, ["5", "6"], ["p1", "p1"])]
    t = spark.createDataFrame(tables, "table_id string, header array<string>, n_rows int, n_cols int")
    r = spark.createDataFrame(rows, "table_id string, row_index int, cells array<string>, pages array<string>")
    run = lambda *caps: {x["table_id"]: (x["processed_rows"], x["source_cells"], x["processed_cells"], x["reason"], x["complete"]) for x in T.bounded_tables(t, r, T.PAYMENT_HEADERS, *caps).collect()}
    cap, page = "row or cell cap reached", "page cap reached"
    assert run() == {"a": (3, 6, 6, None, True), "b": (5, 5, 5, None, True), "d": (2, 4, 3, None, True), "e": (0, 0, 0, cap, False), "f": (0, 0, 0, None, True), "g": (1, 2, 1, None, False), "h": (3, 6, 6, None, True)}
    got = run(4, 5, 2)
    assert got["a"] == (2, 6, 4, cap, False) and got["b"] == (2, 5, 2, page, False) and got["h"] == (2 - 1, 6, 2, page, False)
    body = T.bounded_tables(t, r).where("table_id = 'a'").collect()[0]["rows"]
    assert [(x["row_index"], x["cells"], x["pages"]) for x in body] == [(i, ["x", "y"], ["p1", None]) for i in range(3)]
    assert T.bounded_tables(t.limit(0), r).count() == 0 and T.bounded_tables(t, r.limit(0)).where("processed_rows > 0").count() == 0


def test_losses_of_a_trial(spark):
    df = spark.createDataFrame
    pairs = "trial string, pair_id string, doc_id string, label string, direction string"
    g = [("t", p, d, lab, way) for p, d, lab, way in [
        ("p1", "d1", "CONFLICT", None), ("p2", "d1", "CONFLICT", None), ("p3", "d1", "REFERENCE", "A_TO_B"), ("p4", "d1", "CONFLICT", "A_TO_B"), ("p5", "d2", "DUPLICATE", None), ("p6", "d3", "DUPLICATE", None),
        ("p7", "d3", "REFERENCE", None), ("p8", "d3", "UNRELATED", None), ("p9", "d3", "DUPLICATE", None), (None, "d3", "CONFLICT", None)]]
    gold = df([*g, ("u", "p1", "d9", "CONFLICT", None), ("v", "p1", "d9", "CONFLICT", None), ("w", "p1", None, "CONFLICT", None)], pairs)
    cand = df([("t", f"p{i}", "d") for i in range(2, 9)] + [(t, "p1", "d9") for t in "uvw"], "trial string, pair_id string, doc_id string")
    pred = df([("t", "p2", 2, "CONFLICT", None), ("t", "p2", 1, "DUPLICATE", None), ("t", "p3", 1, "REFERENCE", "B_TO_A"), ("t", "p4", 1, "CONFLICT", "B_TO_A"), ("t", "p7", 1, "REFERENCE", "B_TO_A"), ("t", "p8", 1, "DUPLICATE", None), ("t", "zz", 1, "CONFLICT", None)], "trial string, pair_id string, place int, label string, direction string")
    ev = df([("t", "p5", 1, "render", "accepted"), ("t", "p5", 3, None, "abstained"), ("t", "p5", 4, "classifier", "accepted"), ("t", "p6", 1, None, "unheard")], "trial string, pair_id string, place int, phase string, outcome string")
    traces = df([("t", "d3", True), ("t", "d1", False), ("t", "", True)], "trial string, doc_id string, failed boolean")
    trials = df([("t", False, {"unrelated": 9}), ("u", True, {"malformed": 2}), ("v", True, {"late": 3}), ("w", None, None)], "trial string, over_budget boolean, rejected map<string,int>")
    got = {(r["trial"], r["pair_id"]): (r["failure_class"], r["evidence_scope"]) for r in TR.diagnose(gold, cand, pred, ev, traces, trials).collect()}
    assert got == {
        ("t", "p1"): ("candidate_miss", "pair"), ("t", "p2"): ("classifier_wrong_label", "pair"), ("t", "p3"): ("classifier_wrong_direction", "pair"), ("t", "p4"): ("correct", "pair"), ("t", "p5"): ("classifier_abstained", "pair"),
        ("t", "p6"): ("unclassified_or_provider", "provider_or_budget"), ("t", "p7"): ("correct", "pair"), ("t", "p9"): ("candidate_miss", "pair"), ("u", "p1"): ("validation_reject", "aggregate_rejection"),
        ("v", "p1"): ("unclassified_or_provider", "provider_or_budget"), ("w", "p1"): ("unclassified_or_provider", "unclassified"),
    }
    a = {r["trial"]: r for r in TR.accounts(gold, cand, pred, ev, trials).collect()}
    assert (a["t"]["candidate_total"], a["t"]["predicted_in_candidates"], a["t"]["unknown_predictions"], a["t"]["residual"]) == (7, 5, 1, 7 - 5 - 9)
    assert a["t"]["hard_stops"] == ["candidate_accounting_mismatch", "duplicate_pair_event_id", "duplicate_prediction_id", "false_duplicate"] and a["w"]["hard_stops"] == []
    assert (a["t"]["false_duplicates"], a["t"]["unreviewed_duplicates"], a["t"]["terminal_events"], a["t"]["terminal_missing"]) == (1, 1, 1, 6)
    empty = TR.accounts(gold.limit(0), cand.limit(0), pred.limit(0), ev.limit(0), trials)
    assert empty.count() == 4 and empty.agg(F.sum("candidate_total")).first()[0] == 0


def test_verdicts(spark):
    kinds = "variant string, trial int, label string, passed long, denominator long, weighted double, cluster_lower double, false_duplicates long, over_budget boolean"
    full = lambda v, k=199, n=200, w=0.5, c=0.95, dup=0, budget=False, labels=TR.SCORED: [(v, 1, x, k, n, w, c, dup, budget) for x in labels]
    run = lambda rows: {r["variant"]: r["verdict"] for r in TR.verdicts(spark.createDataFrame(rows, kinds)).collect()}
    rows = full("good") + full("dup", dup=1) + full("few", n=20, k=20) + full("missing", labels=TR.SCORED[:3]) + full("low", k=120) + full("differs", k=120, w=0.95) + full("loose", c=0.2)
    assert run(rows) == {"good": "ENABLE_CANDIDATE", "dup": "KEEP_OFF_FALSE_DUPLICATE", "few": "KEEP_OFF_INSUFFICIENT_N", "missing": "KEEP_OFF_INSUFFICIENT_N", "low": "KEEP_OFF_BELOW_THRESHOLD", "differs": "HUMAN_DECISION", "loose": "HUMAN_DECISION"}
    assert run(full("good") + full("slow", budget=True)) == {"good": "HUMAN_DECISION", "slow": "HUMAN_DECISION"}
    assert TR.verdicts(spark.createDataFrame(full("x"), kinds)).first()["worst"] == "CONFLICT"
