"""Comparing facts of two sources, aligning clauses, and blocking candidate pairs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions.numbers import unit_values, values_differ
from folioforge.functions.text import fold

MAX_PAIRS_PER_ITEM, TOP_K, GROUP_WINDOW, POSTING_WINDOW, NEAR_JACCARD = 500, 40, 12, 8, 0.85
# Weights of the blocking sources.
WEIGHTS = {"EXPLICIT_REF": 4, "REFERENCE_CUE": 3, "SAME_KEY": 2, "SAME_ARTICLE": 1, "VALUE_MISMATCH": 3, "STRUCTURED_KEY": 8, "VERBATIM": 4}
# Topics by folded words; the earliest match wins, ties go by this order.
TOPICS = (
    ("FORCE_MAJEURE", "bat kha khang"),
    ("PENALTY", "phat vi pham|phat hop dong|muc phat|tien phat|boi thuong thiet hai"),
    ("PAYMENT", "thanh toan"),
    ("PRICE", "gia ca|don gia|gia tri hop dong|gia hang hoa|gia ban|bang gia"),
    ("DELIVERY", "giao hang|giao nhan|van chuyen|thoi han giao"),
    ("QUALITY", "chat luong|quy cach|tieu chuan ky thuat"),
    ("WARRANTY", "bao hanh"),
    ("TERMINATION", "cham dut|thanh ly hop dong|don phuong|huy bo hop dong"),
    ("TERM", "hieu luc|thoi han hop dong"),
    ("DISPUTE", "tranh chap|toa an|trong tai"),
    ("CONFIDENTIALITY", "bao mat"),
)


def pair_key(a: Column, b: Column) -> Column:
    """The unordered pair as one value."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def both_differ(a: str, b: str) -> Column:
    """Both sides are there and differ."""
    return F.coalesce((F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b)), F.lit(False))


def one_sided(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) != "", F.lit(False)) != F.coalesce(F.col(b) != "", F.lit(False))


def decision(left: str = "l", right: str = "r", amends: Column | None = None) -> Column:
    """The outcome of comparing two facts: an ordered ladder, whose order is its meaning.

    left and right name structs with currency, tax_basis, unit, scope, condition, source_role, validity, period_start,
    money and normalized_value. An amendment doesn't count between annexes. Blank and null are both absent.
    """
    c = lambda f: (f"{left}.{f}", f"{right}.{f}")
    l, r = (lambda f: F.col(f"{left}.{f}")), (lambda f: F.col(f"{right}.{f}"))
    annexes = (l("source_role") == "annex") & (r("source_role") == "annex")
    priced = F.coalesce(l("currency") != "", F.lit(False)) | F.coalesce(r("currency") != "", F.lit(False))
    money_units = F.array_sort(F.array(l("unit"), r("unit"))) == F.array(F.lit("USD"), F.lit("VND"))
    ladder = (
        (both_differ(*c("currency")), "NOT_COMPARABLE"),
        (both_differ(*c("tax_basis")), "NOT_COMPARABLE"),
        (one_sided(*c("tax_basis")) & priced, "NEEDS_EVIDENCE"),
        (both_differ(*c("unit")) & money_units, "NOT_COMPARABLE"),
        (both_differ(*c("scope")), "NOT_COMPARABLE"),
        (both_differ(*c("condition")), "NOT_COMPARABLE"),
        (annexes & both_differ(*c("validity")), "NOT_COMPARABLE"),
        ((amends if amends is not None else F.lit(False)) & ~F.coalesce(annexes, F.lit(False)), "CANDIDATE_AMENDMENT"),
        (one_sided(*c("period_start")), "NEEDS_EVIDENCE"),
        (l("money") == r("money"), "COMPARABLE_MATCH"),
        (l("money") != r("money"), "COMPARABLE_DIFFERENCE"),
        ((l("normalized_value") != "") & (l("normalized_value") == r("normalized_value")), "COMPARABLE_MATCH"),
        ((l("normalized_value") != "") & (r("normalized_value") != ""), "COMPARABLE_DIFFERENCE"),
    )
    out = F
    for test, name in ladder:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise("NEEDS_EVIDENCE")


# The review state that each outcome leads to.
REVIEW_STATES = {"COMPARABLE_MATCH": "PASS", "COMPARABLE_DIFFERENCE": "NEEDS_REVIEW", "CANDIDATE_AMENDMENT": "NEEDS_REVIEW", "NOT_COMPARABLE": "NOT_COMPARABLE", "NEEDS_EVIDENCE": "INSUFFICIENT_EVIDENCE"}


def review_state(disposition: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in REVIEW_STATES.items() for x in kv])[disposition]


def first_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in document order (not just any, as dropDuplicates gives)."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")


def two_source_pairs(facts: DataFrame, items: Sequence[str] = ("item_key",), order: str = "ord", most: int = MAX_PAIRS_PER_ITEM) -> DataFrame:
    """(items, l, r): the body's representative with each distinct annex value, and its first two values; without annexes the body's first two; without a body the first two annexes.

    The representative is a price row if there is one, else the first. Values count by raw or normalised value. At most
    `most` annex pairs of an item, in document order.
    """
    cols = [c for c in facts.columns if c not in items]
    keep = first_per(facts.withColumn("_annex", F.col("source_role") == "annex").withColumn("_val", F.coalesce("normalized_value", "raw_value")).withColumn("_pl", F.when(F.col("_annex"), F.coalesce("validity", F.lit("PL")))), [*items, "_annex", "_pl", "_val"], order)
    row = F.struct(*cols)
    body, annex = keep.where("NOT _annex"), keep.where("_annex")
    rep = body.groupBy(*items).agg(F.min_by(row, F.struct((~F.coalesce(F.col("is_price"), F.lit(False))).cast("int"), order)).alias("l"))
    number = F.row_number().over(W.partitionBy(*items).orderBy("_pl_first", order))
    per_annex = annex.withColumn("_pl_first", F.min(order).over(W.partitionBy(*items, "_pl"))).withColumn("_n", number)
    cross = rep.join(per_annex.where(F.col("_n") <= most).select(*items, row.alias("r")), list(items))

    def first_two(side: DataFrame) -> DataFrame:
        ranked = side.withColumn("_n", F.row_number().over(W.partitionBy(*items).orderBy(order))).where("_n <= 2")
        got = ranked.groupBy(*items).agg(F.max(F.when(F.col("_n") == 1, row)).alias("l"), F.max(F.when(F.col("_n") == 2, row)).alias("r"))
        return got.where("r IS NOT NULL")

    annexes = first_two(first_per(annex, [*items, "_pl"], order)).join(body.select(*items).distinct(), list(items), "left_anti")
    return cross.unionByName(first_two(body)).unionByName(annexes)


def pairing_coverage(facts: DataFrame, items: Sequence[str] = ("item_key",), most: int = MAX_PAIRS_PER_ITEM) -> DataFrame:
    """(items, n_pairs, missing): items of which `two_source_pairs` leaves annex pairs out, told as PAIRING_COVERAGE_CAPPED."""
    value = F.coalesce("normalized_value", "raw_value")
    annex = facts.where("source_role = 'annex'").select(*items, F.coalesce("validity", F.lit("PL")).alias("_pl"), value.alias("_v")).distinct()
    n = annex.groupBy(*items).agg(F.count("*").alias("n_pairs")).where(F.col("n_pairs") > most)
    return n.join(facts.where("source_role <> 'annex'").select(*items).distinct(), list(items), "left_semi").withColumn("missing", F.lit("PAIRING_COVERAGE_CAPPED"))


def missing_relations(pairs: DataFrame, relations: DataFrame, items: Sequence[str], left: str, right: str, order: str) -> DataFrame:
    """The first pair of each item whose nodes no relation joins, in either direction."""
    known = relations.select(pair_key(F.col("node_a"), F.col("node_b")).alias("_k")).distinct()
    return first_per(pairs.withColumn("_k", pair_key(F.col(left), F.col(right))).join(known, "_k", "left_anti").drop("_k"), items, order)


def identity_conflicts(facts: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Pairs of units of one file whose identity is known and differs; a unit with two values is ambiguous and left out."""
    sure = facts.groupBy(*keys, unit).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")
    a, b = sure.alias("a"), sure.alias("b")
    on = (F.col(f"a.{unit}") < F.col(f"b.{unit}")) & (F.col(f"a.{value}") != F.col(f"b.{value}"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{unit}").alias("unit_a"), F.col(f"b.{unit}").alias("unit_b"), F.col(f"a.{value}").alias("value_a"), F.col(f"b.{value}").alias("value_b"))


def installment(before: Column) -> Column:
    """The number of the last "đợt N" before a value."""
    return F.try_element_at(F.regexp_extract_all(fold(before), F.lit(r"\bdot (\d+)"), F.lit(1)), F.lit(-1)).cast("int")


def share_installments(facts: DataFrame, keys: Sequence[str], number: str, value: str) -> DataFrame:
    """A fact without an installment joins the group with its value, else the lowest installment of its keys."""
    known = facts.where(F.col(number).isNotNull())
    same = known.groupBy(*keys, value).agg(F.min(number).alias("_same"))
    lowest = known.groupBy(*keys).agg(F.min(number).alias("_low"))
    got = facts.join(same, [*keys, value], "left").join(lowest, list(keys), "left")
    return got.withColumn(number, F.coalesce(number, "_same", "_low")).drop("_same", "_low")


def missing_annexes(facts: DataFrame, present: DataFrame, text: str, order: str) -> DataFrame:
    """(annex, first citation): annex numbers that facts cite and no annex bears."""
    cited = facts.select(order, F.explode(F.regexp_extract_all(fold(F.col(text)), F.lit(r"\bphu luc (?:so )?(\d+)"), F.lit(1))).alias("annex")).withColumn("annex", F.col("annex").cast("int"))
    return cited.groupBy("annex").agg(F.min(order).alias("first_cited")).join(present.select(F.col("annex").cast("int").alias("annex")).distinct(), "annex", "left_anti")


def annex_keys(labels: Column) -> Column:
    """Sorted distinct numbers of annex labels."""
    numbers = F.transform(labels, lambda x: F.regexp_extract(fold(x), r"^phu luc (?:so )?(\d+)", 1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(numbers, lambda n: n != ""), lambda n: n.cast("int"))))


def explicit_amendment(text: Column, target_number: Column) -> Column:
    """Whether a text changes the clause of that number and doesn't deny it."""
    t = fold(text)
    hit = F.regexp_like(t, F.concat(F.lit(r"(sua|thay the|dieu chinh|amend)[^.;]{0,60}\b(dieu|khoan|muc|article|clause) "), F.regexp_replace(target_number, r"\.", r"\\."), F.lit(r"(?![\d.]*\d)")))
    return F.coalesce(hit & ~t.rlike(r"\bkhong (sua|thay the|dieu chinh|lam thay doi)|\bnot amend"), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def containment(a: Column, b: Column) -> Column:
    """The shared part of the smaller set; 0 if it is empty."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def content_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(r"\b([a-z]{3,})\b"), F.lit(1)))


def greedy_one_to_one(scored: DataFrame, keys: Sequence[str], left: str, right: str, score: str, ties: Sequence[str] = ()) -> DataFrame:
    """A one-to-one matching, the best pair first, ties by `ties` and then both ids. Each group is one document pair's articles, and is matched in one task."""
    order = [score, *ties, left, right]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=[False, *[True] * (len(order) - 1)])
        seen_l, seen_r, keep = set(), set(), []
        for a, b in zip(pdf[left], pdf[right], strict=True):
            ok = a not in seen_l and b not in seen_r
            keep.append(ok)
            if ok:
                seen_l.add(a)
                seen_r.add(b)
        return pdf[keep]

    return scored.groupBy(*keys).applyInPandas(run, scored.schema)


def align_articles(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Articles of two files one to one: titles that contain each other by 0.6, else equal numbers and bodies alike by 0.5. Inputs have art_id, number, title_words, words."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in ("art_id", "number", "title_words", "words")])
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("art_id", "number", "title_words", "words")])
    # a pair has a title word or its number in common: those are the equi-keys, no pair is made without one
    tokens = lambda d, s: d.withColumn("_t", F.explode(F.array_distinct(F.concat(F.col(f"{s}_title_words"), F.array(F.concat(F.lit("#"), F.coalesce(F.col(f"{s}_number").cast("string"), F.lit("?")), F.when(F.col(f"{s}_number").isNull(), F.col(f"{s}_art_id").cast("string")).otherwise(F.lit(""))))))))
    met = tokens(a, "l").join(tokens(b, "r"), [*keys, "_t"]).drop("_t").dropDuplicates([*keys, "l_art_id", "r_art_id"])
    by_title, by_body = containment(F.col("l_title_words"), F.col("r_title_words")), jaccard(F.col("l_words"), F.col("r_words"))
    same = F.coalesce(F.col("l_number") == F.col("r_number"), F.lit(False))
    scored = met.withColumn("score", F.when(by_title >= 0.6, by_title).when(same & (by_body >= 0.5), by_body)).where("score IS NOT NULL").withColumn("other_number", (~same).cast("int"))
    return greedy_one_to_one(scored.select(*keys, "l_art_id", "r_art_id", "score", "other_number"), keys, "l_art_id", "r_art_id", "score", ["other_number"])


def quantity_differences(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Aligned pairs whose lists of quantities differ as multisets, with the positions that differ where the lists are as long."""
    differ = F.array_sort(left) != F.array_sort(right)
    where = F.when(F.size(left) == F.size(right), F.filter(F.transform(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")), lambda x, i: F.when(x["l"] != x["r"], i)), lambda i: i.isNotNull()))
    return pairs.where(differ).withColumn("positions", where)


# ---- blocking ----------------------------------------------------------------------------------------------------------


def banded_pairs(nodes: DataFrame, group: Sequence[str], order: str, node: str = "node_id", window: int = GROUP_WINDOW) -> DataFrame:
    """(node_a, node_b): each member with the next `window` of its group, by lead columns: one sort, no self-join."""
    w = W.partitionBy(*group).orderBy(order, node)
    nxt = F.array_compact(F.array(*[F.lead(node, k).over(w) for k in range(1, window + 1)]))
    return nodes.select(F.col(node).alias("node_a"), nxt.alias("_n")).select("node_a", F.explode("_n").alias("node_b"))


def verbatim_pairs(nodes: DataFrame, text: str, order: str, node: str = "node_id") -> DataFrame:
    """(node_a, node_b) with equal text after numbering: each copy with the first one, so a large group makes no clique."""
    key = F.sha2(F.regexp_replace(fold(F.col(text)), r"^\d+(\.\d+)*\.?\s+", "").cast("binary"), 256)
    keyed = nodes.where(F.trim(text) != "").select(node, order, key.alias("_k"))
    first = keyed.groupBy("_k").agg(F.min_by(node, F.struct(order, node)).alias("node_a"), F.count("*").alias("_n")).where("_n > 1")
    return keyed.join(first, "_k").where(F.col(node) != F.col("node_a")).select("node_a", F.col(node).alias("node_b"))


def value_mismatch_pairs(nodes: DataFrame, text: str, order: str, node: str = "node_id", stop: Sequence[str] = (), shared: int = 4, alike: float = 0.12) -> DataFrame:
    """(node_a, node_b) that share words and a unit, and differ in its numbers: postings of words, each node with the next few of a posting."""
    n = nodes.select(node, order, content_words(F.col(text)).alias("w"), unit_values(F.col(text)).alias("v")).where(F.size(F.map_keys("v")) > 0).withColumn("w", F.array_except("w", F.array(*[F.lit(s) for s in stop]).cast("array<string>")))
    met = banded_pairs(n.select(node, order, F.explode("w").alias("word")), ["word"], order, node, POSTING_WINDOW).distinct()
    side = lambda k: n.select(F.col(node).alias(f"node_{k}"), F.col("w").alias(f"w_{k}"), F.col("v").alias(f"v_{k}"))
    both = met.join(side("a"), "node_a").join(side("b"), "node_b")
    return both.where((F.size(F.array_intersect("w_a", "w_b")) >= shared) & (jaccard(F.col("w_a"), F.col("w_b")) >= alike) & values_differ(F.col("v_a"), F.col("v_b"))).select("node_a", "node_b")


def same_article_related(text_a: Column, text_b: Column) -> Column:
    """Whether two clauses of one article may be about the same thing."""
    number = lambda t: F.regexp_extract(t, r"^\s*(\d+(?:\.\d+)*)\.?\s", 1)
    cites = lambda t, other: (number(t) != "") & F.regexp_like(fold(other), F.concat(F.lit(r"\bkhoan\s+"), F.regexp_replace(number(t), r"\.", r"\\."), F.lit(r"(?!\d|\.\d)")))
    return (
        cites(text_a, text_b) | cites(text_b, text_a) | F.rtrim(text_a).endswith(":") | F.rtrim(text_b).endswith(":") | (F.least(F.char_length(F.trim(text_a)), F.char_length(F.trim(text_b))) <= 30)
        | ((F.size(F.map_keys(unit_values(text_a))) > 0) & (F.size(F.map_keys(unit_values(text_b))) > 0)) | (jaccard(content_words(text_a), content_words(text_b)) >= 0.2)
    )


def topic_of(context: Column, text: Column, topics=TOPICS) -> Column:
    """The topic whose words come first in the context, else in the first 80 characters of the text; null if none does."""

    def first(c: Column) -> Column:
        t = fold(c)
        hits = F.array(*[F.struct(F.regexp_instr(t, F.lit(rf"\b(?:{p})\b")).alias("at"), F.lit(k).alias("rank"), F.lit(name).alias("topic")) for k, (name, p) in enumerate(topics)])
        return F.get(F.array_sort(F.filter(hits, lambda h: h["at"] > 0)), F.lit(0))["topic"]

    return F.coalesce(first(context), first(F.left(text, F.lit(80))))


def rank_candidates(sources: dict[str, DataFrame], positions: DataFrame, excluded: DataFrame | None = None, near: DataFrame | None = None, top_k: int = TOP_K, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, node_a, node_b, sources, score): the union of blocking sources, scored, and the first top_k dealt round by round over anchors.

    positions has scope, node_id, ord. A pair is ordered by position. The k-th best pair of every anchor comes before
    the k+1-th of any.
    """
    parts = [d.select("node_a", "node_b", F.lit(name).alias("source")) for name, d in sources.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    at = lambda k: positions.select(*([c for c in scope] if k == "a" else []), F.col("node_id").alias(f"node_{k}"), F.col("ord").alias(f"ord_{k}"))
    met = union.join(at("a"), "node_a").join(at("b"), "node_b").where("node_a <> node_b")
    swap = (F.col("ord_a") > F.col("ord_b")) | ((F.col("ord_a") == F.col("ord_b")) & (F.col("node_a") > F.col("node_b")))
    pair = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    met = met.select(*scope, pair("node_a", "node_b").alias("node_a"), pair("node_b", "node_a").alias("node_b"), pair("ord_a", "ord_b").alias("ord_a"), "source")
    if excluded is not None:
        met = met.join(excluded.select(pair_key(F.col("node_a"), F.col("node_b")).alias("_k")).distinct(), F.col("_k") == pair_key(F.col("node_a"), F.col("node_b")), "left_anti")
    got = met.groupBy(*scope, "node_a", "node_b", "ord_a").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    got = got.withColumn("score", F.aggregate("sources", F.lit(0), lambda t, s: t + F.coalesce(weight[s], F.lit(0))))
    if near is not None:
        close = near.select("node_a", "node_b", F.lit(2).alias("_bonus"))
        got = got.join(close, ["node_a", "node_b"], "left").withColumn("score", F.col("score") + F.coalesce("_bonus", F.lit(0))).drop("_bonus")
    best = [F.col("score").desc(), "node_a", "node_b"]
    got = got.withColumn("_round", F.row_number().over(W.partitionBy(*scope, "node_a").orderBy(*best)))
    return got.withColumn("_rn", F.row_number().over(W.partitionBy(*scope).orderBy("_round", F.col("score").desc(), "ord_a", "node_a", "node_b"))).where(F.col("_rn") <= top_k).select(*scope, "node_a", "node_b", "sources", "score")


# ---- frames ------------------------------------------------------------------------------------------------------------


def frame_key(family: Column, slots: Column) -> Column:
    """What two frames must share to be compared; null if a slot that it needs isn't grounded, so that uncertainty never joins.

    slots: map<string, struct<state, value>>. Parameters and definitions go by their parameter; others by actor and action
    (and a grounded qualifier) with family.
    """
    v = lambda s: F.when(slots[s]["state"] == "GROUNDED", F.lower(slots[s]["value"]))
    whole = lambda *parts: F.when(F.forall(F.array(*parts), lambda p: p.isNotNull()), F.concat_ws("|", family, *parts))
    unsure = F.coalesce(slots["qualifier"]["state"].isin("UNKNOWN", "UNSUPPORTED"), F.lit(False))
    qualified = F.when(slots["qualifier"]["state"] == "GROUNDED", whole(v("bearer"), v("action"), v("qualifier"))).otherwise(whole(v("bearer"), v("action")))
    return F.when(family.isin("PARAMETER", "DEFINITION"), whole(v("param"))).when(~unsure, qualified)


def alignment_key(family: Column, slots: Column) -> Column:
    """As frame_key, with obligations, rights and prohibitions as one family."""
    return frame_key(F.when(family.isin("OBLIGATION", "RIGHT", "PROHIBITION"), "MODAL").otherwise(family), slots)


def compare_frames(left: str = "l", right: str = "r", required: Sequence[str] = ("bearer", "action", "consequence")) -> Column:
    """The outcome for two frames: profile, scope, key, slots that must be grounded, differing grounded slots, in this order."""
    lc, rc = (lambda f: F.col(f"{left}.{f}")), (lambda f: F.col(f"{right}.{f}"))
    ground = lambda s, k: F.coalesce(s[k]["state"] == "GROUNDED", F.lit(False))
    open_slot = F.lit(False)
    for k in required:
        unsure = lambda s, k=k: F.coalesce(s[k]["state"].isin("UNKNOWN", "UNSUPPORTED"), F.lit(False))
        open_slot = open_slot | unsure(lc("slots")) | unsure(rc("slots"))
    keys = F.array_union(F.map_keys(lc("slots")), F.map_keys(rc("slots")))
    differ = F.exists(keys, lambda k: (ground(lc("slots"), k) | ground(rc("slots"), k)) & ~(F.when(ground(lc("slots"), k), F.lower(lc("slots")[k]["value"])).eqNullSafe(F.when(ground(rc("slots"), k), F.lower(rc("slots")[k]["value"])))))
    lk, rk = frame_key(lc("family"), lc("slots")), frame_key(rc("family"), rc("slots"))
    return (
        F.when(~lc("profile").eqNullSafe(rc("profile")), "NOT_COMPARABLE").when(~lc("scope").eqNullSafe(rc("scope")), "NOT_COMPARABLE").when(lk.isNull() | rk.isNull(), "NEEDS_EVIDENCE")
        .when(lk != rk, "NOT_COMPARABLE").when(open_slot, "NEEDS_EVIDENCE").when(differ, "COMPARABLE_DIFFERENCE").otherwise("COMPARABLE_MATCH")
    )


def interval_overlap(left: Column, right: Column) -> Column:
    """DISJOINT or PARTIAL for `base op number` on one folded base; null where either can't be read or the bases differ."""
    part = lambda c, i: F.regexp_extract(fold(c), r"^(.*?)\s*(<=|>=|<|>)\s*(\d+(?:\.\d+)?)$", i)
    l_op, r_op, x, y = part(left, 2), part(right, 2), part(left, 3).try_cast("double"), part(right, 3).try_cast("double")
    ready = (l_op != "") & (r_op != "") & (part(left, 1) == part(right, 1))
    up = lambda op: op.startswith(">")
    strict = (F.length(l_op) == 1) | (F.length(r_op) == 1)
    apart = lambda low, high: (low > high) | ((low == high) & strict)
    disjoint = (up(l_op) & ~up(r_op) & apart(x, y)) | (up(r_op) & ~up(l_op) & apart(y, x))
    return F.when(ready, F.when(disjoint, "DISJOINT").otherwise("PARTIAL"))


def context_assessment(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """SAME, DISJOINT, PARTIAL or UNKNOWN over several context slots: the worst of them."""
    each = [F.when(a.isNull() & b.isNull(), "SAME").when(a.isNull() | b.isNull(), "UNKNOWN").when(fold(a) == fold(b), "SAME").otherwise(F.coalesce(interval_overlap(a, b), F.lit("UNKNOWN"))) for a, b in pairs]
    has = lambda s: F.array_contains(F.array(*each), s)
    return F.when(has("DISJOINT"), "DISJOINT").when(has("UNKNOWN"), "UNKNOWN").when(has("PARTIAL"), "PARTIAL").otherwise("SAME")


def same_key_candidates(frames: DataFrame, scope: Sequence[str], key: str = "key", frame: str = "frame_id", document: str = "document_id", milestone: str = "milestone") -> DataFrame:
    """Pairs of frames with one key in a scope; different payment milestones of one document are no pair. Members meet the next GROUP_WINDOW of their key."""
    known = frames.where(F.col(key).isNotNull())
    pairs = banded_pairs(known, [*scope, key], frame, frame)
    side = lambda k: known.select(F.col(frame).alias(f"node_{k}"), F.col(document).alias(f"d_{k}"), F.col(milestone).alias(f"m_{k}"))
    return pairs.join(side("a"), "node_a").join(side("b"), "node_b").where(~((F.col("d_a") == F.col("d_b")) & F.coalesce(F.col("m_a") != F.col("m_b"), F.lit(False)))).select("node_a", "node_b", F.lit("SAME_KEY").alias("reason"))


def compare_last_annex(body: DataFrame, annex: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Fields that both have: the last annex fact of a field against the body's. Fields of one side alone give nothing."""
    last = annex.groupBy(*keys).agg(F.max_by(value, order).alias("annex_value"))
    return body.select(*keys, F.col(value).alias("body_value")).join(last, list(keys)).withColumn("same", F.col("body_value").eqNullSafe(F.col("annex_value")))


def rebuild_span(rows: DataFrame, citations: DataFrame, doc: str, bucket: int = 1000) -> DataFrame:
    """The text between two offsets, clipped from the lines that overlap; a gap of one character between lines is a newline again.

    rows: doc, char_start, char_end, line. citations: citation_id, doc, span_start, span_end. The range join is an
    equi-join on buckets of offsets.
    """
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bucket)))
    met = citations.withColumn("_b", cut("span_start", "span_end")).join(rows.withColumn("_b", cut("char_start", "char_end")), [doc, "_b"]).where("char_start < span_end AND char_end > span_start").drop("_b").distinct()
    lo, hi = F.greatest("char_start", "span_start"), F.least("char_end", "span_end")
    part = F.substring(F.col("line"), lo - F.col("char_start") + 1, hi - lo)
    w = W.partitionBy("citation_id").orderBy("char_start")
    met = met.withColumn("_part", part).withColumn("_gap", F.when(F.col("char_start") - F.lag("char_end").over(w) == 1, "\n").otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("char_start", F.concat("_gap", "_part").alias("x"))))
    return met.groupBy("citation_id").agg(F.array_join(F.transform(ordered, lambda x: x["x"]), "").alias("span_text"))


def citation_status(quote: Column, span: Column, quote_sha: Column, source_sha: Column, pinned_sha: Column) -> Column:
    """VALID, INVALID or UNVERIFIED by ordered checks: quote there, source pinned, digest of the quote, the rebuilt span."""
    blank = F.coalesce(F.trim(quote) == "", F.lit(True))
    norm = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    return (
        F.when(blank, "INVALID").when(F.coalesce(source_sha != pinned_sha, F.lit(False)), "INVALID").when(F.coalesce(quote_sha != F.sha2(quote.cast("binary"), 256), F.lit(False)), "INVALID")
        .when(span.isNull(), "UNVERIFIED").when(norm(span).contains(norm(quote)), "VALID").otherwise("INVALID")
    )


def group_hits(hits: DataFrame, keys: Sequence[str], raw: str, node: str, order: str) -> DataFrame:
    """Hits by their digits, else their raw value, else their node; first-seen order, all evidence kept."""
    digits = F.nullif(F.regexp_replace(F.col(raw), r"\D", ""), F.lit(""))
    return hits.withColumn("canonical", F.coalesce(digits, F.nullif(F.trim(raw), F.lit("")), F.col(node).cast("string"))).groupBy(*keys, "canonical").agg(F.min(order).alias("first_seen"), F.array_sort(F.collect_list(F.struct(order, node))).alias("evidence"))


def identity_answers(entities: DataFrame, hits: DataFrame, keys: Sequence[str], raw: str, node: str, order: str) -> DataFrame:
    """(keys, n, state, values): for each entity its distinct identities by their digits, and the state that their number gives."""
    n = group_hits(hits, keys, raw, node, order).groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "canonical"))), lambda x: x["canonical"]).alias("values"))
    return entities.select(*keys).distinct().join(n, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("values", F.coalesce("values", F.array().cast("array<string>"))).withColumn("state", identity_state(F.col("n")))


def article_key(part: Column, dieu_nearest: Column) -> Column:
    """What nodes of one article share: a whole annex, or a part's article; null, never grouped, without either."""
    key = lambda a, b: F.struct(a.alias("part"), b.alias("dieu"))
    return F.when(part.startswith("annex:"), key(part, F.lit(""))).when(part.isNotNull() & dieu_nearest.isNotNull(), key(part, dieu_nearest))


def mapped_fields(raw: DataFrame, aliases: DataFrame, scope: Sequence[str], raw_key: str = "raw_key") -> DataFrame:
    """raw with field and review_state: the field whose alias, folded, is the raw key in this scope; the first field in the profile's order (ord). aliases: scope, field, alias, ord."""
    known = aliases.select(*scope, "field", "ord", fold(F.col("alias")).alias("_k")).groupBy(*scope, "_k").agg(F.min_by("field", F.struct("ord", "field")).alias("field"))
    got = raw.withColumn("_k", fold(F.col(raw_key))).join(known, [*scope, "_k"], "left").drop("_k")
    return got.withColumn("review_state", F.when(F.col("field").isNull(), "NEEDS_REVIEW").otherwise("PASS"))


def identity_state(n: Column) -> Column:
    """No identity: no evidence; one: answered; more: to be reviewed."""
    return F.when(n == 0, "INSUFFICIENT_EVIDENCE").when(n == 1, "ANSWERED").otherwise("NEEDS_REVIEW")

