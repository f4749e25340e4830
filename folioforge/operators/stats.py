"""Evaluation: intervals, gates, matching, sampling, error rates."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_UNITS = 60


def wilson(successes: Column, total: Column, z: float | None = None, confidence: float = 0.95) -> Column:
    """(low, high) of the Wilson interval; (0, 1) for no trials. z defaults to the normal quantile of the confidence; 1.96 is a caller's choice."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2) if z is None else z
    n, k = total.cast("double"), successes.cast("double")
    p = k / n
    mid, wide, base = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(total == 0, F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))).otherwise(F.struct(F.greatest(F.lit(0.0), (mid - wide) / base).alias("low"), F.least(F.lit(1.0), (mid + wide) / base).alias("high")))


def zero_failure_bound(total: Column, confidence: float = 0.95) -> Column:
    """The upper bound of a failure rate after no failures; 1 for no trials."""
    return F.when(total <= 0, 1.0).otherwise(1 - F.pow(F.lit(1 - confidence), 1 / total))


def cluster_bootstrap(records: DataFrame, keys: Sequence[str], cluster: str, passed: str, rounds: int = 2000, seed: int = 7, confidence: float = 0.95) -> DataFrame:
    """(keys, rate, low, high): clusters drawn again with Poisson(1) weights, which hashes of cluster and round give.

    Clusters are summed first; each then meets every round, and rounds are summed before the shuffle. Reruns agree;
    the numbers are this definition's own.
    """
    sums = records.groupBy(*keys, cluster).agg(F.sum(F.col(passed).cast("int")).alias("k"), F.count("*").alias("n"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(cluster), F.col("r")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cut, p, total, weight = [], 1.0, 0.0, F.lit(0)
    for i in range(9):
        p = p / i if i else 0.36787944117144233
        total += p
        cut.append(total)
    for c in cut:
        weight = weight + (F.col("u") > c).cast("int")
    drawn = sums.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("u", u).withColumn("w", weight)
    rates = drawn.groupBy(*keys, "r").agg((F.sum(F.col("w") * F.col("k")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("rate"))
    tail = (1 - confidence) / 2
    bounds = rates.groupBy(*keys).agg(F.expr(f"percentile(rate, {tail})").alias("low"), F.expr(f"percentile(rate, {1 - tail})").alias("high"))
    point = sums.groupBy(*keys).agg((F.sum("k") / F.sum("n")).alias("rate"))
    return point.join(bounds, list(keys)) if keys else point.crossJoin(bounds)


def evaluate_metrics(records: DataFrame, specs: DataFrame, metric: str = "metric", unit: str = "unit_id", passed: str = "passed", split: str | None = None) -> DataFrame:
    """(metric, n, k, low, high, duplicates, state): DUPLICATE_UNITS, NOT_RUN, FAIL, UNDERPOWERED under 60 units, else PASS. specs: metric, threshold."""
    keys = [metric] + ([split] if split else [])
    got = records.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(passed).alias("k"), (F.count("*") - F.count_distinct(unit)).alias("duplicates"))
    all_ = specs.join(got, metric, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "k", "duplicates")})
    all_ = all_.withColumn("_w", wilson(F.col("k"), F.col("n"))).withColumns({"low": F.col("_w.low"), "high": F.col("_w.high")}).drop("_w")
    state = F.when(F.col("duplicates") > 0, "DUPLICATE_UNITS").when(F.col("n") == 0, "NOT_RUN").when(F.col("k") / F.col("n") < F.col("threshold"), "FAIL").when(F.col("n") < LEAST_UNITS, "UNDERPOWERED").otherwise("PASS")
    return all_.withColumn("state", state)


def overall_state(metrics: DataFrame, state: str = "state") -> DataFrame:
    """The worst state: FAIL, NOT_RUN, UNDERPOWERED, PASS."""
    rank = F.when(F.col(state).isin("FAIL", "DUPLICATE_UNITS"), 3).when(F.col(state) == "NOT_RUN", 2).when(F.col(state) == "UNDERPOWERED", 1).otherwise(0)
    return metrics.agg(F.max_by(state, rank).alias("overall"))


def undeclared(records: DataFrame, specs: DataFrame, metric: str = "metric") -> DataFrame:
    return records.select(metric).distinct().join(specs, metric, "left_anti")


def regressions(baseline: DataFrame, current: DataFrame, item: str, passed: str) -> DataFrame:
    """(item, kind): items that fail now and weren't there, and items that passed and now fail."""
    was = baseline.groupBy(item).agg(F.bool_and(passed).alias("was"))
    now = current.groupBy(item).agg(F.bool_and(passed).alias("now")).where("NOT now")
    got = now.join(was, item, "left")
    return got.where("was IS NULL OR was").select(item, F.when(F.col("was").isNull(), "NEW_FAILURE").otherwise("REGRESSION").alias("kind"))


def pass_report(records: DataFrame, metric: str, split: str, passed: str) -> DataFrame:
    return records.groupBy(metric, split).agg(F.count("*").alias("n"), F.count_if(passed).alias("n_pass"), F.count_if(~F.col(passed)).alias("n_fail"))


def greedy_rank_match(gold: DataFrame, pred: DataFrame, passes: Sequence[Sequence[str]], gold_id: str, pred_id: str) -> DataFrame:
    """(gold_id, pred_id, pass_no): the k-th gold row of a key with its k-th prediction; later passes match what is left by coarser keys. Keys must not be null."""
    out, g, p = None, gold, pred
    for i, keys in enumerate(passes):
        k = list(keys)
        number = lambda d, own: d.where(" AND ".join(f"{c} IS NOT NULL" for c in k)).withColumn("_rn", F.row_number().over(W.partitionBy(*k).orderBy(own))).select(*k, "_rn", own)
        got = number(g, gold_id).join(number(p, pred_id), [*k, "_rn"]).select(gold_id, pred_id, F.lit(i + 1).alias("pass_no"))
        out = got if out is None else out.unionByName(got)
        g, p = g.join(got, gold_id, "left_anti"), p.join(got, pred_id, "left_anti")
    return out


def expand_targets(preds: DataFrame, targets: str, target: str) -> DataFrame:
    """A row for each listed target, else the single one."""
    return preds.withColumn("slot_target", F.explode(F.coalesce(F.nullif(F.col(targets), F.array().cast(preds.schema[targets].dataType)), F.array(F.col(target)))))


def pair_scores(gold: DataFrame, pred: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group and overall (null keys): gold and predicted rows, found sources, agreeing ops, right targets. matched has op_agrees and target_right."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("n_gold"))
    p = pred.groupBy(*keys).agg(F.count("*").alias("n_pred"))
    m = matched.groupBy(*keys).agg(F.count("*").alias("src_found"), F.count_if("op_agrees").alias("op_agree"), F.count_if("target_right").alias("target_correct"))
    per = g.join(p, list(keys), "full").join(m, list(keys), "full").fillna(0)
    names = ["n_gold", "n_pred", "src_found", "op_agree", "target_correct"]
    return per.rollup(*keys).agg(*[F.sum(n).alias(n) for n in names], F.grouping_id().alias("level")).where(f"level IN (0, {(1 << len(keys)) - 1})").drop("level")


def relation_blocks(gold: DataFrame, pred: DataFrame, pair: str, strata: Sequence[str]) -> DataFrame:
    """Counts over predictions and gold together, overall and by each stratum, in one pass with grouping sets."""
    u = gold.select(pair, *strata, F.col("label").alias("gold")).join(pred.select(pair, F.col("label").alias("pred")), pair, "full")
    sets = [[F.col(s)] for s in strata] + [[]]
    hit = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    return u.groupingSets(sets, *[F.col(s) for s in strata]).agg(F.count("*").alias("n"), F.count("gold").alias("n_gold"), F.count("pred").alias("n_pred"), F.count_if(hit).alias("n_hit"), F.count_if((F.col("pred") == "DUPLICATE") & ~hit).alias("n_false_duplicate"))


def horvitz_thompson(hit: Column, pi: Column) -> Column:
    """Aggregate: the sum of hits over their inclusion probability, over the sum of all."""
    return F.sum(F.when(hit, 1 / pi).otherwise(0.0)) / F.sum(1 / pi)


def allocate(counts: DataFrame, stratum: str, n: str, total: int, floor: int) -> DataFrame:
    """(stratum, n, quota): a floor for each stratum, capped by its size, and the rest by largest remainder. One row per stratum, so the loop that moves what caps leave over is a few rounds of a tiny table."""
    rows = [(r[stratum], int(r[n])) for r in counts.select(stratum, n).orderBy(stratum).collect()]  # strata are few by contract
    quota = {s: min(floor, k) for s, k in rows}
    left = max(0, min(total, sum(k for _, k in rows)) - sum(quota.values()))
    while left:
        open_ = {s: k for s, k in rows if quota[s] < k}
        size = sum(open_.values())
        share = {s: left * k / size for s, k in open_.items()}
        add = {s: min(int(share[s]), open_[s] - quota[s]) for s in open_}
        rest = left - sum(add.values())
        for s in sorted(open_, key=lambda s: (-(share[s] - int(share[s])), str(s))):
            if rest and quota[s] + add[s] < open_[s]:
                add[s] += 1
                rest -= 1
        for s, a in add.items():
            quota[s] += a
        left = rest
    return counts.sparkSession.createDataFrame([(s, k, quota[s]) for s, k in rows], counts.select(stratum, n).schema.add("quota", "long"))


def stratified_sample(rows: DataFrame, quotas: DataFrame, stratum: str, key: str, seed: str = "7") -> DataFrame:
    """The first `quota` rows of each stratum by the MD5 of seed and key, with the inclusion probability pi. A sampling operator: the cut is its purpose."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"))
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(stratum).orderBy(order, key)))
    n = quotas.select(stratum, "quota", F.col("n").alias("_n"))
    return ranked.join(n, stratum).where(F.col("_rn") <= F.col("quota")).withColumn("pi", F.col("quota") / F.col("_n")).drop("_rn", "quota", "_n")


def agreement(primary: DataFrame, independent: DataFrame, pair: str, label: str) -> DataFrame:
    """(n, n_agree, rate) of pairs that both annotators judged."""
    both = primary.select(pair, F.col(label).alias("a")).join(independent.select(pair, F.col(label).alias("b")), pair)
    return both.agg(F.count("*").alias("n"), F.count_if(F.expr("a = b")).alias("n_agree")).withColumn("rate", F.col("n_agree") / F.nullif(F.col("n"), F.lit(0)))


def confusion(rows: DataFrame, keys: Sequence[str], gold: str, pred: str, labels: Sequence) -> DataFrame:
    return rows.groupBy(*keys, gold).pivot(pred, list(labels)).count().fillna(0)


def node_pairs(nodes: DataFrame, doc: str, node: str, ancestors: DataFrame) -> DataFrame:
    """Unordered node pairs of each document, none with its ancestor: an evaluation pool over documents that are small by nature."""
    a, b = nodes.select(doc, F.col(node).alias("node_a")), nodes.select(doc, F.col(node).alias("node_b"))
    pairs = a.join(b, doc).where("node_a < node_b")
    up = ancestors.select(doc, F.least(node, "ancestor").alias("node_a"), F.greatest(node, "ancestor").alias("node_b")).distinct()
    return pairs.join(up, [doc, "node_a", "node_b"], "left_anti")


def assign_splits(members: DataFrame, cluster: str, url: str, contaminated: str) -> DataFrame:
    """(cluster, split): contaminated clusters are dev; the rest, in the order of their least URL hash, are held out for the first two thirds."""
    c = members.groupBy(cluster).agg(F.min(F.sha2(F.col(url).cast("binary"), 256)).alias("_h"), F.bool_or(contaminated).alias("_c"))
    free = c.where("NOT _c").withColumn("_rn", F.row_number().over(W.orderBy("_h", cluster))).withColumn("_n", F.count("*").over(W.partitionBy()))
    ok = free.select(cluster, F.when(F.col("_rn") <= F.ceil(2 * F.col("_n") / 3), "heldout").otherwise("dev").alias("split"))
    return ok.unionByName(c.where("_c").select(cluster, F.lit("dev").alias("split")))


def recall_at(ranked: DataFrame, gold: DataFrame, pair: str, rank: str, grid: Sequence[int]) -> DataFrame:
    """(k, n_gold, n_found) for each k of the grid; candidates without a rank are found at none."""
    met = gold.select(pair).join(ranked.select(pair, rank), pair, "left")
    cols = [F.struct(F.lit(k).alias("k"), F.count("*").alias("n_gold"), F.count_if(F.col(rank) <= k).alias("n_found")) for k in grid]
    return met.agg(F.array(*cols).alias("_g")).select(F.inline("_g"))


def choose_top_k(recalls: DataFrame, full: int, share: float = 0.95, default: int = 40) -> DataFrame:
    return recalls.agg(F.coalesce(F.min(F.when(F.col("n_found") >= share * full, F.col("k"))), F.lit(default)).alias("top_k"))


def paired_ablation(local: DataFrame, enriched: DataFrame, unit: str, passed: str) -> DataFrame:
    """(n, improved, regressed, keys_equal): units of both runs; keys_equal is false if either has a unit that the other lacks."""
    both = local.select(unit, F.col(passed).alias("a")).join(enriched.select(unit, F.col(passed).alias("b")), unit, "full")
    return both.agg(F.count("*").alias("n"), F.count_if(F.expr("NOT a AND b")).alias("improved"), F.count_if(F.expr("a AND NOT b")).alias("regressed"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("keys_equal"))


def ground_truth(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each expected field: PASS, FAIL, or MISS where there is none."""
    got = expected.join(actual.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_there")), list(keys), "left")
    return got.withColumn("state", F.when(F.col("_there").isNull(), "MISS").when(F.col(value).eqNullSafe(F.col("_a")), "PASS").otherwise("FAIL")).drop("_a", "_there")


def compare_field(extracted: Column, truth: Column) -> Column:
    """SKIP, EXTRA or MISS for blanks, else MATCH or MISMATCH of folded values."""
    from folioforge.functions.text import fold

    e, t = F.nullif(fold(extracted), F.lit("")), F.nullif(fold(truth), F.lit(""))
    return F.when(e.isNull() & t.isNull(), "SKIP").when(t.isNull(), "EXTRA").when(e.isNull(), "MISS").when(e == t, "MATCH").otherwise("MISMATCH")


def dimension_scores(results: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """Share of matches among judged fields in percent, half up to one place; 0 without any."""
    judged = F.count_if(F.col(outcome) != "SKIP")
    return results.groupBy(*keys).agg(F.coalesce(F.round(100 * F.count_if(F.col(outcome) == "MATCH") / F.nullif(judged, F.lit(0)), 1), F.lit(0.0)).alias("score"), judged.alias("n"))


def set_overlap(predicted: Column, expected: Column) -> Column:
    """matched, missed and hallucinated items."""
    return F.struct(F.array_sort(F.array_intersect(predicted, expected)).alias("matched"), F.array_sort(F.array_except(expected, predicted)).alias("missed"), F.array_sort(F.array_except(predicted, expected)).alias("hallucinated"))


def precision_recall_f1(predicted: Column, expected: Column) -> Column:
    """Both empty: 1, 1, 1. No predictions: 1, 0, 0. No gold: 0, 1, 0."""
    n_p, n_e, hit = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(expected)), F.size(F.array_intersect(predicted, expected))
    make = lambda p, r, f: F.struct(p.cast("double").alias("precision"), r.cast("double").alias("recall"), f.cast("double").alias("f1"))
    one, zero = F.lit(1.0), F.lit(0.0)
    p, r = hit / n_p, hit / n_e
    return F.when((n_p == 0) & (n_e == 0), make(one, one, one)).when(n_p == 0, make(one, zero, zero)).when(n_e == 0, make(zero, one, zero)).otherwise(make(p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))))


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.greatest(F.char_length(reference), F.lit(1))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of words over the reference's words: each distinct word is one character of a private range."""
    r, h = F.filter(F.split(reference, r"\s+"), lambda w: w != ""), F.filter(F.split(hypothesis, r"\s+"), lambda w: w != "")
    vocabulary = F.array_distinct(F.concat(r, h))
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(coded(r), coded(h)) / F.greatest(F.size(r), F.lit(1))


def mark_error_rates(pairs: DataFrame, reference: str, hypothesis: str, out: str = "marks") -> DataFrame:
    """pairs with (errors, letters, rate): of the letters that a least-cost alignment without marks joins, those whose marks differ.

    Null texts are empty; a pair without aligned letters has a null rate. Both texts are composed first, so the two ways
    to write an accent are equal. A line is one task's row and costs its length and the square of its edits: cut pages
    into lines, as one would for any edit distance.
    """
    from folioforge.functions.sequence import mark_errors

    count = F.udf(lambda a, b: mark_errors(a or "", b or ""), "struct<errors:long,letters:long>", useArrow=True)
    return pairs.withColumn("_m", count(reference, hypothesis)).withColumn(out, F.struct("_m.errors", "_m.letters", (F.col("_m.errors") / F.nullif(F.col("_m.letters"), F.lit(0))).alias("rate"))).drop("_m")


def retained_tokens(truth: DataFrame, found: DataFrame, keys: Sequence[str], kind: str, value: str) -> DataFrame:
    """(keys, kind, n, n_kept): a multiset's tokens that a prediction keeps, each as often as it stands there."""
    n = lambda d, name: d.groupBy(*keys, kind, value).agg(F.count("*").alias(name))
    got = n(truth, "_t").join(n(found, "_f"), [*keys, kind, value], "left")
    return got.groupBy(*keys, kind).agg(F.sum("_t").alias("n"), F.sum(F.least("_t", F.coalesce("_f", F.lit(0)))).alias("n_kept"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of [x0, y0, x1, y1]; corners in any order."""
    lo = lambda x, i, j: F.least(F.get(x, F.lit(i)), F.get(x, F.lit(j)))
    hi = lambda x, i, j: F.greatest(F.get(x, F.lit(i)), F.get(x, F.lit(j)))
    side = lambda i, j: F.greatest(F.lit(0.0), F.least(hi(a, i, j), hi(b, i, j)) - F.greatest(lo(a, i, j), lo(b, i, j)))
    area = lambda x: (hi(x, 0, 2) - lo(x, 0, 2)) * (hi(x, 1, 3) - lo(x, 1, 3))
    both = side(0, 2) * side(1, 3)
    return F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0.0)), F.lit(0.0))


def box_matches(pairs: DataFrame, keys: Sequence[str], ref: str, pred: str, iou: str, threshold: float = 0.5) -> DataFrame:
    """The one-to-one assignment of the greatest total overlap in each page, of which pairs at the threshold count. A page is one task's group."""
    from folioforge.functions.sequence import hungarian

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=ref, columns=pred, values=iou, fill_value=0.0)
        keep = {(m.index[i], m.columns[j]) for i, j in hungarian((1 - m.to_numpy()).tolist())}
        return pdf[[(a, b) in keep and v >= threshold for a, b, v in zip(pdf[ref], pdf[pred], pdf[iou], strict=True)]]

    return pairs.groupBy(*keys).applyInPandas(run, pairs.schema)


def grouped_report(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], numerator: str, denominator: str, ok: str) -> DataFrame:
    """Counts, success rate, mean and exact median of each metric, and the pooled ratio."""
    aggs = [F.count("*").alias("n"), F.avg(F.col(ok).cast("double")).alias("success_rate"), (F.sum(numerator) / F.nullif(F.sum(denominator), F.lit(0))).alias("pooled")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median")]
    return rows.groupBy(*keys).agg(*aggs)


def in_every_group(rows: DataFrame, document: str, group: Sequence[str]) -> DataFrame:
    """Rows of documents that every group has."""
    total = F.lit(rows.select(*group).distinct().count())
    full = rows.groupBy(document).agg(F.count_distinct(*group).alias("_n")).where(F.col("_n") == total)
    return rows.join(full.select(document), document, "left_semi")


def interval_relation(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, dim_a: Column, dim_b: Column, unparsed: Column) -> Column:
    """UNPARSED, IDENTICAL, NESTED, DIFFERENT_DIM, DISJOINT or OVERLAP. A null bound is open; no bounds at all contain everything."""
    low = lambda c: F.coalesce(c, F.lit(float("-inf")))
    high = lambda c: F.coalesce(c, F.lit(float("inf")))
    free = lambda lo, hi: lo.isNull() & hi.isNull()
    inside = lambda a, b, c, d: (low(a) >= low(c)) & (high(b) <= high(d))
    same = lo_a.eqNullSafe(lo_b) & hi_a.eqNullSafe(hi_b) & dim_a.eqNullSafe(dim_b)
    return (
        F.when(unparsed, "UNPARSED").when(same, "IDENTICAL").when(free(lo_a, hi_a) | free(lo_b, hi_b), "NESTED").when(~dim_a.eqNullSafe(dim_b), "DIFFERENT_DIM")
        .when((low(lo_a) > high(hi_b)) | (low(lo_b) > high(hi_a)), "DISJOINT").when(inside(lo_a, hi_a, lo_b, hi_b) | inside(lo_b, hi_b, lo_a, hi_a), "NESTED").otherwise("OVERLAP")
    )


def ordering_ok(events: DataFrame, run: str, arrival: str, sequence: str) -> DataFrame:
    """(run, ok): in order of arrival the sequences are exactly 1 to n."""
    got = events.withColumn("_rn", F.row_number().over(W.partitionBy(run).orderBy(arrival)))
    return got.groupBy(run).agg(F.bool_and(F.coalesce(F.col(sequence) == F.col("_rn"), F.lit(False))).alias("ok"))


def citations_complete(records: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("citation_id", "node_id", "page_revision_id", "quote")) -> DataFrame:
    """(keys, state): PASS if every record has all fields, FAIL else."""
    full = F.lit(True)
    for f in fields:
        full = full & F.coalesce(F.trim(F.col(f).cast("string")) != "", F.lit(False))
    return records.groupBy(*keys).agg(F.when(F.bool_and(full), "PASS").otherwise("FAIL").alias("state"))


# The field outcomes that close a release, by rule number.
RELEASE_RULES = (
    (0, ("state",), ("MISS", "MISMATCH"), "malformed_snapshot"),
    (1, ("citations", "citation"), ("MISS", "MISMATCH", "EXTRA"), None),
    (2, ("state", "review_state"), ("MISS", "MISMATCH"), None),
    (3, ("no_legal_winner", "no_winner", "prompt_not_authority"), ("MISS", "MISMATCH"), None),
    (4, ("no_unsupported_conversion",), ("MISS", "MISMATCH"), None),
    (5, ("no_leakage",), ("MISS", "MISMATCH"), None),
    (6, ("relations", "relation_edges"), ("MISS", "MISMATCH", "EXTRA"), None),
    (6, ("two_sided_evidence",), ("MISS", "MISMATCH"), None),
    (7, ("blocked",), ("MISMATCH",), None),
)


def release_failures(outcomes: DataFrame, errors: DataFrame, case: str = "case", field: str = "field", status: str = "status") -> DataFrame:
    """(case, rule_index, field): every outcome that a rule forbids; a case with an error fails rule 0 and is judged no further. No rows: the gates are passed."""
    failed = errors.select(case).distinct()
    rows = outcomes.join(failed, case, "left_anti")
    hits = [F.when(F.col(field).isin(*names) & F.col(status).isin(*bad) & (F.col(case) == only if only else F.lit(True)), F.lit(rule)) for rule, names, bad, only in RELEASE_RULES]
    got = rows.select(case, F.explode(F.array_compact(F.array(*hits))).alias("rule_index"), field)
    return got.unionByName(failed.select(case, F.lit(0).alias("rule_index"), F.lit(None).cast("string").alias(field)))


def line_text_confidence(verified: Column, arbitrated: Column, review: Column, readers: dict[str, float], doubts: dict[str, float], unknown: float = 0.5) -> Column:
    """The readers' confidence (keys arbitrated, verified, single), or the least of the line's doubts if that is less; an unknown doubt counts `unknown`."""
    base = F.when(arbitrated, readers["arbitrated"]).when(verified, readers["verified"]).otherwise(readers["single"])
    known = F.create_map(*[F.lit(x) for kv in doubts.items() for x in kv])
    return F.least(base, F.array_min(F.transform(review, lambda r: F.coalesce(known[r], F.lit(unknown)))))


def disputed_spans(pairs: DataFrame, first: str, second: str, out: str = "disputes") -> DataFrame:
    """pairs with an array of (start, end, first, second): the spans where two readings, arrays of words, name different words; accents don't count. Each pair of lines is aligned in its worker."""
    from difflib import SequenceMatcher

    from pyspark.sql import types as T

    kind = T._parse_datatype_string("array<struct<start:int,end:int,first:array<string>,second:array<string>>>")

    def one(a: list, b: list, fa: list, fb: list) -> list:
        return [(i, j, a[i:j], b[k:m]) for tag, i, j, k, m in SequenceMatcher(None, fa, fb, autojunk=False).get_opcodes() if tag != "equal"]

    from folioforge.functions.text import fold

    folded = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), fold)
    align = F.udf(lambda a, b, fa, fb: one(a or [], b or [], fa, fb), kind, useArrow=True)
    return pairs.withColumn(out, align(first, second, folded(F.col(first)), folded(F.col(second))))


def quality_gate(n: Column, k: Column, least: int, floor: float) -> Column:
    """Closed unless there are enough cases and the Wilson bound reaches the floor."""
    return F.when(n < least, "UNDERPOWERED").when(wilson(k, n)["low"] >= floor, "OPEN").otherwise("CLOSED")


def nearest_rank(value: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def linear_quantile(value: str, p: float) -> Column:
    return F.expr(f"percentile({value}, {p})")
