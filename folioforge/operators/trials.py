"""Diagnosis of a classifier's trial: the layer at which each reviewed pair was lost, the accounts, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.stats import wilson

# The labels that count, those with a direction, what a rejection may be, and what an event of a pair says.
SCORED = ("GENERAL_SPECIFIC", "CONFLICT", "DUPLICATE", "REFERENCE")
DIRECTED = ("GENERAL_SPECIFIC", "REFERENCE")
INVALID = ("malformed", "unknown_pair", "duplicate_id", "invalid_label", "bad_span", "ungrounded_span", "missing_direction", "duplicate_value_mismatch", "conflict_same_span", "reference_explicit", "citation_invalid")
EVENT_CLASS = {
    "model_unrelated": "classifier_unrelated",
    "abstained": "classifier_abstained",
    "validator_reject": "validation_reject",
    "citation_reject": "citation_reject",
    "no_answer": "no_answer",
    "not_sent": "not_sent",
    "candidate_miss": "candidate_miss",
    "accepted": "missing_prediction_after_acceptance",
}
LEAST_PER_LABEL, LEAST_BOUND = 60, 0.85


def _layer(rows: DataFrame, layer: str, label: str | None = None, direction: str | None = None) -> DataFrame:
    got = {"label": label, "direction": direction, "doc_id": "doc_id" if "doc_id" in rows.columns else None, "place": "place" if "place" in rows.columns else None}
    kinds = {"place": "long"}
    cols = {c: (F.col(s) if s else F.lit(None)).cast(kinds.get(c, "string")) for c, s in got.items()}
    return rows.where("pair_id IS NOT NULL").select("trial", F.col("pair_id").cast("string").alias("pair_id"), cols["doc_id"].alias("doc_id"), F.lit(layer).alias("layer"), cols["label"].alias("label"), cols["direction"].alias("direction"), cols["place"].alias("place"))


def _layers(gold: DataFrame, candidates: DataFrame, predictions: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each (trial, pair_id) that any layer names: what each says of it, from one aggregate over their union.

    Of several predictions or events of a pair the one with the smallest place counts; the others are counted.
    """
    known = events.where(F.col("outcome").isin(*EVENT_CLASS) & (F.col("phase").isNull() | F.col("phase").isin("candidate", "classifier")))
    rows = _layer(gold, "gold", "label", "direction").unionByName(_layer(candidates, "candidate")).unionByName(_layer(predictions, "prediction", "label", "direction")).unionByName(_layer(known, "event", "outcome"))
    said = F.struct("place", "label", "direction", "doc_id")
    one = lambda name: F.min(F.when(F.col("layer") == name, said))
    n = lambda name: F.count_if(F.col("layer") == name)
    return rows.groupBy("trial", "pair_id").agg(one("gold").alias("gold"), one("candidate").alias("candidate"), one("prediction").alias("prediction"), one("event").alias("event"), n("prediction").alias("n_predictions"), n("event").alias("n_events"))


def diagnose(gold: DataFrame, candidates: DataFrame, predictions: DataFrame, events: DataFrame, traces: DataFrame, trials: DataFrame) -> DataFrame:
    """(trial, pair_id, doc_id, gold_label, prediction_label, failure_class, evidence_scope): the first layer at which each gold pair of a scored label was lost.

    gold, predictions: trial, pair_id, label, direction (gold: doc_id, predictions: place); candidates: trial, pair_id,
    doc_id; events: trial, pair_id, place, phase, outcome; traces: trial, doc_id, failed; trials: trial, over_budget,
    rejected (map of code to count). A pair that isn't a candidate is a candidate_miss; one without a prediction is what
    its event says, else what is known of its document (a failed call) or of the trial (unrelated or invalid answers,
    the budget), in that order and with the scope it was read from; one with a prediction has a wrong label, a wrong
    direction (where the label has one and gold states it) or is correct. Pairs without an id and other labels are left
    out. One shuffle of the layers' union by pair; documents meet the failed ones, trials their own row.
    """
    got = _layers(gold, candidates, predictions, events).where(F.col("gold.label").isin(*SCORED))
    got = got.withColumn("doc_id", F.coalesce("gold.doc_id", "candidate.doc_id"))
    bad = traces.where("failed").select("trial", F.col("doc_id").cast("string").alias("doc_id"), F.lit(True).alias("_failed")).where("doc_id <> ''").distinct()
    counts = lambda codes: F.aggregate(F.array(*[F.coalesce(F.try_element_at("rejected", F.lit(c)), F.lit(0)).cast("long") for c in codes]), F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)))
    told = trials.select("trial", F.coalesce("over_budget", F.lit(False)).alias("_budget"), (counts(["unrelated"]) > 0).alias("_unrelated"), (counts(INVALID) > 0).alias("_invalid"))
    got = got.join(bad, ["trial", "doc_id"], "left").join(told, "trial", "left")
    by_event = F.create_map(*[F.lit(x) for kv in EVENT_CLASS.items() for x in kv])
    state = lambda c, s: F.struct(F.lit(c).alias("c"), F.lit(s).alias("s"))
    same_way = ~F.col("gold.label").isin(*DIRECTED) | F.col("gold.direction").isNull() | F.nullif(F.col("gold.direction"), F.lit("")).eqNullSafe(F.nullif(F.col("prediction.direction"), F.lit("")))
    found = (
        F.when(F.col("candidate").isNull(), F.struct(F.lit("candidate_miss").alias("c"), F.lit("pair").alias("s")))
        .when(F.col("prediction").isNotNull() & ~F.col("prediction.label").eqNullSafe(F.col("gold.label")), state("classifier_wrong_label", "pair"))
        .when(F.col("prediction").isNotNull() & ~same_way, state("classifier_wrong_direction", "pair"))
        .when(F.col("prediction").isNotNull(), state("correct", "pair"))
        .when(F.col("event").isNotNull(), F.struct(by_event[F.col("event.label")].alias("c"), F.lit("pair").alias("s")))
        .when(F.col("_failed"), state("unclassified_or_provider", "provider_or_budget"))
        .when(F.col("_unrelated"), state("classifier_unrelated", "aggregate_rejection"))
        .when(F.col("_invalid"), state("validation_reject", "aggregate_rejection"))
        .when(F.col("_budget"), state("unclassified_or_provider", "provider_or_budget"))
        .otherwise(state("unclassified_or_provider", "unclassified"))
    )
    return got.withColumn("_f", found).select("trial", "pair_id", "doc_id", F.col("gold.label").alias("gold_label"), F.col("prediction.label").alias("prediction_label"), F.col("_f.c").alias("failure_class"), F.col("_f.s").alias("evidence_scope"))


def accounts(gold: DataFrame, candidates: DataFrame, predictions: DataFrame, events: DataFrame, trials: DataFrame) -> DataFrame:
    """One row a trial: where its candidates went, false duplicates, and hard_stops (sorted names of what makes its figures unusable).

    residual: candidates less predictions of candidates less rejections; below 0 the accounts don't match. A DUPLICATE
    on a pair whose gold says otherwise is observed, on one without gold unreviewed. A trial without layers has zeros.
    """
    got = _layers(gold, candidates, predictions, events)
    has = lambda c: F.col(c).isNotNull()
    scored = has("gold") & F.coalesce(F.col("gold.label").isin(*SCORED), F.lit(False))
    copy = F.coalesce(F.col("prediction.label") == "DUPLICATE", F.lit(False))
    sent = has("event") & (F.col("event.label") != "candidate_miss")
    sums = got.groupBy("trial").agg(
        F.count_if(has("candidate")).alias("candidate_total"), F.count_if(has("candidate") & has("prediction")).alias("predicted_in_candidates"), F.count_if(~has("candidate") & has("prediction")).alias("unknown_predictions"),
        F.count_if(has("candidate") & sent).alias("terminal_events"), F.count_if(has("candidate") & ~F.coalesce(sent, F.lit(False))).alias("terminal_missing"), F.count_if(~has("candidate") & sent).alias("terminal_extra"),
        F.count_if(copy & scored & (F.col("gold.label") != "DUPLICATE")).alias("false_duplicates"), F.count_if(copy & ~scored).alias("unreviewed_duplicates"),
        F.sum(F.greatest(F.col("n_predictions") - 1, F.lit(0))).alias("duplicate_predictions"), F.sum(F.greatest(F.col("n_events") - 1, F.lit(0))).alias("duplicate_events"),
    )
    names = [c for c in sums.columns if c != "trial"]
    out = trials.select("trial", F.aggregate(F.map_values(F.coalesce("rejected", F.create_map().cast("map<string,long>"))), F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.coalesce(x, F.lit(0)).cast("long"), F.lit(0))).alias("rejected_total"))
    out = out.join(sums, "trial", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names}).withColumn("residual", F.expr("candidate_total - predicted_in_candidates - rejected_total"))
    stops = {"candidate_accounting_mismatch": "residual < 0", "duplicate_pair_event_id": "duplicate_events > 0", "duplicate_prediction_id": "duplicate_predictions > 0", "false_duplicate": "false_duplicates + unreviewed_duplicates > 0"}
    return out.withColumn("hard_stops", F.array_compact(F.array(*[F.when(F.expr(e), F.lit(s)) for s, e in stops.items()])))


def verdicts(results: DataFrame, least: int = LEAST_PER_LABEL, floor: float = LEAST_BOUND, labels: tuple[str, ...] = SCORED) -> DataFrame:
    """(variant, verdict, worst): a recommendation from counts alone. results: variant, trial, label, passed, denominator, weighted, cluster_lower, false_duplicates, over_budget.

    In this order: a false duplicate keeps it off; so do too few cases of any label (a label without a row has none);
    a trial over its budget, or a label under the floor whose weighted precision reaches it and exceeds the plain one,
    is a human's decision; a label whose Wilson bound misses the floor keeps it off; a bound by clusters that does is a
    human's decision; else it is a candidate. worst: the label of the lowest bound, the first by name of equals. Budgets
    of all variants count, as they share a run.
    """
    low = wilson(F.col("passed"), F.col("denominator"), z=1.96)["low"]
    rows = results.where(F.col("label").isin(*labels)).withColumn("_low", F.when(F.col("denominator") > 0, low).otherwise(0.0))
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    under: Column = (F.col("_low") < floor) | (F.col("denominator") < least)
    by_label = rows.groupBy("variant", "label").agg(
        F.min("denominator").alias("n"), F.min("_low").alias("low"), any_(under).alias("under"), any_((F.col("weighted") >= floor) & (F.col("weighted") > F.col("passed") / F.nullif(F.col("denominator"), F.lit(0)))).alias("differs"),
        F.min(F.coalesce("cluster_lower", F.lit(0.0))).alias("cluster"), F.sum("false_duplicates").alias("dups"),
    )
    got = by_label.groupBy("variant").agg(
        F.sum("dups").alias("dups"), (any_(F.col("n") < least) | (F.count("*") < len(labels))).alias("few"), any_(F.col("under") & F.col("differs")).alias("differs"), any_(F.col("under")).alias("under"), any_(F.col("cluster") < floor).alias("loose"),
        F.min(F.struct("low", "label"))["label"].alias("worst"),
    )
    budget = results.agg(F.coalesce(F.bool_or("over_budget"), F.lit(False)).alias("budget"))
    got = got.crossJoin(F.broadcast(budget))  # one row
    human = F.lit("HUMAN_DECISION")
    verdict = F.when(F.col("dups") > 0, "KEEP_OFF_FALSE_DUPLICATE").when(F.col("few"), "KEEP_OFF_INSUFFICIENT_N").when(F.col("budget") | F.col("differs"), human).when(F.col("under"), "KEEP_OFF_BELOW_THRESHOLD").when(F.col("loose"), human).otherwise("ENABLE_CANDIDATE")
    return got.select("variant", verdict.alias("verdict"), "worst")
