"""Trials of a classifier over pairs: orders are the reviewed pairs, their lines the predictions and events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import stats as S
from folioforge.operators import trials as TR
from folioforge.plans.catalog import query, read
from folioforge.plans.scalars import fold_sql

_LABELS = ("GENERAL_SPECIFIC", "CONFLICT", "DUPLICATE", "REFERENCE", "UNRELATED")
_OUTCOMES = (*TR.EVENT_CLASS, "queued", "sent")


def _pick(values: tuple[str, ...], n: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(n) % len(values) + 1).cast("int"))


def _inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    o = read(spark, sf, "orders").withColumnsRenamed({"o_orderstatus": "trial", "o_orderkey": "pair_id", "o_custkey": "doc_id"})
    li = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "pair_id").join(o.select("trial", "pair_id"), "pair_id")
    way = lambda c: F.when(F.expr(c), "A_TO_B")
    trials = o.groupBy("trial").agg(F.count_if(F.expr("o_totalprice > 200000")).alias("n"), F.count_if(F.expr("pair_id % 7 = 0")).alias("m"))
    return {
        "gold": o.select("trial", "pair_id", "doc_id", _pick(_LABELS, "pair_id").alias("label"), way("o_orderpriority < '3'").alias("direction")),
        "candidates": o.where("o_totalprice > 60000").select("trial", "pair_id", "doc_id"),
        "predictions": li.where("l_quantity > 35").select("trial", "pair_id", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"), _pick(_LABELS, "pair_id + (l_linenumber % 3) div 2").alias("label"), way("l_suppkey % 2 = 0").alias("direction")),
        "events": li.where("l_quantity < 12").select("trial", "pair_id", F.col("l_partkey").alias("place"), F.when(F.expr("l_linenumber % 3 = 1"), "classifier").when(F.expr("l_linenumber % 3 = 2"), "render").alias("phase"), _pick(_OUTCOMES, "l_partkey").alias("outcome")),
        "traces": o.select("trial", "doc_id", (F.col("o_totalprice") > 280000).alias("failed")),
        "trials": trials.select("trial", (F.col("trial") == "P").alias("over_budget"), F.when(F.col("trial") == "F", F.create_map(F.lit("unrelated"), "n", F.lit("late"), "m")).when(F.col("trial") == "O", F.create_map(F.lit("malformed"), "m")).alias("rejected")),
    }


def _pick_sql(values: tuple[str, ...], n: str) -> str:
    return f"list_extract({list(values)!r}, (({n}) % {len(values)} + 1)::INT)"


_LAYERS = f"""WITH o AS (SELECT o_orderstatus trial, o_orderkey p, o_custkey::VARCHAR d, o_totalprice, {_pick_sql(_LABELS, "o_orderkey")} lab, CASE WHEN o_orderpriority < '3' THEN 'A_TO_B' END dir FROM orders),
pr AS (SELECT p, min({{'place': l_linenumber * 1000000 + l_partkey, 'lab': {_pick_sql(_LABELS, "l_orderkey + (l_linenumber % 3) // 2")}, 'none': l_suppkey % 2 = 0}}) x, count(*) n FROM lineitem JOIN o ON p = l_orderkey WHERE l_quantity > 35 GROUP BY 1),
ev AS (SELECT p, min({{'place': l_partkey, 'out': {_pick_sql(_OUTCOMES, "l_partkey")}}}) x, count(*) n FROM lineitem JOIN o ON p = l_orderkey WHERE l_quantity < 12 AND l_linenumber % 3 <> 2 AND l_partkey % 10 < 8 GROUP BY 1),
bad AS (SELECT DISTINCT trial, d FROM o WHERE o_totalprice > 280000),
tr AS (SELECT trial, trial = 'P' over_budget, CASE trial WHEN 'F' THEN count(*) FILTER (o_totalprice > 200000) ELSE 0 END unrelated, CASE trial WHEN 'O' THEN count(*) FILTER (p % 7 = 0) ELSE 0 END invalid, CASE trial WHEN 'F' THEN count(*) FILTER (o_totalprice > 200000) + count(*) FILTER (p % 7 = 0) WHEN 'O' THEN count(*) FILTER (p % 7 = 0) ELSE 0 END rejected FROM o GROUP BY 1),
j AS (SELECT o.*, o_totalprice > 60000 cand, pr.x.lab plab, CASE WHEN pr.x.none THEN 'A_TO_B' END pdir, coalesce(pr.n, 0) n_pred, ev.x.out outcome, coalesce(ev.n, 0) n_ev, bad.d IS NOT NULL failed FROM o LEFT JOIN pr USING (p) LEFT JOIN ev USING (p) LEFT JOIN bad USING (trial, d))
"""
_EVENTS = "CASE outcome " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TR.EVENT_CLASS.items()) + " END"


@query(
    _LAYERS
    + f"""SELECT j.trial, p::VARCHAR AS pair_id, d AS doc_id, lab AS gold_label, plab AS prediction_label,
  CASE WHEN NOT cand THEN 'candidate_miss' WHEN plab <> lab THEN 'classifier_wrong_label' WHEN plab IS NOT NULL AND lab IN ('GENERAL_SPECIFIC', 'REFERENCE') AND dir IS NOT NULL AND dir IS DISTINCT FROM pdir THEN 'classifier_wrong_direction' WHEN plab IS NOT NULL THEN 'correct'
    WHEN outcome IS NOT NULL THEN {_EVENTS} WHEN failed THEN 'unclassified_or_provider' WHEN unrelated > 0 THEN 'classifier_unrelated' WHEN invalid > 0 THEN 'validation_reject' ELSE 'unclassified_or_provider' END AS failure_class,
  CASE WHEN NOT cand OR plab IS NOT NULL OR outcome IS NOT NULL THEN 'pair' WHEN failed THEN 'provider_or_budget' WHEN unrelated > 0 OR invalid > 0 THEN 'aggregate_rejection' WHEN over_budget THEN 'provider_or_budget' ELSE 'unclassified' END AS evidence_scope
FROM j JOIN tr USING (trial) WHERE lab <> 'UNRELATED'"""
)
def trial_losses(spark: SparkSession, sf: str) -> DataFrame:
    return TR.diagnose(**_inputs(spark, sf))


@query(
    _LAYERS
    + """, s AS (SELECT trial, count(*) FILTER (cand) candidate_total, count(*) FILTER (cand AND plab IS NOT NULL) predicted_in_candidates, count(*) FILTER (NOT cand AND plab IS NOT NULL) unknown_predictions,
  count(*) FILTER (cand AND outcome <> 'candidate_miss') terminal_events, count(*) FILTER (cand AND (outcome IS NULL OR outcome = 'candidate_miss')) terminal_missing, count(*) FILTER (NOT cand AND outcome <> 'candidate_miss') terminal_extra,
  count(*) FILTER (plab = 'DUPLICATE' AND lab NOT IN ('DUPLICATE', 'UNRELATED')) false_duplicates, count(*) FILTER (plab = 'DUPLICATE' AND lab = 'UNRELATED') unreviewed_duplicates,
  sum(greatest(n_pred - 1, 0))::BIGINT duplicate_predictions, sum(greatest(n_ev - 1, 0))::BIGINT duplicate_events FROM j GROUP BY 1)
SELECT s.*, rejected AS rejected_total, candidate_total - predicted_in_candidates - rejected AS residual, concat_ws(',', CASE WHEN candidate_total - predicted_in_candidates - rejected < 0 THEN 'candidate_accounting_mismatch' END, CASE WHEN duplicate_events > 0 THEN 'duplicate_pair_event_id' END,
  CASE WHEN duplicate_predictions > 0 THEN 'duplicate_prediction_id' END, CASE WHEN false_duplicates + unreviewed_duplicates > 0 THEN 'false_duplicate' END) AS hard_stops FROM s JOIN tr USING (trial)"""
)
def trial_accounts(spark: SparkSession, sf: str) -> DataFrame:
    t = _inputs(spark, sf)
    t.pop("traces")
    return TR.accounts(**t).withColumn("hard_stops", F.array_join("hard_stops", ","))


_WORDS = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"


@query(
    rf"""WITH w AS (SELECT doc_id, unnest({_WORDS}) t FROM documents), k AS (SELECT doc_id, t, regexp_replace({fold_sql("replace(t, 'x', '')")}, '[^\p{{L}}]', '', 'g') b, length(t) - length(replace(t, 'a', '')) n FROM w)
SELECT doc_id, sum(n)::BIGINT AS errors, sum(length(b))::BIGINT AS letters FROM k GROUP BY 1"""
)
def mark_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts in lines of twenty words against a reading that gives each small a a mark and loses each small x."""
    from folioforge.operators.reconstruct import paged

    lines = paged(read(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc").alias("doc_id"), "text")
    read_as = lines.withColumn("hypothesis", F.translate("text", "ax", "á"))
    got = S.mark_error_rates(read_as, "text", "hypothesis")
    return got.groupBy("doc_id").agg(F.sum("marks.errors").alias("errors"), F.sum("marks.letters").alias("letters"))


_Z2 = "1.96 * 1.96"


@query(
    f"""WITH r AS (SELECT l_returnflag variant, l_linestatus trial, {_pick_sql(_LABELS[:4], "l_partkey")} lab, count(*) FILTER (l_discount < 0.09 OR l_returnflag = 'A') k, count(*) n, bool_or(l_tax > 1) b FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT *, k / n::DOUBLE p, greatest(0, (k / n::DOUBLE + {_Z2} / (2 * n) - 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + {_Z2} / (4.0 * n * n))) / (1 + {_Z2} / n)) low FROM r),
g AS (SELECT variant, lab, min(n) n, min(low) low, bool_or(low < 0.85 OR n < 60) under FROM w GROUP BY 1, 2)
SELECT variant, CASE WHEN min(n) < 60 OR count(*) < 4 THEN 'KEEP_OFF_INSUFFICIENT_N' WHEN bool_or(under) THEN 'KEEP_OFF_BELOW_THRESHOLD' ELSE 'ENABLE_CANDIDATE' END AS verdict, arg_min(lab, {{'low': low, 'lab': lab}}) AS worst FROM g GROUP BY 1"""
)
def trial_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Flags as variants, statuses as trials: lines of a label that pass by their discount, those of one flag always."""
    li = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("trial"), _pick(_LABELS[:4], "l_partkey").alias("label"), F.expr("l_discount < 0.09 OR l_returnflag = 'A'").alias("ok"), F.expr("l_tax > 1").alias("b"))
    got = li.groupBy("variant", "trial", "label").agg(F.count_if("ok").alias("passed"), F.count("*").alias("denominator"), F.bool_or("b").alias("over_budget"))
    return TR.verdicts(got.withColumns({"weighted": F.lit(None).cast("double"), "cluster_lower": F.lit(1.0), "false_duplicates": F.lit(0)}))
