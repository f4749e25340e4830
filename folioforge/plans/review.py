"""Reviews, versions, logs and gates: operators over orders, lines and events, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import access as A
from folioforge.operators import compare as C
from folioforge.operators import events as E
from folioforge.operators import relational as R
from folioforge.operators import stats as S
from folioforge.plans.catalog import query, read


@query("SELECT user_id, event_id, event_type, ts, n_actions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r, count(*) OVER (PARTITION BY user_id) n_actions FROM events) WHERE r = 1")
def last_action_with_count(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_with_count(read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["-ts", "-event_id"], "n_actions")


@query("SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) WHERE r = 1")
def latest_price(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_value(read(spark, sf, "orders"), ["o_custkey"], "o_totalprice", ["o_orderdate", "o_orderkey"])


@query(
    "WITH a AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r, count(*) OVER (PARTITION BY o_custkey) n FROM orders) "
    "SELECT c_custkey AS fact_id, c_acctbal AS value, coalesce(o_totalprice, c_acctbal) AS effective_value, coalesce(n, 0)::BIGINT AS version FROM customer LEFT JOIN a ON o_custkey = c_custkey AND r = 1"
)
def effective_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with the value of their latest review and the count of reviews, 0 where there are none."""
    facts = read(spark, sf, "customer").selectExpr("c_custkey AS fact_id", "c_acctbal AS value")
    actions = read(spark, sf, "orders").selectExpr("o_custkey AS fact_id", "o_totalprice AS corrected_value", "o_orderdate AS created_at", "o_orderkey AS action_id")
    return R.effective_values(facts, actions)


@query(
    "WITH d AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderkey % 40 NOT IN (SELECT n_nationkey FROM nation)) SELECT c_custkey AS answer_id, k IS NOT NULL AS withheld, CASE WHEN k IS NULL THEN c_name END AS text FROM customer LEFT JOIN d ON k = c_custkey"
)
def answers_withheld(spark: SparkSession, sf: str) -> DataFrame:
    """An answer is withheld if any of its citations names a document that isn't allowed."""
    answers = read(spark, sf, "customer").selectExpr("c_custkey AS answer_id", "c_name AS text")
    citations = read(spark, sf, "orders").selectExpr("o_custkey AS answer_id", "o_orderkey % 40 AS document_id")
    return R.any_drop_withholds(answers, citations, read(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS document_id"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS n_open, count(*) FILTER (o_totalprice > 100000)::BIGINT AS n_large, count(*) FILTER (o_orderpriority LIKE '1%')::BIGINT AS n_urgent FROM orders GROUP BY 1")
def open_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.conditional_counts(read(spark, sf, "orders"), ["o_custkey"], {"n_open": F.expr("o_orderstatus = 'O'"), "n_large": F.expr("o_totalprice > 100000"), "n_urgent": F.expr("o_orderpriority LIKE '1%'")})


@query(
    "WITH old AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_custkey, -o_orderkey AS o_orderkey FROM orders WHERE o_orderkey % 7 = 0) SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new) UNION ALL SELECT * FROM new"
)
def replaced_groups(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return R.replace_groups(o.where("o_orderkey % 3 <> 0").select("o_custkey", "o_orderkey"), o.where("o_orderkey % 7 = 0").selectExpr("o_custkey", "-o_orderkey AS o_orderkey"), ["o_custkey"])


@query(
    "WITH u AS (SELECT o_custkey k, o_orderkey % 50 v, 0 n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey % 50, 1 FROM orders WHERE o_orderkey % 2 = 1) SELECT k AS snapshot_id, v AS version, n AS is_new FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, n DESC) r FROM u) WHERE r = 1"
)
def newest_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert that keeps the greatest version of each key; a new row wins a tie."""
    o = read(spark, sf, "orders")
    side = lambda x: o.where(f"o_orderkey % 2 = {x}").selectExpr("o_custkey AS snapshot_id", "o_orderkey % 50 AS version", f"{x} AS is_new")
    return R.keep_latest_upsert(side(0), side(1), ["snapshot_id"], "version")


@query(
    "WITH now AS (SELECT o_custkey k, count(*) v FROM orders GROUP BY 1) SELECT c_custkey AS fact_id, c_custkey % 12 AS base, coalesce(v, 0) = c_custkey % 12 AS accepted FROM customer LEFT JOIN now ON k = c_custkey"
)
def versioned_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Actions with the version that they were made on: accepted if it is the current one."""
    now = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("fact_id")).agg(F.count("*").alias("version"))
    ok, conflict = R.versioned_append(now, read(spark, sf, "customer").selectExpr("c_custkey AS fact_id", "c_custkey % 12 AS base"), "fact_id", "version", "base")
    return ok.withColumn("accepted", F.lit(True)).unionByName(conflict.withColumn("accepted", F.lit(False)))


@query("SELECT DISTINCT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey OR s_suppkey % 25 = n_nationkey")
def actor_or_owner(spark: SparkSession, sf: str) -> DataFrame:
    """A join on either of two keys, a pair once."""
    s = read(spark, sf, "supplier").selectExpr("s_suppkey", "CAST(s_nationkey AS BIGINT) AS k1", "s_suppkey % 25 AS k2")
    return R.split_or_join(read(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS n_nationkey"), s, [("n_nationkey", "k1"), ("n_nationkey", "k2")], "s_suppkey").select("n_nationkey", "s_suppkey")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def purged_events(spark: SparkSession, sf: str) -> DataFrame:
    gone = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return R.purge(read(spark, sf, "events").select("event_id", "user_id"), gone, ["user_id"])


# ---- event logs --------------------------------------------------------------------------------------------------------


@query("SELECT k, event_id FROM (SELECT user_id::VARCHAR || event_type k, event_id, row_number() OVER (PARTITION BY user_id::VARCHAR || event_type ORDER BY ts, event_id) r FROM events) WHERE r = 1 AND k NOT IN (SELECT user_id::VARCHAR || event_type FROM events WHERE value > 98)")
def unprocessed_events(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each key that the ledger doesn't have."""
    e = read(spark, sf, "events").selectExpr("concat(CAST(user_id AS STRING), event_type) AS k", "event_id", "ts", "value")
    return E.unprocessed(E.once(e, "k", ["ts", "event_id"]), e.where("value > 98").select("k"), "k").select("k", "event_id")


@query(
    "WITH s AS (SELECT user_id, max(event_id) snap FROM events WHERE event_id % 10 = 0 GROUP BY 1), r AS (SELECT e.user_id, e.event_id, greatest(coalesce(snap, 0), 200) AS f FROM events e LEFT JOIN s USING (user_id)), x AS (SELECT *, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), f) d FROM r WHERE event_id > f) "
    "SELECT user_id, event_id, max(d) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS contiguous FROM x"
)
def replayed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events behind the snapshot or the cursor, and whether they follow each other from there."""
    e = read(spark, sf, "events").select("user_id", "event_id")
    snaps = e.where("event_id % 10 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return E.replay(e, snaps, "user_id", "event_id", F.lit(200))


@query("SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN event_id % 7 WHEN 'error' THEN -1 ELSE 0 END)::BIGINT AS state FROM events GROUP BY 1")
def folded_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run's state by rules for each kind of event, in order."""
    e = read(spark, sf, "events").selectExpr("user_id", "event_id", "event_type", "event_id % 7 AS amount")
    return E.fold_events(e, "user_id", "event_id", "event_type", "amount", {"purchase": lambda acc, v: acc + v, "error": lambda acc, v: acc - 1}, F.lit(0).cast("long"))


@query(
    "WITH s AS (SELECT user_id, event_id % 3 AS execution_id, event_type AS stage, CASE WHEN value > 50 THEN 'STARTED' WHEN value > 25 THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status FROM events), k AS (SELECT user_id, execution_id, stage FROM s WHERE status = 'STARTED' EXCEPT SELECT user_id, execution_id, stage FROM s WHERE status = 'SUCCEEDED') SELECT * FROM k"
)
def open_stages(spark: SparkSession, sf: str) -> DataFrame:
    return E.open_stages(_stages(spark, sf), ["user_id"]).select("user_id", "execution_id", "stage")


def _stages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr("user_id", "event_id", "event_id % 3 AS execution_id", "event_type AS stage", "CASE WHEN value > 50 THEN 'STARTED' WHEN value > 25 THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status")


@query(
    "WITH s AS (SELECT user_id, event_id, event_id % 3 AS execution_id, event_type AS stage, CASE WHEN value > 50 THEN 'STARTED' WHEN value > 25 THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status FROM events), f AS (SELECT user_id, arg_min(execution_id, event_id) execution_id FROM s GROUP BY 1), l AS (SELECT user_id, stage, arg_max(status, event_id) status FROM s JOIN f USING (user_id, execution_id) GROUP BY 1, 2) "
    "SELECT user_id, stage, CASE WHEN user_id % 3 = 0 AND status IN ('STARTED', 'RUNNING') THEN 'INCOMPLETE_UNKNOWN' ELSE status END AS status FROM l"
)
def processing_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each stage of the first execution; what runs in a job that has ended is unknown."""
    s = _stages(spark, sf)
    return E.processing_trace(s, ["user_id"], "event_id", s.where("user_id % 3 = 0"))


@query(
    "WITH f AS (SELECT o_custkey run FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT event_id, user_id, user_id NOT IN (SELECT run FROM f) AS applied FROM events"
)
def late_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of failed runs are audited and never applied."""
    runs = read(spark, sf, "orders").selectExpr("o_custkey AS user_id", "CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'DONE' END AS status")
    go, audit = E.late_results(read(spark, sf, "events").select("event_id", "user_id"), runs, "user_id")
    return go.withColumn("applied", F.lit(True)).unionByName(audit.withColumn("applied", F.lit(False)))


@query("SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS digest FROM lineitem JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END d FROM orders WHERE o_orderkey % 2 = 1) ON o_orderkey = l_orderkey WHERE l_linenumber % 2 <> 0 OR l_returnflag = d")
def recorded_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results that are recorded already, with no digest or the same one."""
    results = read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS digest")
    held = read(spark, sf, "orders").where("o_orderkey % 2 = 1").selectExpr("o_orderkey AS l_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END AS digest")
    return E.recorded_results(results, held, ["l_orderkey"], "digest")


@query("SELECT event_id, event_type, ts FROM events WHERE user_id % 4 = 1 AND event_id % 3 = 2 AND event_type IN ('click', 'purchase')")
def public_run_events(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").selectExpr("*", "CAST(user_id % 4 AS STRING) AS tenant_id", "CAST(event_id % 3 AS STRING) AS run_id", "'r' AS resource_id")
    return E.public_events(E.scoped(e, "1", "2", "r"), ["click", "purchase"], ["event_id", "event_type", "ts"])


@query("SELECT event_id, sha256(props) AS digest, length(props) > 12 AS cut FROM events WHERE value < 10")
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Records that can't be handled, with the value's digest; a long value becomes a pointer."""
    d = E.dead_letters(read(spark, sf, "events").select("event_id", "value", "props"), F.expr("value < 10"), "props", longest=12)
    return d.select("event_id", F.col("value_sha256").alias("digest"), F.col("value_pointer").isNotNull().alias("cut"))


@query(
    "WITH g AS (SELECT event_id, event_type, user_id, value, event_id % 4 AS s FROM events) SELECT event_id, event_type = 'error' OR user_id % 600 IN (408, 425, 429, 500, 502, 503, 504) AS retry, s = 0 OR (s = 1 AND value <= 50) AS due, "
    "CASE s WHEN 0 THEN value <= 50 WHEN 1 THEN value <= 50 AND value + 5 <= 50 WHEN 2 THEN value <= 45 ELSE false END AS expired, CASE s WHEN 0 THEN value <= 50 WHEN 1 THEN CASE WHEN event_id % 8 = 1 THEN value <= 50 ELSE value + 10 <= 50 END ELSE false END AS stale, CASE WHEN s = 0 THEN 't:' || user_id || ':' || event_id ELSE event_type END AS k FROM g"
)
def lease_states(spark: SparkSession, sf: str) -> DataFrame:
    """Retries, due outbox rows, expired sessions, stale jobs and event keys, from one event."""
    v, s, now = F.col("value").cast("double"), F.col("event_id") % 4, F.lit(50.0)
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (s + 1).cast("int"))
    return read(spark, sf, "events").select(
        "event_id",
        A.is_retryable(F.when(F.col("event_type") == "error", "ConnectionError"), F.col("user_id") % 600, F.lit(None).cast("boolean")).alias("retry"),
        A.outbox_is_due(pick("PENDING", "CLAIMED", "DONE", "DONE"), v, now).alias("due"),
        A.session_is_expired(pick("OPEN", "COMPLETING", "COMPLETED", "X"), v, v, now, 5, 5).alias("expired"),
        A.is_stale(pick("RUNNING", "QUEUED", "DONE", "DONE"), F.when((s == 0) | (F.col("event_id") % 8 == 1), v), v, now, 10).alias("stale"),
        A.event_key(F.when(s != 0, F.col("event_type")), F.lit("t"), F.col("user_id"), F.col("event_id")).alias("k"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN least(l_discount * 10, 1 - l_tax) ELSE least(l_discount * 10, 1 - l_tax, 0.7) END AS confidence FROM lineitem"
)
def fact_confidences(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", A.fact_confidence(F.col("l_discount") * 10, F.array(1 - F.col("l_tax"), F.lit(None).cast("double")), F.col("l_returnflag") == "R").alias("confidence"))


# ---- gates -------------------------------------------------------------------------------------------------------------


@query(
    "WITH g AS (SELECT o_orderpriority metric, count(*) n, count(*) FILTER (o_orderstatus <> 'F') k, count(*) - count(DISTINCT o_orderkey) d FROM orders GROUP BY 1), s AS (SELECT DISTINCT o_orderpriority metric, 0.5::DOUBLE t FROM orders UNION ALL SELECT 'none', 0.5) SELECT metric, coalesce(n, 0)::BIGINT AS n, coalesce(k, 0)::BIGINT AS k, CASE WHEN coalesce(d, 0) > 0 THEN 'DUPLICATE_UNITS' WHEN coalesce(n, 0) = 0 THEN 'NOT_RUN' WHEN k / n::DOUBLE < t THEN 'FAIL' WHEN n < 60 THEN 'UNDERPOWERED' ELSE 'PASS' END AS state FROM s LEFT JOIN g USING (metric)"
)
def metric_states(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").selectExpr("o_orderpriority AS metric", "o_orderkey AS unit_id", "o_orderstatus <> 'F' AS passed")
    specs = o.select("metric").distinct().unionByName(spark.createDataFrame([("none",)], "metric string")).withColumn("threshold", F.lit(0.5))
    return S.evaluate_metrics(o, specs).select("metric", "n", "k", "state")


@query("SELECT DISTINCT o_orderpriority AS metric FROM orders WHERE o_orderpriority NOT LIKE '1%'")
def undeclared_metrics(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").selectExpr("o_orderpriority AS metric")
    return S.undeclared(o, o.where("metric LIKE '1%'").distinct())


@query("SELECT max(CASE WHEN o_totalprice > 150000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) >= 2 AS failed FROM orders")
def overall_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The worst of all states closes the gate."""
    m = read(spark, sf, "orders").selectExpr("CASE WHEN o_totalprice > 150000 THEN 'FAIL' WHEN o_totalprice > 100000 THEN 'UNDERPOWERED' ELSE 'PASS' END AS state")
    return S.overall_state(m).select((F.col("overall") == "FAIL").alias("failed"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000)::BIGINT AS n_pass, count(*) FILTER (o_totalprice <= 100000)::BIGINT AS n_fail FROM orders GROUP BY 1, 2")
def pass_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.pass_report(read(spark, sf, "orders").withColumn("passed", F.expr("o_totalprice > 100000")), "o_orderpriority", "o_orderstatus", "passed")


@query(
    "WITH b AS (SELECT o_custkey i, bool_and(o_totalprice > 50000) w FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_custkey i, bool_and(o_totalprice > 80000) n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT i AS item, CASE WHEN w IS NULL THEN 'NEW_FAILURE' ELSE 'REGRESSION' END AS kind FROM c LEFT JOIN b USING (i) WHERE NOT n AND (w IS NULL OR w)"
)
def new_failures(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    run = lambda x, most: o.where(f"o_orderkey % 2 = {x}").selectExpr("o_custkey AS item", f"o_totalprice > {most} AS passed")
    return S.regressions(run(0, 50000), run(1, 80000), "item", "passed")


@query(
    "SELECT count(*) AS n, count(*) FILTER (NOT a AND b)::BIGINT AS improved, count(*) FILTER (a AND NOT b)::BIGINT AS regressed, bool_and(a IS NOT NULL AND b IS NOT NULL) AS keys_equal FROM (SELECT l_orderkey, bool_or(l_discount > 0.05) a FROM lineitem GROUP BY 1) FULL JOIN (SELECT o_orderkey AS l_orderkey, o_totalprice > 100000 b FROM orders) USING (l_orderkey)"
)
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    local = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.bool_or(F.expr("l_discount > 0.05")).alias("passed"))
    return S.paired_ablation(local, read(spark, sf, "orders").selectExpr("o_orderkey AS unit", "o_totalprice > 100000 AS passed"), "unit", "passed")


@query(
    "WITH m AS (SELECT o_orderkey k, 'o' || (o_orderkey % 9) AS kase, CASE o_orderkey % 4 WHEN 0 THEN 'citations' WHEN 1 THEN 'no_leakage' WHEN 2 THEN 'blocked' ELSE 'state' END f, CASE o_orderkey % 3 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'MISMATCH' ELSE 'EXTRA' END s FROM orders), j AS (SELECT * FROM m WHERE kase <> 'o7') "
    "SELECT kase AS \"case\", CASE f WHEN 'citations' THEN 1 WHEN 'no_leakage' THEN 5 WHEN 'blocked' THEN 7 ELSE 2 END::INT AS rule_index, f AS field, count(*) AS n FROM j WHERE s = 'MISMATCH' OR (s = 'EXTRA' AND f = 'citations') GROUP BY 1, 2, 3 UNION ALL SELECT 'o7', 0, NULL, 1"
)
def release_failures(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").selectExpr("concat('o', o_orderkey % 9) AS case", "CASE o_orderkey % 4 WHEN 0 THEN 'citations' WHEN 1 THEN 'no_leakage' WHEN 2 THEN 'blocked' ELSE 'state' END AS field", "CASE o_orderkey % 3 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'MISMATCH' ELSE 'EXTRA' END AS status")
    return S.release_failures(o, spark.createDataFrame([("o7",)], "case string")).groupBy("case", "rule_index", "field").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, CASE WHEN count(*) < 60 THEN 'UNDERPOWERED' WHEN count(*) FILTER (l_discount < 0.09) / count(*)::DOUBLE > 0.8 THEN 'OPEN' ELSE 'CLOSED' END AS gate FROM lineitem GROUP BY 1")
def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.expr("l_discount < 0.09")).alias("k"))
    return g.select("l_returnflag", S.quality_gate(F.col("n"), F.col("k"), 60, 0.6).alias("gate"))


@query(
    "WITH h AS (SELECT o_custkey, substr(o_orderpriority, 1, 1) c, min(o_orderkey) f FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, count(*) n, list(c ORDER BY f) v FROM h GROUP BY 1) SELECT c_custkey, coalesce(n, 0)::BIGINT AS n, coalesce(v, []) AS values, CASE WHEN n IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN n = 1 THEN 'ANSWERED' ELSE 'NEEDS_REVIEW' END AS state FROM customer LEFT JOIN g ON o_custkey = c_custkey"
)
def legal_identities(spark: SparkSession, sf: str) -> DataFrame:
    """The identities of each customer, by the digits of what orders say: none, one, or several to be reviewed."""
    hits = read(spark, sf, "orders").selectExpr("o_custkey AS c_custkey", "o_orderpriority AS raw", "o_orderkey AS node_id", "o_orderkey AS ord")
    return C.identity_answers(read(spark, sf, "customer"), hits, ["c_custkey"], "raw", "node_id", "ord")
