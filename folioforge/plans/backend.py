"""Relational queries of the review backend on the star schema."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions.access import access_decision, grant_is_live
from folioforge.operators import events as E
from folioforge.operators import relational as R
from folioforge.operators import stats as S
from folioforge.plans.catalog import query, read


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1")
def latest_order_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return R.latest_per_group(o, ["o_custkey"], ["-o_orderdate", "-o_orderkey"])


@query(
    "SELECT c_custkey, c_name, count(*) FILTER (o_orderpriority LIKE '1%') p1, count(*) FILTER (o_orderpriority LIKE '2%') p2, count(*) FILTER (o_orderpriority LIKE '3%') p3, count(*) n_open, min(o_orderdate) first_at "
    "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1, 2 ORDER BY p1 DESC, first_at, c_custkey LIMIT 200"
)
def priority_queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The review queue: open items of each dossier by priority, joined after the aggregate, one page."""
    o = read(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority", "o_orderdate")
    k = F.col("o_orderpriority")
    got = o.groupBy("o_custkey").agg(*[F.count_if(k.startswith(str(i))).alias(f"p{i}") for i in (1, 2, 3)], F.count("*").alias("n_open"), F.min("o_orderdate").alias("first_at"))
    c = read(spark, sf, "customer").select(F.col("c_custkey"), "c_name")
    return R.page(got.join(c, got.o_custkey == c.c_custkey).drop("o_custkey"), ["-p1", "first_at", "c_custkey"], 200)


@query(
    "WITH f AS (SELECT 'order:' || o_orderkey id, o_orderdate occurred_at, 'c' || o_custkey actor, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'opened' ELSE 'pending' END title, o_orderpriority detail FROM orders "
    "UNION ALL SELECT 'event:' || event_id, ts, 'u' || user_id, event_type, props FROM events WHERE event_type NOT LIKE 'view%' "
    "UNION ALL SELECT 'ship:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, l_shipdate, 's' || l_suppkey, 'shipped', l_returnflag FROM lineitem WHERE l_returnflag = 'R') "
    "SELECT * FROM f WHERE trim(actor) <> '' ORDER BY occurred_at DESC, id LIMIT 500"
)
def activity_feed_union(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda x: x.cast("string")
    o = read(spark, sf, "orders").select(F.concat(F.lit("order:"), s(F.col("o_orderkey"))).alias("id"), F.col("o_orderdate").alias("occurred_at"), F.concat(F.lit("c"), s(F.col("o_custkey"))).alias("actor"), F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "opened").otherwise("pending").alias("title"), F.col("o_orderpriority").alias("detail"))
    e = read(spark, sf, "events").where("event_type NOT LIKE 'view%'").select(F.concat(F.lit("event:"), s(F.col("event_id"))).alias("id"), F.col("ts").alias("occurred_at"), F.concat(F.lit("u"), s(F.col("user_id"))).alias("actor"), F.col("event_type").alias("title"), F.col("props").alias("detail"))
    li = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.concat_ws(":", F.lit("ship"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_shipdate").alias("occurred_at"), F.concat(F.lit("s"), s(F.col("l_suppkey"))).alias("actor"), F.lit("shipped").alias("title"), F.col("l_returnflag").alias("detail"))
    return R.page(R.union_feed([o, e, li]).where("trim(actor) <> ''"), ["-occurred_at", "id"], 500)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)")
def orders_visible(spark: SparkSession, sf: str) -> DataFrame:
    gone = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.without(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), gone, ["o_custkey"])


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 100")
def events_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.keyset_page(read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), "event_id", 1000, 100)


@query("SELECT user_id, a AS after, event_id AS before, event_id - a - 1 AS missing FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) a FROM events) WHERE event_id > a + 1")
def event_sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return E.sequence_gaps(read(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) n_recent FROM (SELECT event_id, user_id, date_trunc('second', ts) ts FROM events)")
def trailing_24h_count(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "user_id", F.date_trunc("second", "ts").alias("ts"))
    return R.trailing_count(e, ["user_id"], "ts", 86400).drop("ts")


@query("SELECT coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes FROM documents")
def storage_usage(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))


@query(
    "WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_totalprice > 1000 OR o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50) SELECT o_custkey, o_orderkey, o_orderdate, c_name, c_mktsegment FROM p LEFT JOIN customer ON c_custkey = o_custkey"
)
def page_then_enrich(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").where("o_totalprice > 1000 OR o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return R.page_then_enrich(o, ["-o_orderdate", "o_orderkey"], 50, 50, c, "o_custkey")


@query(
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t ON true"
)
def lateral_largest_order(spark: SparkSession, sf: str) -> DataFrame:
    best = R.latest_per_group(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"])
    return read(spark, sf, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query(
    "WITH p AS (SELECT l_orderkey, sum(l_linenumber)::BIGINT pages FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderdate FROM orders LEFT JOIN p ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND epoch(TIMESTAMP '1998-09-01') - epoch(o_orderdate) > 86400 * 30 + 86400 * coalesce(pages, 0)"
)
def overdue_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("DONE").alias("status"))
    pages = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("pages"))
    return R.overdue(runs, pages, F.lit("1998-09-01").cast("timestamp"), 86400 * 30, 86400).select(F.col("run_id").alias("o_orderkey"), F.col("started_at").alias("o_orderdate"))


@query(
    "SELECT l_orderkey, sum(greatest(0, least(l_quantity::BIGINT - 10, 40)))::BIGINT AS done, (count(*) * 40)::BIGINT AS total, 'pages' AS unit FROM lineitem GROUP BY 1"
)
def page_progress(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("long") - 10).alias("done"), F.lit(40).cast("long").alias("pages"), F.lit("RUNNING").alias("status"))
    return R.page_progress(d, ["l_orderkey"])


@query(
    "WITH g AS (SELECT user_id, event_type, ts, json_extract_string(props, '$.k')::INT k FROM events) SELECT user_id, count(*) FILTER (event_type <> 'error' AND (k % 3 <> 0 OR ts > TIMESTAMP '2024-01-02'))::BIGINT AS n_live, count(*) AS n FROM g GROUP BY 1"
)
def live_grants(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    live = grant_is_live(F.when(F.col("event_type") == "error", "disabled"), F.when(F.col("k") % 3 == 0, F.col("ts").cast("string")), F.lit("2024-01-02").cast("timestamp"))
    return e.groupBy("user_id").agg(F.count_if(live).alias("n_live"), F.count("*").alias("n"))


@query(
    "SELECT c_custkey, (c_nationkey % 5 = 1) AND (c_custkey % 7 = 0 OR (CASE WHEN c_custkey % 3 = 0 THEN false ELSE c_custkey % 2 = 0 END)) AS readable FROM customer"
)
def readable_dossiers(spark: SparkSession, sf: str) -> DataFrame:
    """May a user of tenant 1 read: as owner, or by a live grant where the scope allows shares; administrators don't read."""
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    grants = F.array(F.struct(F.lit("U1").alias("user"), F.lit("read").alias("action"), F.when(k % 2 == 0, "active").otherwise("disabled").alias("status"), F.lit(None).cast("string").alias("expires")))
    ok = access_decision(F.lit("read"), F.when(k % 3 == 0, "ADMINISTRATOR").otherwise("MEMBER"), F.lit("u1"), F.lit(1), F.when(k % 7 == 0, "u1").otherwise("u2"), F.col("c_nationkey") % 5, F.lit(None).cast("string"), grants, F.lit("2024-01-01").cast("timestamp"))
    return c.select("c_custkey", ok.alias("readable"))


@query("SELECT conv_id, bool_and(turn = rn - 1) AS ok FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) rn FROM conversations) GROUP BY 1")
def conversation_ordering(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("arrival"))
    return S.ordering_ok(c, "conv_id", "arrival", "n")


@query(
    "SELECT conv_id, turn, role, CASE WHEN st = 'none' THEN NULL ELSE st END AS party FROM (SELECT conv_id, turn, role, text, last_value(CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' ELSE 'none' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) st FROM conversations)"
)
def sticky_party(spark: SparkSession, sf: str) -> DataFrame:
    from folioforge.operators.documents import sticky_state

    event = F.when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B").otherwise("none")
    return sticky_state(read(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], event, "none", "party").select("conv_id", "turn", "role", "party")


@query("SELECT role, next_role, count(*) n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) next_role FROM conversations) GROUP BY 1, 2")
def turn_transitions(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return read(spark, sf, "conversations").select("role", F.lead("role").over(w).alias("next_role")).groupBy("role", "next_role").agg(F.count("*").alias("n"))


@query(
    "WITH k AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0) SELECT p.p_partkey, p.p_name, k.p_partkey IS NULL AS is_new FROM part p LEFT JOIN k USING (p_partkey) WHERE p.p_partkey % 3 = 0 AND k.p_partkey IS NULL"
)
def idempotent_insert(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    fresh, _, _ = R.idempotent_insert(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"), ["p_partkey"], "p_name")
    return fresh.withColumn("is_new", F.lit(True))


@query(None)
def sequence_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Each event against the highest accepted number of its user: a fold, which SQL has no word for."""
    e = read(spark, sf, "events").select(F.col("user_id"), F.col("event_id").alias("arrival"), (F.col("event_id") % 5 + 1).alias("sequence"))
    return E.classify_deliveries(e, ["user_id"], "arrival", "sequence")


@query(None)
def sliding_limit(spark: SparkSession, sf: str) -> DataFrame:
    """At most 3 allowed hits of a user in an hour; refused hits leave no trace."""
    return E.sliding_limit(read(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3, 3600, ["event_id"])
