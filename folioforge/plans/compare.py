"""Comparison and blocking on the star schema."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.operators import compare as C
from folioforge.plans.catalog import query, read

_LADDER = (
    "WITH f AS (SELECT c_custkey k, CASE WHEN c_custkey % 11 = 0 THEN 'USD' ELSE 'VND' END cur, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'ex_vat' ELSE 'incl_vat' END tax, c_mktsegment scope, (c_acctbal * 100)::BIGINT % 5 v, c_nationkey n FROM customer), "
    "p AS (SELECT l.k lk, r.k rk, l.cur lc, r.cur rc, l.tax lt, r.tax rt, l.scope ls, r.scope rs, l.v lv, r.v rv FROM f l JOIN f r ON l.n = r.n AND r.k = l.k + 25) "
    "SELECT lk AS left_key, rk AS right_key, CASE WHEN lc <> rc THEN 'NOT_COMPARABLE' WHEN lt IS NOT NULL AND rt IS NOT NULL AND lt <> rt THEN 'NOT_COMPARABLE' WHEN (lt IS NULL) <> (rt IS NULL) THEN 'NEEDS_EVIDENCE' WHEN ls <> rs THEN 'NOT_COMPARABLE' WHEN lv = rv THEN 'COMPARABLE_MATCH' ELSE 'COMPARABLE_DIFFERENCE' END AS disposition FROM p"
)


@query(_LADDER)
def pair_ladder(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("c_custkey"), lambda x: F.lit(x).cast("string")
    tax = F.when(k % 7 == 0, None).when(k % 5 == 0, "ex_vat").otherwise("incl_vat")
    money = (F.col("c_acctbal") * 100).cast("long") % 5
    fact = F.struct(F.when(k % 11 == 0, "USD").otherwise("VND").alias("currency"), tax.alias("tax_basis"), s(None).alias("unit"), F.col("c_mktsegment").alias("scope"), s(None).alias("condition"), s("body").alias("source_role"), s(None).alias("validity"), s(None).alias("period_start"), money.alias("money"), s(None).alias("normalized_value"))
    f = read(spark, sf, "customer").select("c_custkey", "c_nationkey", fact.alias("x"))
    left, right = f.select(k.alias("left_key"), "c_nationkey", F.col("x").alias("l")), f.select(k.alias("right_key"), "c_nationkey", F.col("x").alias("r"))
    pairs = left.join(right, (left.c_nationkey == right.c_nationkey) & (F.col("right_key") == F.col("left_key") + 25))
    return pairs.select("left_key", "right_key", C.decision().alias("disposition"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders) SELECT a.o_orderkey AS node_a, b.o_orderkey AS node_b FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND b.rn BETWEEN a.rn + 1 AND a.rn + 12")
def banded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return C.banded_pairs(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("WITH s AS (SELECT o_custkey, min(o_orderpriority) v FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1) SELECT a.o_custkey % 10 AS g, a.o_custkey AS unit_a, b.o_custkey AS unit_b, a.v AS value_a, b.v AS value_b FROM s a JOIN s b ON a.o_custkey % 10 = b.o_custkey % 10 AND a.o_custkey < b.o_custkey AND a.v <> b.v")
def identity_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("g"), "o_custkey", "o_orderpriority")
    return C.identity_conflicts(o, ["g"], "o_custkey", "o_orderpriority")


@query("SELECT * EXCLUDE (rn) FROM (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) rn FROM orders) WHERE rn = 1")
def first_per_value(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_per(read(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("WITH l AS (SELECT l_orderkey k, arg_max(l_quantity, (l_linenumber * 10000000 + l_partkey) * 100 + l_quantity::BIGINT) av FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, o_totalprice AS body_value, av AS annex_value, o_totalprice = av AS same FROM orders JOIN l ON k = o_orderkey")
def last_annex_wins(spark: SparkSession, sf: str) -> DataFrame:
    body = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    annex = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), ((F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("ord"), F.col("l_quantity").alias("v"))
    return C.compare_last_annex(body, annex, ["k"], "ord", "v")


@query("SELECT p_partkey, CASE WHEN n = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN n = 1 THEN 'ANSWERED' ELSE 'NEEDS_REVIEW' END AS state FROM (SELECT p_partkey, count(DISTINCT l_suppkey) n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)")
def identity_states(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("n"))
    return read(spark, sf, "part").select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", C.identity_state(F.coalesce("n", F.lit(0))).alias("state"))


@query(
    "WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 500)) s FROM documents), t AS (SELECT doc_id || ':' || s AS citation_id, trim(substr(text, s::BIGINT + 1, 500), chr(10)) AS span_text FROM c) SELECT * FROM t WHERE span_text <> ''"
)
def rebuilt_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of every document in citations of 500 characters, put together from its lines."""
    from folioforge.operators import documents as D

    d = read(spark, sf, "documents").select("doc_id", "text")
    rows = D.line_offsets(D.lines(d, ["doc_id"]), ["doc_id"])
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(500)))
    cites = d.withColumn("span_start", start).select("doc_id", F.concat_ws(":", "doc_id", "span_start").alias("citation_id"), "span_start", F.least(F.col("span_start") + 500, F.char_length("text")).alias("span_end"))
    return C.rebuild_span(rows, cites, "doc_id").withColumn("span_text", F.trim("span_text", F.lit("\n"))).where("span_text <> ''")


@query(None)
def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a customer's orders from two blocking sources, scored and dealt over anchors, the first 40 of each nation."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select("c_nationkey", "o_custkey", F.col("o_orderkey").alias("node_id"), "o_orderpriority")
    pos = o.withColumn("ord", F.row_number().over(W.partitionBy("c_nationkey").orderBy("node_id"))).select("c_nationkey", "node_id", "ord")
    sources = {"SAME_ARTICLE": C.banded_pairs(o, ["o_custkey"], "node_id"), "SAME_KEY": C.banded_pairs(o, ["o_custkey", "o_orderpriority"], "node_id")}
    return C.rank_candidates(sources, pos, scope=["c_nationkey"])


@query(None)
def topics(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", C.topic_of(F.col("source"), F.col("text")).alias("topic"))
