"""Ranking and vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import retrieval as R
from folioforge.plans.catalog import query, read
from folioforge.plans.scalars import fold_sql


@query(
    "WITH q AS (SELECT query_id, token, count(*) times FROM (SELECT doc_id query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) token FROM documents WHERE doc_id % 50 = 0) GROUP BY 1, 2), "
    "d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') ts FROM documents), s AS (SELECT count(*)::DOUBLE n, avg(len(ts)) a FROM d), "
    "tf AS (SELECT doc_id, dl, token, count(*) tf FROM (SELECT doc_id, len(ts) dl, unnest(ts) token FROM d) WHERE token IN (SELECT token FROM q) GROUP BY 1, 2, 3), df AS (SELECT token, count(*) df FROM tf GROUP BY 1), "
    "sc AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / a)) * times), 5) score FROM tf JOIN df USING (token) JOIN q USING (token), s GROUP BY 1, 2) "
    "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT rank FROM sc) WHERE rank <= 20"
)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The documents nearest to each document whose id is divisible by 50, among all documents."""
    d = read(spark, sf, "documents")
    return R.bm25_top_k(d, d.where("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "text AS query"), 20, 5)


@query(
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), q AS (SELECT vec_id query_id, e qe FROM v WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, CASE WHEN list_dot_product(e, e) = 0 OR list_dot_product(qe, qe) = 0 THEN -1 ELSE list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) END score FROM v, q) "
    "SELECT query_id, vec_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT rank FROM s) WHERE rank <= 10"
)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.vector_top_k(v, q, 10).withColumn("score", F.round("score", 9))


@query(
    f"WITH t AS (SELECT doc_id, {fold_sql('text')} t FROM documents), s AS (SELECT doc_id, (regexp_matches(t, '\\bthing\\b')::INT + regexp_matches(t, '\\bwas\\b')::INT + 2 * regexp_matches(t, '\\bthing was\\b')::INT)::DOUBLE score FROM t) SELECT doc_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT rank FROM s WHERE score > 0) WHERE rank <= 12"
)
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    score = R.lexical_score(F.col("text"), F.lit(""), "thing was")
    d = read(spark, sf, "documents").select("doc_id", score.alias("score"), F.lit(1).alias("q")).where("score > 0")
    # the best twelve come from each partition first
    best = d.orderBy(F.col("score").desc(), "doc_id").limit(12)
    return R.top_k(best, ["q"], "score", ["doc_id"], 12).drop("q")


@query(
    "WITH a AS (SELECT doc_id, 0 source_rank, n_chars ord FROM documents WHERE n_chars > 8000), b AS (SELECT doc_id, 1, doc_id FROM documents WHERE lang = 'de'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_rank, ord) r FROM u) WHERE r = 1) "
    "SELECT doc_id, source_rank, rank FROM (SELECT *, row_number() OVER (ORDER BY source_rank, ord, doc_id)::INT rank FROM o) WHERE rank <= 12"
)
def merged_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    a = d.where("n_chars > 8000").select("doc_id", F.col("n_chars").alias("ord")).orderBy("ord", "doc_id").limit(12)
    b = d.where("lang = 'de'").select("doc_id", F.col("doc_id").alias("ord")).orderBy("ord", "doc_id").limit(24)
    one = lambda x: x.withColumn("q", F.lit(1))
    return R.merge_hits([one(a), one(b)], ["q"], "doc_id").select("doc_id", "source_rank", "rank")


@query("SELECT label, vec_id, score FROM (SELECT label, vec_id, score, max(score) OVER (PARTITION BY label) m, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) r FROM (SELECT label, vec_id, (vec_id * 7919 % 1000)::DOUBLE score FROM embeddings)) WHERE score >= 0.75 * m AND r <= 3")
def topic_hits(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select("label", "vec_id", (F.col("vec_id") * 7919 % 1000).cast("double").alias("score"))
    return R.topic_hits(v, ["label"], "score", "vec_id").drop("rank")
