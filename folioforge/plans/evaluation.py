"""Statistics over labels, documents and lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import stats as S
from folioforge.plans.catalog import query, read

_Z = "1.959963984540054"
_JOINED = "FROM documents JOIN labels USING (doc_id)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(read(spark, sf, "labels"), "doc_id")


@query(
    f"WITH g AS (SELECT source, count(*) n, count(*) FILTER (quality = 1) k {_JOINED} GROUP BY 1), p AS (SELECT *, k / n::DOUBLE p FROM g) SELECT source, n, k::BIGINT AS k, "
    f"round(greatest(0, (p + {_Z}*{_Z}/(2*n) - {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4.0*n*n))) / (1 + {_Z}*{_Z}/n)), 6) AS low, round(least(1, (p + {_Z}*{_Z}/(2*n) + {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4.0*n*n))) / (1 + {_Z}*{_Z}/n)), 6) AS high, CASE WHEN p < 0.5 THEN 'FAIL' WHEN n < 60 THEN 'UNDERPOWERED' ELSE 'PASS' END AS state FROM p"
)
def wilson_by_source(spark: SparkSession, sf: str) -> DataFrame:
    g = _labelled(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.expr("quality = 1")).alias("k"))
    w = S.wilson(F.col("k"), F.col("n"))
    state = F.when(F.col("k") / F.col("n") < 0.5, "FAIL").when(F.col("n") < 60, "UNDERPOWERED").otherwise("PASS")
    return g.select("source", "n", "k", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"), state.alias("state"))


@query(f"SELECT lang, round(sum(CASE WHEN quality = 1 THEN 1 / pi ELSE 0 END) / sum(1 / pi), 9) AS estimate FROM (SELECT lang, quality, CASE WHEN n_chars > 2000 THEN 0.8 ELSE 0.25 END::DOUBLE pi {_JOINED}) GROUP BY 1")
def horvitz_thompson(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf).withColumn("pi", F.when(F.col("n_chars") > 2000, 0.8).otherwise(0.25))
    return d.groupBy("lang").agg(F.round(S.horvitz_thompson(F.col("quality") == 1, F.col("pi")), 9).alias("estimate"))


@query(f"SELECT lang, quality, count(*) FILTER (toxic = 0)::BIGINT AS \"0\", count(*) FILTER (toxic = 1)::BIGINT AS \"1\" {_JOINED} GROUP BY 1, 2")
def confusion_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return S.confusion(_labelled(spark, sf), ["lang"], "quality", "toxic", [0, 1])


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, round(median(l_quantity), 6) AS q50 FROM lineitem GROUP BY 1")
def p50_p90_amount(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(S.linear_quantile("l_extendedprice", 0.5), 6).alias("p50"), S.nearest_rank("l_extendedprice", 0.9).alias("p90"), F.round(F.median("l_quantity"), 6).alias("q50"))


@query(
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) rn FROM documents) WHERE rn <= 5"
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents of each source by the MD5 of their id: a sampling operator."""
    d = read(spark, sf, "documents").select("doc_id", "source")
    quotas = d.groupBy("source").agg(F.count("*").alias("n")).withColumn("quota", F.least(F.lit(5), F.col("n")))
    return S.stratified_sample(d, quotas, "source", "doc_id").select("doc_id", "source")


@query(
    "WITH d AS (SELECT doc_id, string_split(source, '')  s, string_split(lang, '') l FROM documents) SELECT doc_id, CASE WHEN len(list_distinct(s)) = 0 AND len(list_distinct(l)) = 0 THEN 1.0 ELSE round(len(list_intersect(list_distinct(s), list_distinct(l)))::DOUBLE / len(list_distinct(s)), 9) END AS precision FROM d"
)
def set_precision(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.split("source", "").alias("s"), F.split("lang", "").alias("l"))
    return d.select("doc_id", F.round(S.precision_recall_f1(F.col("s"), F.col("l"))["precision"], 9).alias("precision"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), 1)::DOUBLE, 9) AS cer FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def character_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.round(S.char_error_rate(F.col("x"), F.col("y")), 9).alias("cer"))


@query(None)
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the quality rate by language, sources drawn again 200 times: our own deterministic draw."""
    d = _labelled(spark, sf).withColumn("passed", F.col("quality") == 1)
    return S.cluster_bootstrap(d, ["lang"], "source", "passed", rounds=200)
