"""Operator 3: mixing sources to target weights. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.llm.common import WORD, table, written

WEIGHTS, SHARE, CEILING, SEED = (3, 1, 2), (3, 2), 2, 17


def word_count(text: Column) -> Column:
    """Number of words; a null or blank text has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) fixed by the key's text and the seed: 52 bits of MD5. A null key counts as empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, share=SHARE, ceiling: int = CEILING) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, weigh `weights`, repeating. Together they get share[0]/share[1] of all sizes.
    A target stops at `ceiling` times its source's size; the excess is shared again by weight until none is above. In
    closed form: in order of ceiling/weight, the first k sources are full, where k is the least for which the level
    (total - their ceilings) / (weights of the rest) is at most the next one's ceiling/weight; from there on levels fall,
    so it is the greatest such level. Sources are aggregated
    first, so the windows run over one row per source. No rows give no rows; sources without words have target 0.
    """
    each = sized.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(size)).cast("long").alias("source_size"))
    named = each.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), F.col("rank") % len(weights) + 1)
    capped = named.withColumn("weight", weight).withColumn("most", F.col("source_size") * ceiling)
    order = W.orderBy(F.col("most") / F.col("weight"), "rank")
    level = (F.lit(float(share[0])) * F.col("total") / F.lit(float(share[1])) - F.col("before")) / F.col("rest")
    found = (
        capped.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(W.partitionBy()))
    )
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return found.select("source", "source_size", target.alias("target"))


def copies(df: DataFrame, targets: DataFrame, key: list[Column], source: str = "source", seed: int = SEED) -> DataFrame:
    """(row, t, copies) for each row of df: the row as a struct, its source's target and size, and the copies it gets: floor(rate), and one more with the fraction's probability.

    The draw is a hash of the key, so reruns agree and equal keys fare alike. The targets, a row per source, are a written
    table: Spark broadcasts it only if its files are under the session's threshold and joins by shuffle otherwise.
    """
    named = lambda c: F.struct(c.isNull(), F.coalesce(c.cast("string"), F.lit("")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), uniform(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), seed).alias("draw"), named(F.col(f"`{source}`")).alias("source_key"))
    t = targets.select(named(F.col("source")).alias("source_key"), F.struct("source_size", "target").alias("t"))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return rows.join(t, "source_key", "left").select("row", "t", (whole + F.when(F.col("draw") < rate - whole, 1).otherwise(0)).cast("int").alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of df floor(rate) times, and once more with the fraction's probability.

    Columns are df's, whatever their names. Null texts have size 0 and are drawn like others; rows of a source without
    words have rate 0 and do not appear; repeated rows count each; a null source is a source of its own, last in order.
    The draw is over id and text, so rows of one id, or of none, fare apart if their texts do; equal rows fare alike.
    """
    targets = written(source_targets(df.select(F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size")), weights=weights), "mix-targets")
    drawn = copies(df, targets, [F.col(f"`{id_col}`"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))], source, seed)
    return drawn.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")), "mix-sizes")
    out = copies(sized, written(source_targets(sized), "mix-targets"), [F.col("doc_id"), F.col("digest")])
    return out.select("row.doc_id", "row.size", "t.source_size", "t.target", (F.col("row.size") * F.col("copies")).cast("long").alias("taken"))


#: {docs} is the table to mix.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}
), each AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, source_size * 2 AS most, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM each
), levels AS (
  SELECT *, (3.0::DOUBLE * sum(source_size) OVER () / 2.0::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), targets AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce(max(CASE WHEN level <= most::DOUBLE / weight THEN level END) OVER (), 0) * weight) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, '') || chr(31) || s.digest), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
"""
ORACLE = SQL.replace("{docs}", "documents") + """
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
