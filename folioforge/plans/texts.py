"""Copies, furniture, contamination, windows and pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import documents as D
from folioforge.plans.catalog import query, read
from folioforge.plans.scalars import fold_sql


@query("SELECT doc_id, d AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) d FROM documents) WHERE doc_id <> d")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return D.exact_duplicates(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


@query(
    "WITH l AS (SELECT doc_id, source, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', '#', 'g'))) x FROM documents) SELECT source, x AS digits_masked, count(DISTINCT doc_id) AS n_pages FROM l WHERE x <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= greatest(2, ceil(0.1 * (SELECT count(DISTINCT doc_id) FROM documents d WHERE d.source IS NOT DISTINCT FROM l.source)))"
)
def running_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    return D.running_lines(d.withColumn("position", F.lit("any")), "source", "doc_id", "position", F.col("line"), 0.1).select("source", "digits_masked", "n_pages")


@query(
    f"WITH w AS (SELECT doc_id, string_split({fold_sql('text')}, ' ') ws, {fold_sql('text')} t FROM documents), s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' '))) g FROM w WHERE t <> ''), "
    f"rw AS (SELECT item_id, string_split({fold_sql('text')}, ' ') ws, {fold_sql('text')} t FROM benchmark), r AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' '))) g FROM rw WHERE t <> ''), n AS (SELECT item_id, count(*) n FROM r GROUP BY 1) "
    "SELECT doc_id, item_id, round(count(*)::DOUBLE / any_value(n), 9) AS contained FROM s JOIN r USING (g) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 0.5 * any_value(n)"
)
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    return D.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"), "doc_id", "item_id").withColumn("contained", F.round("contained", 9))


@query(
    f"WITH w AS (SELECT doc_id, string_split({fold_sql('text')}, ' ') ws, {fold_sql('text')} t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' ')))) END::BIGINT AS n_shingles FROM w"
)
def shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = D.with_words(read(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.size(D.shingles(F.col("words"))).cast("long").alias("n_shingles"))


@query(
    "SELECT doc_id, s AS start, substr(text, (s + 1)::INT, 1600) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 1400.0)::BIGINT - 1, 0) * 1400 + 1, 1400)) s FROM documents)"
)
def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.explode(D.fixed_windows(F.col("text"))).alias("w"))
    return d.select("doc_id", F.col("w.start").cast("long").alias("start"), "w.piece")


@query("SELECT doc_id, (n - 1)::BIGINT AS line_no, e - length(x) AS char_start, e AS char_end FROM (SELECT doc_id, n, x, (sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1)::BIGINT e FROM (SELECT doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) n FROM documents))")
def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    got = D.line_offsets(D.lines(read(spark, sf, "documents"), ["doc_id"]), ["doc_id"])
    return got.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "char_start", "char_end")


@query(
    "WITH p AS (SELECT doc_id, source, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) r FROM documents) SELECT doc_id, source, ((r - 1) // 8)::BIGINT AS unit_no FROM p"
)
def unit_plan(spark: SparkSession, sf: str) -> DataFrame:
    return D.plan_units(read(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 8)


@query(
    "WITH t AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<head\\b.*?</head\\s*>|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<template\\b.*?</template\\s*>', '', 'g') t FROM pages), "
    "u AS (SELECT page_id, regexp_replace(t, '(?i)<br\\s*/?>|</?(p|div|li|tr|h[1-6]|table|thead|tbody|tfoot|ul|ol|dl|dt|dd|section|article|header|footer|blockquote|pre)\\b[^>]*>', chr(10), 'g') t FROM t), "
    "v AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?t[dh]\\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') t FROM u), "
    "w AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') t FROM v) "
    "SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '[ \\t\\r\\f\\x0B ]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))) AS visible FROM w"
)
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.md5(D.strip_html(F.col("html")).cast("binary")).alias("visible"))


@query("SELECT source, list_sort(list(m)) AS missing FROM (SELECT source, unnest(range(min(n), max(n) + 1)) m FROM (SELECT source, n_chars % 40 AS n FROM documents) GROUP BY 1) WHERE (source, m) NOT IN (SELECT (source, n_chars % 40) FROM documents) GROUP BY 1")
def numbering_gaps(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("source", (F.col("n_chars") % 40).alias("n"))
    return D.number_gaps(d, ["source"], "n").withColumn("missing", F.array_sort("missing"))
