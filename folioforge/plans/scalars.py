"""Scalar columns over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import numbers as N
from folioforge.functions import text as T
from folioforge.plans.catalog import query, read

FOLD = f"trim(regexp_replace(regexp_replace(translate(lower({{c}}), '{T.MARKED}', '{T.PLAIN}'), '[̀-ͯ]', '', 'g'), '[\\s ]+', ' ', 'g'))"


def fold_sql(c: str) -> str:
    return FOLD.replace("{c}", c)


@query(f"SELECT doc_id, md5({fold_sql('text')}) AS folded FROM documents")
def fold_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"))


@query("SELECT doc_id, sha256(text) AS digest, length(text)::BIGINT AS n FROM documents")
def quote_digests(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.quote_digest(F.col("text")).alias("digest"), F.char_length("text").cast("long").alias("n"))


@query(
    "WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE substr(lower(replace(c_name, '#', '')), 1, (c_custkey % 12)::INT) END || '@mail.example' AS e, '+84' || c_custkey AS p FROM customer), s AS (SELECT *, length(split_part(e, '@', 1)) n FROM m) "
    "SELECT c_custkey, CASE WHEN n = 0 THEN '***' WHEN n <= 2 THEN substr(e, 1, 1) || '***' ELSE substr(e, 1, 1) || repeat('*', (n - 2)::INT) || substr(e, n::INT, 1) END || '@mail.example' AS email, CASE WHEN length(p) < 7 THEN p ELSE substr(p, 1, 3) || repeat('*', (length(p) - 5)::INT) || right(p, 2) END AS phone, 'sha256:' || substr(sha256(p), 1, 12) || ':' || right(p, 4) AS hashed FROM s"
)
def masked_contacts(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    local = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.substring(F.lower(F.regexp_replace("c_name", "#", "")), F.lit(1), (F.col("c_custkey") % 12).cast("int")))
    email, phone = F.concat(local, F.lit("@mail.example")), F.concat(F.lit("+84"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", T.mask_email(email).alias("email"), T.mask_phone(phone).alias("phone"), T.mask_keep_last4(phone).alias("hashed"))


@query(
    "WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 900 + 100)::VARCHAR || '.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.000' WHEN 1 THEN (p_partkey % 90 + 10)::VARCHAR || ',' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') WHEN 2 THEN (p_partkey % 90)::VARCHAR || '.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END t FROM part) "
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(t, '.', '') WHEN 1 THEN replace(t, ',', '') WHEN 2 THEN NULL ELSE t END::BIGINT AS amount, regexp_replace(t, '[^0-9]', '', 'g')::BIGINT AS money, CASE p_partkey % 4 WHEN 0 THEN replace(t, '.', '')::DOUBLE WHEN 1 THEN replace(t, ',', '.')::DOUBLE WHEN 2 THEN CASE WHEN length(split_part(t, '.', 1)) <= 3 THEN replace(t, '.', '')::DOUBLE END ELSE t::DOUBLE END AS vn FROM s"
)
def number_readings(spark: SparkSession, sf: str) -> DataFrame:
    """One text, three parsers that differ on purpose."""
    k = F.col("p_partkey")
    tail = F.lpad((k % 1000).cast("string"), 3, "0")
    t = F.when(k % 4 == 0, F.concat((k % 900 + 100).cast("string"), F.lit("."), tail, F.lit(".000"))).when(k % 4 == 1, F.concat((k % 90 + 10).cast("string"), F.lit(","), tail)).when(k % 4 == 2, F.concat((k % 90).cast("string"), F.lit("."), tail)).otherwise(k.cast("string"))
    p = read(spark, sf, "part").select("p_partkey", t.alias("t"))
    return p.select("p_partkey", N.parse_amount(F.col("t")).cast("long").alias("amount"), N.money_decimal(F.col("t")).cast("long").alias("money"), N.parse_vn_number(F.col("t")).cast("double").alias("vn"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,5}'))::BIGINT AS n_numbers, len(regexp_extract_all(text, '[0-9]{9,16}'))::BIGINT AS n_long FROM documents")
def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]{1,5}")).cast("long").alias("n_numbers"), F.regexp_count("text", F.lit("[0-9]{9,16}")).cast("long").alias("n_long"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1), '^$', '') AS canonical_url FROM pages")
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("canonical_url"))


@query(None)
def reading_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Reason codes and diacritic density of every line, by regular expressions that RE2 lacks."""
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return T.line_quality(d, "line").drop("line")


@query(None)
def critical_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Money, percent, date, contract and id tokens of each text, by patterns with lookaround."""
    return read(spark, sf, "documents").select("doc_id", N.critical_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '{T._ALLOWED.replace(chr(39), chr(39) * 2)}', '', 'g'))::DOUBLE / length(text) END, 9) AS odd_share FROM documents")
def odd_character_share(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.round(T.garbage_char_ratio(F.col("text")), 9).alias("odd_share"))
