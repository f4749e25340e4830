"""Numbers, headings, pairs, tables and trees built from the star schema, so that SQL can state what the operators find."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import numbers as N
from folioforge.functions import text as T
from folioforge.operators import compare as C
from folioforge.operators import documents as D
from folioforge.operators import facts as X
from folioforge.operators import graph as G
from folioforge.operators import stats as S
from folioforge.operators import tables as B
from folioforge.plans.catalog import query, read

_DIGITS = "array('không', 'một', 'hai', 'ba', 'bốn', 'năm', 'sáu', 'bảy', 'tám', 'chín')"


@query("SELECT p_partkey, (p_partkey % 1000)::BIGINT AS n, (p_partkey % 1000 * 1000)::BIGINT AS thousands, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 1000)::BIGINT END AS spoilt FROM part WHERE p_partkey % 1000 > 0")
def number_words(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers written as words and read again; with a stray word there is no number."""
    p = read(spark, sf, "part").where("p_partkey % 1000 > 0").selectExpr("p_partkey", f"{_DIGITS} AS d", "CAST(p_partkey % 1000 AS INT) AS n")
    p = p.selectExpr("p_partkey", "d", "n DIV 100 AS h", "(n DIV 10) % 10 AS t", "n % 10 AS u")
    words = "concat_ws(' ', CASE WHEN h > 0 THEN concat(element_at(d, CAST(h + 1 AS INT)), ' trăm') END, CASE WHEN t = 0 AND u > 0 AND h > 0 THEN 'linh' WHEN t = 1 THEN 'mười' WHEN t > 1 THEN concat(element_at(d, CAST(t + 1 AS INT)), ' mươi') END, CASE WHEN u > 0 THEN element_at(d, CAST(u + 1 AS INT)) END)"
    p = p.selectExpr("p_partkey", f"{words} AS w")
    read_ = lambda c: N.vn_words_to_number(c).cast("long")
    return p.select("p_partkey", read_(F.col("w")).alias("n"), read_(F.concat("w", F.lit(" nghìn đồng"))).alias("thousands"), read_(F.when(F.col("p_partkey") % 3 == 0, F.concat("w", F.lit(" xyz"))).otherwise(F.col("w"))).alias("spoilt"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, (o_orderkey * 1000)::VARCHAR AS money, (o_orderkey % 100)::DOUBLE AS pct, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey::DOUBLE END AS cell FROM orders"
)
def typed_values(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", "replace(format_number(o_orderkey * 1000, 0), ',', '.') AS m")
    k = F.col("o_orderkey").cast("string")
    cell = F.when(F.col("o_orderkey") % 2 == 0, F.lit("1.234")).otherwise(F.concat(k, F.lit(" VND")))
    return o.select(
        "o_orderkey", N.normalize_typed(F.lit("DATE"), F.date_format("o_orderdate", "d/M/yyyy")).alias("iso"), N.normalize_typed(F.lit("MONEY"), F.concat("m", F.lit(" đ"))).alias("money"),
        N.percent(F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(" %"))).cast("double").alias("pct"), B.parse_cell(cell).cast("double").alias("cell"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'date:' || strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderkey || '%' END AS visible FROM orders")
def visible_values(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE concat(o_orderkey, ' %') END AS v")
    return o.select("o_orderkey", N.normalize_visible(F.col("v")).alias("visible"))


#: Labels of five kinds, by the number of a part.
_LABEL = "CASE {k} % 6 WHEN 0 THEN 'Phụ lục ' || {k} WHEN 1 THEN 'Mục ' || {k} WHEN 2 THEN 'ĐIỀU ' || {k} || ':' WHEN 3 THEN {k} || '.2. giá' WHEN 4 THEN 'Khoản ' || {k} ELSE 'giá hàng' END"


@query(
    f"WITH l AS (SELECT p_partkey k, {_LABEL.replace('{k}', 'p_partkey')} t FROM part) SELECT k, k % 6 IN (0, 1, 2) AS annex, k % 6 <> 5 AS structural, CASE k % 6 WHEN 0 THEN 'ANNEX' WHEN 1 THEN 'SECTION' WHEN 2 THEN 'ARTICLE' WHEN 3 THEN 'SUBCLAUSE' WHEN 4 THEN 'SUBCLAUSE' ELSE 'BLOCK' END AS level, "
    "CASE WHEN k % 6 = 3 THEN 'decimal:' || k || '.2:2' END AS marker, CASE WHEN k % 6 = 2 THEN 'Điều ' || k || '. ' ELSE t END AS fixed, CASE k % 6 WHEN 2 THEN k::VARCHAR WHEN 4 THEN k::VARCHAR WHEN 3 THEN k || '.2' ELSE '7' END AS clause FROM l"
)
def heading_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").selectExpr("p_partkey AS k", f"{_LABEL.replace('{k}', 'p_partkey')} AS t")
    t, m = F.col("t"), T.parse_marker(F.col("t"))
    return p.select("k", T.is_annex_heading(t).alias("annex"), T.is_structural_heading(t).alias("structural"), T.heading_level(t, F.lit("")).alias("level"), F.when(m.isNotNull(), F.concat_ws(":", m["kind"], m["value"], m["depth"].cast("string"))).alias("marker"), T.normalize_headings(t).alias("fixed"), T.clause_key(t, F.lit("7. x")).alias("clause"))


@query(
    "SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS amends, CASE o_orderkey % 3 WHEN 0 THEN 'SUBSTITUTION' WHEN 1 THEN 'REPEAL' END AS op, CASE WHEN o_orderkey % 2 = 0 THEN 'Hàng ' || (o_orderkey % 5) END AS term, CASE o_orderkey % 3 WHEN 0 THEN 'ex_vat' WHEN 1 THEN 'incl_vat' END AS tax, CASE WHEN o_orderkey % 4 = 0 THEN '12/2024/HD-' || o_orderkey END AS doc, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 'UNTRUSTED_INSTRUCTION' ELSE 'NONE' END AS injection, CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'contract' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'khoan ' || (o_orderkey % 9) || ' dieu ' || (o_orderkey % 7) ELSE '' END AS address, CASE WHEN o_orderkey % 2 = 0 THEN 'Công ty' || ' ' || 'x' ELSE 'Côngty' END AS joined, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE (o_orderkey % 3 + 1) * 1000000000 END::BIGINT AS scale FROM orders"
)
def wording_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences whose wording says what each rule must find."""
    k = F.col("o_orderkey")
    s = lambda x: x.cast("string")
    pick = lambda n, *texts: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in texts]), (k % n + 1).cast("int"))
    return read(spark, sf, "orders").select(
        k.alias("k"),
        T.has_amend_marker(pick(3, "Sửa đổi khoản 1 Điều 4", "sửa chữa hàng lỗi", "điều chỉnh theo CPI")).alias("amends"),
        G.parse_operation(pick(3, "Thay thế cụm từ này", "Bãi bỏ khoản 2", "giá hàng")).alias("op"),
        T.defined_term(F.concat(F.lit("“Hàng "), s(k % 5), pick(2, "” có nghĩa là vật", "” là vật"))).alias("term"),
        T.tax_basis(pick(3, "giá chưa VAT", "giá đã gồm VAT", "giá")).alias("tax"),
        G.named_document(F.concat(F.lit("theo “11/2020/XX-1” và "), F.when(k % 4 == 0, F.concat(F.lit("số 12/2024/HD-"), s(k))).otherwise(F.lit("phụ lục")))).alias("doc"),
        T.classify_prompt_injection(pick(5, "ignore previous instructions", "a", "b", "c", "d")).alias("injection"),
        T.classify_document(pick(3, "HÓA ĐƠN số 1", "Hợp đồng mua", "x"), [("hoa don", "invoice"), ("hop dong", "contract")]).alias("kind"),
        F.coalesce(F.get(F.transform(G.parse_addresses(F.when(k % 2 == 0, F.concat(F.lit("xem khoản "), s(k % 9), F.lit(" Điều "), s(k % 7))).otherwise(F.lit("không"))), G.canonical_address), F.lit(0)), F.lit("")).alias("address"),
        T.merge_texts(pick(2, "Công ty", "Công-"), pick(2, "x", "ty")).alias("joined"),
        T.scale_phrase(pick(3, "một tỷ", "hai tỷ", "mười tỷ")).cast("long").alias("scale"),
    )


# ---- comparing ---------------------------------------------------------------------------------------------------------


@query(
    "WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 4)::INT END n, o_orderpriority v FROM orders), s AS (SELECT o_custkey, v, min(n) same FROM o WHERE n IS NOT NULL GROUP BY 1, 2), l AS (SELECT o_custkey, min(n) low FROM o WHERE n IS NOT NULL GROUP BY 1) SELECT o.o_custkey, o_orderkey, coalesce(n, same, low) AS n FROM o LEFT JOIN s ON o.o_custkey = s.o_custkey AND o.v = s.v LEFT JOIN l ON o.o_custkey = l.o_custkey"
)
def shared_installments(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, C.installment(F.concat(F.lit("đợt 9, đợt "), (F.col("o_orderkey") % 4).cast("string"), F.lit(": ")))).alias("n"), F.col("o_orderpriority").alias("v"))
    return C.share_installments(o, ["o_custkey"], "n", "v").select("o_custkey", "o_orderkey", "n")


@query("SELECT (o_orderkey % 40)::INT AS annex, min(o_orderkey) AS first_cited FROM orders WHERE o_orderkey % 40 NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1")
def missing_annexes(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("theo Phụ lục số "), (F.col("o_orderkey") % 40).cast("string")).alias("t"))
    return C.missing_annexes(o, read(spark, sf, "nation").selectExpr("n_nationkey AS annex"), "t", "o_orderkey")


@query(
    "WITH p AS (SELECT l_orderkey, l_partkey a, l_suppkey b, l_linenumber n FROM lineitem), r AS (SELECT ps a, ss b FROM (SELECT l_suppkey ps, l_partkey ss FROM lineitem WHERE l_orderkey % 5 = 0)), k AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE least(r.a, r.b) = least(p.a, p.b) AND greatest(r.a, r.b) = greatest(p.a, p.b))) SELECT l_orderkey, min(n * 1000000 + a) AS first FROM k GROUP BY 1"
)
def missing_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The first pair of each order whose nodes no relation joins, in either direction."""
    li = read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey AS a", "l_suppkey AS b", "l_linenumber * 1000000 + l_partkey AS ord")
    rel = li.where("l_orderkey % 5 = 0").selectExpr("b AS node_a", "a AS node_b")
    return C.missing_relations(li, rel, ["l_orderkey"], "a", "b", "ord").select("l_orderkey", F.col("ord").alias("first"))


@query(
    "SELECT o_orderkey, CASE WHEN a = b THEN 'SAME' WHEN o_orderkey % 3 = 2 THEN 'UNKNOWN' WHEN x >= y THEN 'PARTIAL' ELSE 'DISJOINT' END AS state FROM (SELECT o_orderkey, o_orderkey % 10 x, o_orderkey % 7 y, CASE WHEN o_orderkey % 3 = 2 THEN 'tiền' ELSE 'giá < ' || (o_orderkey % 10) END a, 'giá >= ' || (o_orderkey % 7) b FROM orders) WHERE x <> y"
)
def context_states(spark: SparkSession, sf: str) -> DataFrame:
    """Two conditions on one base: do they meet?"""
    o = read(spark, sf, "orders").where("o_orderkey % 10 <> o_orderkey % 7").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 2 THEN 'tiền' ELSE concat('giá < ', o_orderkey % 10) END AS a", "concat('giá >= ', o_orderkey % 7) AS b")
    return o.select("o_orderkey", C.context_assessment([(F.col("a"), F.col("b"))]).alias("state"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'INVALID' WHEN 2 THEN 'UNVERIFIED' WHEN 3 THEN 'VALID' ELSE 'INVALID' END AS status FROM lineitem"
)
def citation_states(spark: SparkSession, sf: str) -> DataFrame:
    """Blank quotes, moved sources, no span, a quote that stands there, and one that doesn't."""
    n = F.col("l_linenumber") % 5
    quote = F.when(n == 0, " ").when(n == 4, "absent").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    span = F.when(n != 2, F.concat(F.lit("the  part\n"), F.col("l_partkey").cast("string"), F.lit(" here")))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.citation_status(quote, span, F.sha2(quote.cast("binary"), 256), F.when(n == 1, "x").otherwise("y"), F.lit("y")).alias("status"))


@query(
    "WITH a AS (SELECT l_orderkey k, list_distinct(list(l_suppkey % 5)) s FROM lineitem GROUP BY 1), j AS (SELECT x.k a, y.k b, x.s sa, y.s sb FROM a x JOIN a y ON y.k = x.k + 1) SELECT a, b, round(len(list_intersect(sa, sb))::DOUBLE / len(list_distinct(sa || sb)), 9) AS jaccard, round(len(list_intersect(sa, sb))::DOUBLE / least(len(sa), len(sb)), 9) AS containment, len(list_intersect(sa, sb))::INT AS matched FROM j"
)
def set_similarities(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.collect_set(F.col("l_suppkey") % 5).alias("sa"))
    b = a.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("sa").alias("sb"))
    sa, sb = F.col("sa"), F.col("sb")
    return a.join(b, "a").select("a", "b", F.round(C.jaccard(sa, sb), 9).alias("jaccard"), F.round(C.containment(sa, sb), 9).alias("containment"), F.size(S.set_overlap(sa, sb)["matched"]).alias("matched"))


@query(
    "WITH f AS (SELECT doc_id, text, doc_id o FROM documents WHERE trim(text) <> ''), k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(regexp_replace({f}, '^\\d+(\\.\\d+)*\\.?\\s+', ''))) node_a FROM f) SELECT node_a, doc_id AS node_b FROM k WHERE doc_id <> node_a".replace("{f}", __import__("folioforge.plans.scalars", fromlist=["fold_sql"]).fold_sql("text"))
)
def verbatim_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Copies with the first of them, numbering and accents aside."""
    return C.verbatim_pairs(read(spark, sf, "documents").selectExpr("doc_id", "doc_id AS ord", "text"), "text", "ord", "doc_id")


@query(
    "WITH a AS (SELECT p_partkey k, p_partkey % 50 part, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 5)::VARCHAR END d FROM part) SELECT k, CASE WHEN part < 5 THEN 'annex:' || part || '/' WHEN d IS NOT NULL THEN 'body:' || part || '/' || d END AS key, CASE WHEN k % 4 = 0 THEN 'f0' WHEN k % 4 = 1 THEN 'f1' END AS field, CASE WHEN k % 4 < 2 THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS review_state FROM a"
)
def article_and_profile_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").selectExpr("p_partkey AS k", "concat(CASE WHEN p_partkey % 50 < 5 THEN 'annex:' ELSE 'body:' END, p_partkey % 50) AS part", "CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 5 AS STRING) END AS d", "element_at(array('Số  HĐ', 'NGÀY ký', 'khác', 'x'), CAST(p_partkey % 4 + 1 AS INT)) AS raw_key", "1 AS profile")
    aliases = spark.createDataFrame([(1, "f0", "số hđ", 1), (1, "f1", "ngày ký", 2), (1, "late", "so hd", 3), (2, "f9", "khac", 1)], "profile int, field string, alias string, ord int")
    got = C.mapped_fields(p, aliases, ["profile"])
    key = C.article_key(F.col("part"), F.col("d"))
    return got.select("k", F.when(key.isNotNull(), F.concat(key["part"], F.lit("/"), key["dieu"])).alias("key"), "field", "review_state")


# ---- evaluation --------------------------------------------------------------------------------------------------------


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg((l_discount > 0.05)::INT), 6) AS success_rate, round(sum(l_extendedprice) / sum(l_quantity), 4) AS pooled, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median FROM lineitem GROUP BY 1, 2"
)
def grouped_report(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").withColumn("ok", F.expr("l_discount > 0.05"))
    r = S.grouped_report(li, ["l_returnflag", "l_linestatus"], ["l_quantity"], "l_extendedprice", "l_quantity", "ok")
    return r.select("l_returnflag", "l_linestatus", "n", F.round("success_rate", 6).alias("success_rate"), F.round("pooled", 4).alias("pooled"), F.round("l_quantity_mean", 6).alias("mean"), F.col("l_quantity_median").alias("median"))


_SIDE = "SELECT DISTINCT l_orderkey o, l_partkey % 3 part, l_orderkey || ':' || l_partkey || ':' || l_suppkey id FROM lineitem WHERE l_returnflag = "


@query(
    f"WITH g AS ({_SIDE}'R'), p AS ({_SIDE}'A'), g1 AS (SELECT *, row_number() OVER (PARTITION BY o, part ORDER BY id) rn FROM g), p1 AS (SELECT *, row_number() OVER (PARTITION BY o, part ORDER BY id) rn FROM p), m1 AS (SELECT g1.id AS g, p1.id AS p, 1 AS pass_no FROM g1 JOIN p1 USING (o, part, rn)), "
    "g2 AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY id) rn FROM g WHERE id NOT IN (SELECT g FROM m1)), p2 AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY id) rn FROM p WHERE id NOT IN (SELECT p FROM m1)) SELECT * FROM m1 UNION ALL SELECT g2.id, p2.id, 2 FROM g2 JOIN p2 USING (o, rn)"
)
def greedy_match_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Returned with accepted parts of an order: by the part's class first, what is left by the order alone."""
    side = lambda flag, name: read(spark, sf, "lineitem").where(f"l_returnflag = '{flag}'").selectExpr("l_orderkey AS o", "l_partkey % 3 AS part", f"concat_ws(':', l_orderkey, l_partkey, l_suppkey) AS {name}").distinct()
    return S.greedy_rank_match(side("R", "g"), side("A", "p"), [["o", "part"], ["o"]], "g", "p")


_LABELS = "FROM documents JOIN labels USING (doc_id)"


@query(
    f"WITH g AS (SELECT doc_id, lang, source, CASE quality WHEN 1 THEN 'CONFLICT' ELSE 'DUPLICATE' END gold {_LABELS}), p AS (SELECT doc_id, CASE toxic WHEN 0 THEN 'CONFLICT' ELSE 'DUPLICATE' END pred FROM labels WHERE doc_id % 3 <> 0), u AS (SELECT * FROM g FULL JOIN p USING (doc_id)) "
    "SELECT lang, source, count(*) AS n, count(gold) AS n_gold, count(pred) AS n_pred, count(*) FILTER (gold = pred)::BIGINT AS n_hit, count(*) FILTER (pred = 'DUPLICATE' AND coalesce(gold <> pred, true))::BIGINT AS n_false_duplicate FROM u GROUP BY GROUPING SETS ((lang), (source), ())"
)
def relation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels")
    gold = read(spark, sf, "documents").select("doc_id", "lang", "source").join(labels, "doc_id").withColumn("label", F.expr("CASE quality WHEN 1 THEN 'CONFLICT' ELSE 'DUPLICATE' END"))
    pred = labels.where("doc_id % 3 <> 0").withColumn("label", F.expr("CASE toxic WHEN 0 THEN 'CONFLICT' ELSE 'DUPLICATE' END"))
    return S.relation_blocks(gold, pred, "doc_id", ["lang", "source"])


@query(
    "WITH m AS (SELECT l_orderkey k, count(*) n, count(*) FILTER (l_returnflag = 'R') r, count(*) FILTER (l_linestatus = 'O') t FROM lineitem GROUP BY 1) SELECT o_custkey, sum(1)::BIGINT AS n_gold, sum(coalesce(n, 0))::BIGINT AS n_pred, sum(coalesce(r, 0))::BIGINT AS op_agree, sum(coalesce(t, 0))::BIGINT AS target_correct FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY ROLLUP (o_custkey)"
)
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    gold = read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    pred = gold.join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    matched = pred.select("o_custkey", F.expr("l_returnflag = 'R'").alias("op_agrees"), F.expr("l_linestatus = 'O'").alias("target_right"))
    return S.pair_scores(gold, pred, matched, ["o_custkey"]).drop("src_found")


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1 - toxic)::BIGINT AS n_agree, round(avg((quality = 1 - toxic)::INT), 9) AS rate FROM labels")
def annotator_agreement(spark: SparkSession, sf: str) -> DataFrame:
    lab = read(spark, sf, "labels")
    a = S.agreement(lab.selectExpr("doc_id", "quality AS label"), lab.selectExpr("doc_id", "1 - toxic AS label"), "doc_id", "label")
    return a.select("n", "n_agree", F.round("rate", 9).alias("rate"))


@query(
    "WITH m AS (SELECT doc_id, source AS c, 'u' || doc_id AS url, doc_id % 40 = 0 AS bad FROM documents), k AS (SELECT lang || source AS c, min(sha256('u' || doc_id)) h, bool_or(doc_id % 40 = 0 AND lang = 'de') b FROM documents GROUP BY 1), r AS (SELECT c, row_number() OVER (ORDER BY h, c) rn, count(*) OVER () n FROM k WHERE NOT b) SELECT c AS cluster, CASE WHEN rn <= ceil(2 * n / 3.0) THEN 'heldout' ELSE 'dev' END AS split FROM r UNION ALL SELECT c, 'dev' FROM k WHERE b"
)
def cluster_splits(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").selectExpr("concat(lang, source) AS cluster", "concat('u', doc_id) AS url", "doc_id % 40 = 0 AND lang = 'de' AS bad")
    return S.assign_splits(d, "cluster", "url", "bad")


@query(
    "WITH g AS (SELECT o_orderkey k, o_orderkey % 60 + 1 AS rank FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT count(*) n FROM orders), r AS (SELECT k, (SELECT n FROM n) AS n_gold, (SELECT count(*) FROM g WHERE rank <= t.k) AS n_found FROM (VALUES (5), (10), (20), (40), (60)) t(k)) SELECT k::INT AS k, n_gold, n_found, (SELECT coalesce(min(k), 40) FROM r WHERE n_found >= 0.6 * n_gold)::INT AS top_k FROM r"
)
def recall_grid(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").selectExpr("o_orderkey AS pair")
    ranked = o.where("pair % 4 <> 0").withColumn("rank", F.expr("pair % 60 + 1"))
    r = S.recall_at(ranked, o, "pair", "rank", [5, 10, 20, 40, 60])
    return r.join(F.broadcast(S.choose_top_k(r, o.count(), 0.6))).select("k", "n_gold", "n_found", "top_k")


@query(
    "WITH e AS (SELECT c_custkey k, c_mktsegment v FROM customer), a AS (SELECT c_custkey k, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) || 'x' END v FROM customer WHERE c_custkey % 4 <> 0), j AS (SELECT e.k, e.v, a.v w, a.k ak FROM e LEFT JOIN a USING (k)) SELECT k AS c_custkey, CASE WHEN ak IS NULL THEN 'MISS' WHEN v = w THEN 'PASS' ELSE 'FAIL' END AS state, CASE WHEN w IS NULL THEN 'MISS' WHEN lower(v) = lower(w) THEN 'MATCH' ELSE 'MISMATCH' END AS field FROM j"
)
def field_states(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment AS v")
    actual = c.where("c_custkey % 4 <> 0").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN upper(v) ELSE concat(lower(v), 'x') END AS v")
    state = S.ground_truth(c, actual, ["c_custkey"], "v")
    return state.join(actual.withColumnRenamed("v", "w"), "c_custkey", "left").select("c_custkey", "state", S.compare_field(F.col("w"), F.col("v")).alias("field"))


@query("SELECT l_orderkey, round(100.0 * count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_returnflag <> 'N'), 0), 1) AS s, count(*) FILTER (l_returnflag <> 'N')::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'N') > 0")
def dimension_scores(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").selectExpr("l_orderkey", "CASE l_returnflag WHEN 'R' THEN 'MATCH' WHEN 'N' THEN 'SKIP' ELSE 'MISMATCH' END AS outcome")
    return S.dimension_scores(li, ["l_orderkey"], "outcome").where("n > 0").select("l_orderkey", F.col("score").alias("s"), "n")


@query(
    "WITH t AS (SELECT l_orderkey o, l_returnflag k, l_suppkey % 5 v, count(*) t FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT l_orderkey o, l_returnflag k, l_suppkey % 5 v, count(*) f FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2, 3) SELECT o AS l_orderkey, k AS l_returnflag, sum(t)::BIGINT AS n, sum(least(t, coalesce(f, 0)))::BIGINT AS n_kept FROM t LEFT JOIN f USING (o, k, v) GROUP BY 1, 2"
)
def kept_tokens(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_returnflag", "l_suppkey % 5 AS v", "l_linenumber")
    return S.retained_tokens(li, li.where("l_linenumber > 2"), ["l_orderkey"], "l_returnflag", "v")


@query(
    "WITH b AS (SELECT l_orderkey o, l_linenumber l, l_partkey p, l_suppkey s, l_quantity::DOUBLE w, l_linenumber::DOUBLE x FROM lineitem), i AS (SELECT *, greatest(0, least(w, x + 20) - greatest(0, x)) * 1.0 AS ov FROM b) SELECT o, l, p, s, w, round(coalesce(ov / nullif(w + 20 - ov, 0), 0), 9) AS iou FROM i"
)
def box_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Two boxes of height 1 on one line: [0, w] and [x, x + 20]; corners come in any order."""
    w, x = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    box = lambda a, b: F.array(b, F.lit(1.0), a, F.lit(0.0))
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), w.alias("w"), F.round(S.box_iou(box(F.lit(0.0), w), box(x, x + 20)), 9).alias("iou"))


@query(
    "WITH p AS (SELECT p_partkey k, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 10 END a, p_partkey % 10 + 5 b, p_partkey % 7 c, p_partkey % 7 + 3 d FROM part) SELECT k, CASE WHEN k % 9 = 0 THEN 'UNPARSED' WHEN a = c AND b = d THEN 'IDENTICAL' WHEN k % 11 = 0 THEN 'DIFFERENT_DIM' WHEN coalesce(a, -1e9) > d OR c > b THEN 'DISJOINT' WHEN (coalesce(a, -1e9) >= c AND b <= d) OR (c >= coalesce(a, -1e9) AND d <= b) THEN 'NESTED' ELSE 'OVERLAP' END AS relation FROM p"
)
def interval_relations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b, c, d = F.when(k % 4 != 0, (k % 10).cast("double")), (k % 10 + 5).cast("double"), (k % 7).cast("double"), (k % 7 + 3).cast("double")
    return read(spark, sf, "part").select(k.alias("k"), S.interval_relation(a, b, c, d, F.lit("m"), F.when((k % 11 == 0) & ~(a.eqNullSafe(c) & (b == d)), "s").otherwise("m"), k % 9 == 0).alias("relation"))


@query("SELECT l_orderkey, CASE WHEN bool_and(l_returnflag <> 'R' AND l_linenumber < 7) THEN 'PASS' ELSE 'FAIL' END AS state FROM lineitem GROUP BY 1")
def complete_citations(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey AS citation_id", "CASE WHEN l_returnflag = 'R' THEN ' ' ELSE 'n' END AS node_id", "CASE WHEN l_linenumber < 7 THEN 'p' END AS page_revision_id", "'q' AS quote")
    return S.citations_complete(li, ["l_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN least(0.9, CASE WHEN o_orderkey % 2 = 0 THEN 0.3 ELSE 0.5 END) ELSE 0.95 END::DOUBLE AS confidence FROM orders")
def line_confidences(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    doubts = F.when(k % 3 == 0, F.array(F.when(k % 2 == 0, "amount").otherwise("unheard of"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf, "orders").select("o_orderkey", S.line_text_confidence(F.lit(True), k % 3 == 0, doubts, {"arbitrated": 0.9, "verified": 0.95, "single": 0.7}, {"amount": 0.3}).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 2)")
def in_every_group(spark: SparkSession, sf: str) -> DataFrame:
    return S.in_every_group(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"), "l_partkey", ["l_linestatus"]).drop("l_linestatus")


# ---- tables and trees --------------------------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT l_orderkey k, sum(l_extendedprice::DECIMAL(18,2)) s, count(*) FILTER (l_quantity::DECIMAL(18,2) * (l_extendedprice / l_quantity)::DECIMAL(18,2) <> l_extendedprice::DECIMAL(18,2)) w FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey, list_filter([CASE WHEN w > 0 THEN 'LINE_AMOUNT_MISMATCH' END, CASE WHEN o_totalprice::DECIMAL(18,2) <> s THEN 'TOTAL_MISMATCH' END], lambda x: x IS NOT NULL) AS issues FROM l JOIN orders ON o_orderkey = k) "
    "SELECT o_orderkey, issues, CASE WHEN len(issues) = 0 THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS state FROM j"
)
def boq_check(spark: SparkSession, sf: str) -> DataFrame:
    d = "CAST({} AS DECIMAL(18,2))".format
    line = read(spark, sf, "lineitem").selectExpr("l_orderkey AS o_orderkey", "'line' AS role", f"{d('l_quantity')} AS quantity", f"{d('l_extendedprice / l_quantity')} AS price", f"{d('l_extendedprice')} AS amount", "CAST(NULL AS INT) AS tax_rate")
    total = read(spark, sf, "orders").selectExpr("o_orderkey", "'total' AS role", "CAST(NULL AS DECIMAL(18,2)) AS quantity", "CAST(NULL AS DECIMAL(18,2)) AS price", f"{d('o_totalprice')} AS amount", "CAST(NULL AS INT) AS tax_rate")
    known = line.select("o_orderkey").distinct()
    return B.check_boq(line.unionByName(total.join(known, "o_orderkey", "left_semi")), ["o_orderkey"])


@query(
    "WITH s AS (SELECT l_orderkey, l_linenumber, (l_tax * 1000)::INT / 10.0 AS p FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, round(sum(p), 6)::DOUBLE AS total, count(*) FILTER (p <= 0) bad, count(*) - count(DISTINCT l_linenumber) twice FROM s GROUP BY 1), i AS (SELECT *, list_filter([CASE WHEN bad > 0 THEN 'INVALID_PERCENT' END, CASE WHEN twice > 0 THEN 'DUPLICATE_LABEL' END, CASE WHEN total <> 100 THEN 'SUM_NOT_100' END], lambda x: x IS NOT NULL) issues FROM g) SELECT l_orderkey, n, total, issues, CASE WHEN len(issues) = 0 THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS state FROM i"
)
def payment_schedules(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").selectExpr("l_orderkey", "concat('Đợt ', l_linenumber) AS label", "concat(CAST(CAST(l_tax * 1000 AS DECIMAL(9,0)) / 10 AS DECIMAL(9,1)), '%') AS share")
    return B.payment_schedule(li, ["l_orderkey"], "label", "share").withColumn("total", F.col("total").cast("double"))


@query(
    "WITH t AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 4 = 0 THEN 'Giá trị' ELSE 'x' END c2, CASE WHEN o_orderkey % 3 = 0 THEN 'Thành tiền' ELSE 'y' END c3 FROM orders) SELECT k AS o_orderkey, CASE WHEN c2 <> 'x' AND c3 = 'y' THEN 1 WHEN c2 = 'x' AND c3 <> 'y' THEN 2 END::INT AS amount_column, CASE WHEN (c2 <> 'x') <> (c3 <> 'y') THEN 1 END::INT AS header_row, 3 AS n_rows FROM t"
)
def table_headers(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").selectExpr("o_orderkey", "array('Nội dung', CASE WHEN o_orderkey % 4 = 0 THEN 'Giá trị' ELSE 'x' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Thành tiền' ELSE 'y' END) AS h").withColumn("rows", F.array(F.array(F.lit("BẢNG"), F.lit(""), F.lit("")), F.col("h"), F.array(F.lit("Bơm"), F.lit("1"), F.lit("2"))))
    n = B.cells(o, ["o_orderkey"]).groupBy("o_orderkey").agg((F.max("row_no") + 1).alias("n_rows"))
    return o.select("o_orderkey", B.amount_column(F.col("h")).cast("int").alias("amount_column"), B.header_row(F.col("rows")).cast("int").alias("header_row")).join(n, "o_orderkey")


@query(
    "WITH f AS (SELECT l_orderkey k, l_linenumber n, l_partkey p, l_suppkey s, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 0.4 * (l_linestatus = 'O')::INT + 0.3 * (l_quantity > 20)::INT END::DOUBLE score FROM lineitem), m AS (SELECT *, score >= 0.6 AS merge FROM f) SELECT k, n, p, s, score, merge, sum((NOT merge)::INT) OVER (PARTITION BY k ORDER BY n, p, s ROWS UNBOUNDED PRECEDING)::BIGINT AS table_no FROM m"
)
def table_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments that merge by weighted signals, unless a gate holds, chained to tables."""
    li = read(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s", "l_linestatus = 'O' AS like_header", "l_quantity > 20 AS near_edge", "l_returnflag = 'R' AS gate")
    m = B.merge_score(li, {"like_header": 0.4, "near_edge": 0.3}, [F.col("gate")]).withColumn("at", F.struct("n", "p", "s"))
    return B.chain_fragments(m, ["k"], "at", "merge").select("k", "n", "p", "s", "score", "merge", "table_no")


@query(
    "SELECT o_orderkey, o_orderkey % 3 = o_custkey % 3 AS continues, CASE WHEN o_orderkey % 3 <> o_custkey % 3 THEN 0.0 WHEN o_orderkey % 100 >= 85 THEN greatest(0.9, (o_orderkey % 100) / 100.0) ELSE 0.75 END::DOUBLE AS confidence FROM orders"
)
def table_continuations(spark: SparkSession, sf: str) -> DataFrame:
    c = B.tables_continue(F.col("o_orderkey") % 3, F.col("o_custkey") % 3, F.col("o_orderkey") % 100)
    return read(spark, sf, "orders").select("o_orderkey", c["continues"].alias("continues"), c["confidence"].cast("double").alias("confidence"))


#: A tree of nations below regions below one root, by order of keys.
_TREE = "SELECT 'r' node_id, NULL parent_id, 0 ord, 'root' raw_label, 'R' AS text UNION ALL SELECT 'g' || r_regionkey, 'r', r_regionkey, 'region', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'g' || n_regionkey, n_nationkey, 'nation', n_name FROM nation"


@query(
    "SELECT 'r' AS node_id, 'R' || chr(10) || string_agg(line, chr(10) ORDER BY r, n) AS text FROM (SELECT r_regionkey r, -1 n, 'region ' || r_name line FROM region UNION ALL SELECT n_regionkey, n_nationkey, 'nation ' || n_name FROM nation)"
)
def collapsed_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The tree's root with a line for each node below, depth first."""
    return G.collapsed_to_roots(_tree(spark, sf), [])


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "region").selectExpr("concat('g', r_regionkey) AS node_id", "'r' AS parent_id", "CAST(r_regionkey AS INT) AS ord", "'region' AS raw_label", "r_name AS text")
    n = read(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS node_id", "concat('g', n_regionkey) AS parent_id", "CAST(n_nationkey AS INT) AS ord", "'nation' AS raw_label", "n_name AS text")
    root = spark.createDataFrame([("r", None, 0, "root", "R")], "node_id string, parent_id string, ord int, raw_label string, text string")
    return root.unionByName(g).unionByName(n)


@query("SELECT 'n' || n_nationkey AS node_id FROM nation WHERE n_regionkey = 1")
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    return G.descendants(_tree(spark, sf), [], "node_id", "parent_id", spark.createDataFrame([("g1",)], "node_id string")).select("node_id")


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey s, l_suppkey d FROM lineitem), r(node) AS (SELECT 1::BIGINT UNION SELECT d FROM e JOIN r ON s = node) SELECT node FROM r"
)
def reachable_parts(spark: SparkSession, sf: str) -> DataFrame:
    """What part 1 reaches when a line leads from its part to the part of its supplier's number."""
    e = read(spark, sf, "lineitem").selectExpr("l_partkey AS s", "l_suppkey AS d").distinct()
    return G.reachable(e, spark.createDataFrame([(1,)], "s long"), "s", "d")


@query(
    "WITH p AS (SELECT 'n' || n_nationkey node_id, 'AMENDS' op FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'g' || r_regionkey, 'AMENDS' FROM region UNION ALL SELECT 'g' || r_regionkey, 'REPEALS' FROM region) SELECT node_id, op FROM p WHERE op = 'REPEALS' OR node_id LIKE 'n%' OR node_id NOT IN (SELECT 'g' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0)"
)
def deepest_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Of edges that agree, those with a descendant that has the same edge go."""
    t = _tree(spark, sf)
    planned = t.where("node_id LIKE 'n%' AND ord % 2 = 0").selectExpr("node_id", "'AMENDS' AS op").unionByName(t.where("node_id LIKE 'g%'").selectExpr("node_id", "explode(array('AMENDS', 'REPEALS')) AS op"))
    return G.drop_nested(planned, G.ancestors(t, [], "node_id", "parent_id"), [], ["op"])


@query(
    "WITH e AS (SELECT o_orderkey id, o_custkey a, o_orderkey % 100 b FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT o_orderkey cid, o_orderkey % 100 a, o_custkey b, CASE WHEN o_orderkey % 2 = 0 THEN 'CANDIDATE_AMENDMENT' ELSE 'OTHER' END f FROM orders WHERE o_orderstatus = 'F'), k AS (SELECT e.*, least(a, b) x, greatest(a, b) y FROM e), ck AS (SELECT *, least(a, b) x, greatest(a, b) y FROM c) "
    "SELECT id, (SELECT arg_min(cid, cid) FROM ck WHERE f = 'OTHER' AND ck.x = k.x AND ck.y = k.y) AS linked_candidate FROM k WHERE NOT EXISTS (SELECT 1 FROM ck WHERE f = 'CANDIDATE_AMENDMENT' AND ck.x = k.x AND ck.y = k.y)"
)
def edge_findings(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    edges = o.where("o_orderstatus = 'O'").selectExpr("o_orderkey AS id", "o_custkey AS node_a", "o_orderkey % 100 AS node_b")
    cand = o.where("o_orderstatus = 'F'").selectExpr("o_orderkey AS candidate_id", "o_orderkey AS ord", "o_orderkey % 100 AS node_a", "o_custkey AS node_b", "CASE WHEN o_orderkey % 2 = 0 THEN 'CANDIDATE_AMENDMENT' ELSE 'OTHER' END AS finding")
    return G.edge_findings(edges, cand).select("id", "linked_candidate")


@query(
    "WITH l AS (SELECT l_orderkey d, l_linenumber p, CASE WHEN l_linenumber % 2 = 0 THEN 'top' ELSE 'bottom' END b, 'Trang ' || l_linenumber || CASE WHEN l_partkey % 3 = 0 THEN ' x' ELSE '' END t FROM lineitem), n AS (SELECT d, count(DISTINCT p) n FROM l GROUP BY 1 HAVING count(DISTINCT p) > 1), g AS (SELECT d, b, replace(replace(lower(t), 'trang ' || p, 'trang #'), '  ', ' ') m, count(DISTINCT p) k FROM l GROUP BY 1, 2, 3) SELECT d, b AS band, m AS masked FROM g JOIN n USING (d) WHERE k >= 0.6 * n"
)
def repeated_bands(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").selectExpr("l_orderkey AS d", "l_linenumber AS p", "CASE WHEN l_linenumber % 2 = 0 THEN 'top' ELSE 'bottom' END AS band", "concat('Trang ', l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN ' x' ELSE '' END) AS t")
    return X.repeated_bands(li, ["d"], "p", "band", "t")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'contract_no' ELSE 'date' END AS field, CASE WHEN o_orderkey % 2 = 0 THEN 'HD-' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw_value FROM orders WHERE o_orderkey % 3 <> 0")
def labelled_fields(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").selectExpr("o_orderkey", "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'Khác' WHEN o_orderkey % 2 = 0 THEN 'Số HĐ' ELSE 'Ngày ký' END, ':  ', CASE WHEN o_orderkey % 2 = 0 THEN concat('HD-', o_orderkey) ELSE date_format(o_orderdate, 'yyyy-MM-dd') END, ' ') AS line")
    return X.labelled_fields(o, ["o_orderkey"], {"contract_no": "^so hd", "date": "^ngay"})


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NEW_PARAGRAPH' WHEN 1 THEN 'NEW_HEADING' WHEN 2 THEN 'MERGE_HYPHEN' WHEN 3 THEN 'MERGE' ELSE 'UNSURE' END AS action, round(least(1, greatest(0, 0.5 * (p_partkey % 7) - 0.25))::DOUBLE, 9) AS confidence FROM part")
def page_break_actions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (k % 5 + 1).cast("int"))
    conf = X.final_confidence({"a": k % 7 * 1.0, "b": F.lit(1.0), "c": F.lit(None).cast("double")}, {"a": 0.5, "b": -0.25, "c": 9.0})
    return read(spark, sf, "part").select("p_partkey", X.boundary_action(pick("hết.", "a", "một hợp-", "câu dài", "Câu"), pick("Mới", "Điều 2. b", "đồng", "tiếp", "Mới")).alias("action"), F.round(conf, 9).alias("confidence"))


@query(None)
def near_duplicate_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The least document of each cluster of near-duplicates: all pairs are too slow for SQL, so tests hold it against brute force."""
    return D.near_duplicate_clusters(read(spark, sf, "documents"))


_CLAUSES = "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) n, role FROM conversations"


@query(
    f"WITH c AS ({_CLAUSES}), p AS (SELECT doc_id, n, role, unnest([1, 2, 3, 4]) l FROM c) SELECT doc_id, (5 * (n - 1) + l)::INT AS node_no, CASE l WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE l END::INT AS level, CASE l WHEN 1 THEN 'Điều ' || n WHEN 2 THEN '1.' WHEN 3 THEN 'a)' ELSE '2.' END AS label, CASE l WHEN 1 THEN NULL WHEN 3 THEN 5 * (n - 1) + 2 ELSE 5 * (n - 1) + 1 END::INT AS parent_no, CASE l WHEN 1 THEN role WHEN 2 THEN 'khoản một' WHEN 3 THEN 'điểm' ELSE 'khoản hai' || chr(10) || 'tiếp' END AS text FROM p"
)
def clause_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A contract of each conversation, an article with clauses and a point for each turn, cut into its units."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = read(spark, sf, "conversations").withColumn("n", F.row_number().over(w))
    body = F.concat(F.lit("Điều "), F.col("n").cast("string"), F.lit(". "), F.col("role"), F.lit("\n1. khoản một\na) điểm\n2. khoản hai\ntiếp"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("t")))), lambda x: x["t"]), "\n")
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(text.alias("text"))
    rows = D.lines(docs, ["doc_id"]).withColumn("line_no", F.col("line_no") + 1)
    return D.segment_clauses(rows)
