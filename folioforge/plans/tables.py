"""Table arithmetic on orders and their lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.operators import tables as T
from folioforge.plans.catalog import query, read
from folioforge.plans.scalars import fold_sql


@query(
    "WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END f FROM lineitem), d AS (SELECT DISTINCT * FROM r) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate, coalesce(last_value(nullif(f, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f) AS flag FROM d"
)
def filled_down(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]
    r = read(spark, sf, "lineitem").select("l_orderkey", *cols, F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("flag")).distinct()
    r = r.withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "flag"))
    return T.fill_down(r, ["l_orderkey"], ["flag"], "o").drop("o", "filled_down")


@query(
    "WITH s AS (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) p FROM lineitem) SELECT l_orderkey, list_filter([CASE WHEN max(l_linenumber) <> count(*) THEN 'ROW_COUNT' END, CASE WHEN bool_or(l_linenumber < p) THEN 'ANCHOR_DECREASE' END, CASE WHEN bool_or(l_linenumber > p + 1) THEN 'ANCHOR_GAP' END], lambda x: x IS NOT NULL) AS issues FROM s GROUP BY 1"
)
def anchor_checks(spark: SparkSession, sf: str) -> DataFrame:
    return T.validate_anchors(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber", "l_linenumber")


@query(
    "WITH e AS (SELECT o_custkey k, o_orderkey id, (o_orderkey % 3)::INT w, o_orderkey % 20 a, strftime(o_orderdate, '%Y')::INT * 12 + month(o_orderdate) pg FROM orders), f AS (SELECT k, pg, arg_max({'id': id, 'w': w, 'a': a}, id) l, arg_min({'id': id, 'w': w, 'a': a}, id) f FROM e GROUP BY 1, 2) SELECT a.k AS k, a.l.id AS table_id, b.f.id AS next_table_id FROM f a JOIN f b ON a.k = b.k AND b.pg = a.pg + 1 WHERE a.l.w = b.f.w AND b.f.a = a.l.a + 1"
)
def table_continuity(spark: SparkSession, sf: str) -> DataFrame:
    from folioforge.operators.relational import legacy_continuity

    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 3).cast("int").alias("width"), (F.col("o_orderkey") % 20).alias("first_anchor"), (F.col("o_orderkey") % 20).alias("last_anchor"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("page"))
    return legacy_continuity(o, ["k"])


@query(
    f"""WITH r AS (SELECT l_orderkey k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 i,
  [l_partkey::VARCHAR, l_quantity::BIGINT::VARCHAR, strftime(l_shipdate, '%Y-%m-%d')] c, ['p' || (l_suppkey % 5), NULL, 's' || year(l_shipdate)] p FROM lineitem),
t AS (SELECT o_orderkey k, o_orderkey % 3 + 2 w, coalesce(n, 0) n, least(coalesce(n, 0), 6, 14 // (o_orderkey % 3 + 2)) lim FROM orders LEFT JOIN (SELECT k, count(*) n FROM r GROUP BY 1) m ON m.k = o_orderkey WHERE contains({fold_sql("o_orderpriority")}, 'medium') OR contains({fold_sql("o_orderpriority")}, 'urgent')),
x AS (SELECT k, i, c[1:w] c, flatten(list(p[1:w]) OVER (PARTITION BY k ORDER BY i)) q FROM r JOIN t USING (k) WHERE i < lim),
y AS (SELECT k, i, c, len(list_distinct(q)) > 4 over_pages FROM x),
g AS (SELECT k, count(*) FILTER (NOT over_pages) kept, sum(len(c)) FILTER (NOT over_pages) cells, bool_or(over_pages) hit, string_agg(array_to_string(c, ','), ';' ORDER BY i) FILTER (NOT over_pages) body FROM y GROUP BY 1)
SELECT k AS table_id, n AS source_rows, coalesce(kept, 0)::BIGINT AS processed_rows, (n * w)::BIGINT AS source_cells, coalesce(cells, 0)::BIGINT AS processed_cells, CASE WHEN hit THEN 'page cap reached' WHEN lim < n THEN 'row or cell cap reached' END AS reason, NOT coalesce(hit, false) AND lim >= n AS complete, coalesce(body, '') AS body FROM t LEFT JOIN g USING (k)"""
)
def bounded_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of two priorities as tables of their lines, two to four columns wide, within 6 rows, 14 cells and 4 pages."""
    li = read(spark, sf, "lineitem")
    place = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = li.select(
        F.col("l_orderkey").alias("table_id"), (F.row_number().over(place) - 1).alias("row_index"),
        F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("cells"),
        F.array(F.concat(F.lit("p"), F.col("l_suppkey") % 5), F.lit(None).cast("string"), F.concat(F.lit("s"), F.year("l_shipdate"))).alias("pages"),
    )
    n = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_rows"))
    tables = read(spark, sf, "orders").join(n, "o_orderkey", "left").select(F.col("o_orderkey").alias("table_id"), F.array("o_orderpriority", "o_orderstatus").alias("header"), "n_rows", (F.col("o_orderkey") % 3 + 2).alias("n_cols"))
    got = T.bounded_tables(tables, rows, ("medium", "urgent"), max_rows=6, max_cells=14, max_pages=4)
    body = F.array_join(F.transform(F.coalesce("rows", F.array()), lambda r: F.array_join(r["cells"], ",")), ";")
    return got.select("table_id", F.col("n_rows").alias("source_rows"), "processed_rows", "source_cells", "processed_cells", "reason", "complete", body.alias("body"))
