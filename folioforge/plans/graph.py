"""Trees and edges on the star schema: regions, nations and customers as a tree."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import graph as G
from folioforge.plans.catalog import query, read

_TREE = (
    "tree AS (SELECT 'r' || r_regionkey node, NULL parent, r_name label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"
)


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = read(spark, sf, "region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    n = read(spark, sf, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    s = read(spark, sf, "supplier").select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("parent"), F.col("s_name").alias("label"))
    return r.unionByName(n).unionByName(s)


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT node, parent ancestor, 1 distance FROM tree WHERE parent IS NOT NULL UNION ALL SELECT u.node, t.parent, u.distance + 1 FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.parent IS NOT NULL) SELECT node, ancestor, distance FROM up")
def region_tree_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return G.ancestors(_tree(spark, sf), [], "node", "parent")


@query(f"WITH RECURSIVE {_TREE}, d AS (SELECT node, label AS breadcrumb FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, d.breadcrumb || ' > ' || t.label FROM tree t JOIN d ON t.parent = d.node) SELECT node, breadcrumb FROM d")
def breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    return G.breadcrumbs(_tree(spark, sf), [], "node", "parent", "label")


@query("WITH t AS (SELECT p_partkey, p_brand FROM part), c AS (SELECT p_brand, count(*) n, min(p_partkey) t FROM t GROUP BY 1) SELECT s_suppkey, CASE WHEN n IS NULL THEN 'MISSING' WHEN n = 1 THEN 'EDGE' ELSE 'AMBIGUOUS' END AS state, CASE WHEN n = 1 THEN t END AS target FROM (SELECT s_suppkey, 'Brand#' || (s_suppkey % 60) p_brand FROM supplier) LEFT JOIN c USING (p_brand)")
def reference_resolution(spark: SparkSession, sf: str) -> DataFrame:
    refs = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("p_brand"))
    edges, missing, many = G.resolved(refs, read(spark, sf, "part").select("p_brand", "p_partkey"), [], "s_suppkey", "p_partkey", "p_brand")
    row = lambda d, s, t: d.select("s_suppkey", F.lit(s).alias("state"), t.alias("target"))
    none = F.lit(None).cast("long")
    return row(edges, "EDGE", F.col("p_partkey")).unionByName(row(missing, "MISSING", none)).unionByName(row(many, "AMBIGUOUS", none))


@query("SELECT a.s_suppkey AS from_node, b.s_suppkey AS to_node, 'SAME_CLAUSE' AS type FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey % 4 < b.s_suppkey % 4")
def same_key_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").select((F.col("s_suppkey") % 4).alias("file"), F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("node"))
    return G.same_key_links(s, [], "file", "key", "node")


@query("WITH b AS (SELECT l_orderkey % 100 k, count(DISTINCT l_partkey) n, min(l_partkey) p FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' WHEN p = o_custkey THEN 'SAME' ELSE 'DIFFERENT' END AS state FROM orders LEFT JOIN b ON k = o_orderkey % 150")
def implicit_matches(spark: SparkSession, sf: str) -> DataFrame:
    body = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("k"), F.col("l_partkey").alias("node"), F.col("l_partkey").alias("v"))
    annex = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 150).alias("k"), F.col("o_custkey").alias("v"))
    return G.implicit_matches(annex, body, ["k"], "v", "node").select("o_orderkey", "state")


@query("SELECT n_nationkey, sha256(n_regionkey || chr(31) || n_name || chr(31)) AS edge_id FROM nation")
def edge_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_nationkey", G.edge_id(F.col("n_regionkey"), F.col("n_name"), F.lit(None)).alias("edge_id"))


@query(
    "WITH n AS (SELECT DISTINCT l_orderkey // 4 d, l_orderkey f, l_linenumber k FROM lineitem) SELECT d AS dossier_id, a.f || ':' || a.k AS from_node, b.f || ':' || b.k AS to_node, 'SAME_CLAUSE' AS type FROM n a JOIN n b USING (d, k) WHERE a.f < b.f UNION ALL SELECT a.d, a.f || ':' || a.k, a.f || ':' || b.k, CASE WHEN a.k % 2 = 0 THEN 'AMENDS' ELSE 'REFERENCES' END FROM n a JOIN n b ON a.f = b.f AND b.k = a.k - 1"
)
def relation_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Typed edges over the articles of four contracts to a dossier, each of which names the article before it."""
    n = read(spark, sf, "lineitem").selectExpr("l_orderkey DIV 4 AS dossier_id", "l_orderkey AS file_id", "l_linenumber AS k").distinct()
    nodes = n.selectExpr("dossier_id", "file_id", "concat_ws(':', file_id, k) AS node_id", "CAST(NULL AS STRING) AS parent_id", "'CLAUSE' AS node_type", "concat('Điều ', k) AS label", "concat(CASE WHEN k % 2 = 0 THEN 'Sửa đổi Điều ' ELSE 'theo Điều ' END, k - 1) AS text")
    return G.relation_graph(nodes)[0]
