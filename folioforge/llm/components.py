"""Connected components of a table of links, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import written
from folioforge.sources.shared import discard


#: Links for each task: small sets of links are not dealt over more tasks than they need.
LINKS_A_TASK = 100_000


def _mins(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of a link. Links to itself and repeated links do no harm; no links give no rows.

    Large-star and small-star steps (joins with each node's least neighbour, so a hub's links never meet in one
    row) run until the links no longer change; the count of rounds grows as the square of the logarithm at most.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct().coalesce(16), "cc")
    tasks = 4 + edges.count() // LINKS_A_TASK
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        large = both.join(_mins(both).coalesce(tasks), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").coalesce(tasks)
        least = _mins(large).coalesce(tasks)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").coalesce(tasks).distinct()
        before, edges = edges, written(small.coalesce(tasks), "cc")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(tasks))
