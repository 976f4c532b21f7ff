"""Connected components of a link table by alternating star operations; nothing reaches the driver but whether it is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevanta.llm.common import staged


#: Links of one task.
LINKS = 20_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _are_stars(edges: DataFrame, tasks: int) -> bool:
    """Whether every node either hangs on one smaller node or has others hanging on it: then components are found."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("x"))
    nodes = ends.groupBy("x.n").agg(F.sum("x.hangs").alias("hangs"), F.max("x.holds").alias("holds")).coalesce(tasks)
    return not nodes.agg(F.coalesce(F.bool_or(F.col("hangs") + F.col("holds") > 1), F.lit(False))).first()[0]


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes of ``links(u, v)``; a component is named by its smallest node.

    Each round joins links with the smallest neighbour of each node and is written out. The neighbours are written before
    the join, so that both of its sides are plain shuffles and Spark can split the links of a node that has very many.
    Rounds grow with the logarithm of the longest chain. Small tables are written by few tasks.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    tasks = max(12, edges.count() // LINKS)
    while not _are_stars(edges, tasks):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = staged(_least(both).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "near")
        large = staged(both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct().coalesce(tasks), "large")
        least = staged(_least(large).coalesce(tasks), "least")
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct().coalesce(tasks), "links")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
