"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links ``u > v``.

    The smallest neighbour of each node is a map-side combined aggregate, written down before it is joined back, so
    that both sides of the join are plain shuffles and Spark can split the partition of a node with very many links.
    """
    around = links.union(links.select("v", "u")).toDF("u", "v") if large else links
    least = cut_lineage(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    joined = around.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return cut_lineage(moved.where("u > v").distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node reachable.

    Links are undirected; loops and repeated links are allowed, links with a null end are left out. An empty table
    gives an empty result. Work per round is a few shuffles of the links; the rounds grow with the logarithm of
    the longest chain.
    """
    x, y = F.col(a), F.col(b)
    links = links.where(x.isNotNull() & y.isNotNull() & (x != y))
    links = cut_lineage(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(links)
    while seen[0]:
        links = _star(_star(links, True), False)
        if (now := mark(links)) == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
