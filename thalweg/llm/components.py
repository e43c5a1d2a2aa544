"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u but the least of its component, with v the least: one row each.

    edges: longs u and v, neither null (rows with a null are no links and join nothing); repeated links count once, and a
    table without rows gives none. Rounds grow with the logarithm of the longest chain. Minima are partly aggregated before
    the shuffle, and the joins back are equi-joins whose large partitions adaptive execution splits. Each round is
    written into the shared folder, so a lost executor costs its own tasks and no more.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = None
    while True:
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == was or not said[0]:
            return now
        was = said
        now = keep(_small_star(_large_star(now)), "edges")
