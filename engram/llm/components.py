"""Connected components of an edge table, by alternating large-star and small-star steps.

Kiveris et al. 2014. Each step is a sum by node and a join; every round is written to the shared
folder, so lineage stays short and a lost executor costs one round at most. Nothing but a count
and a checksum of the edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(u, v), u != v; root is the least node of its component."""
    edges = materialize(spark, _small(edges), "edges", light=True)
    mark = _mark(edges)
    while mark[0]:
        edges = materialize(spark, _small(_large(edges)), "edges", light=True)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
