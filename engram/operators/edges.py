"""The edge table: validation, idempotent merge, deletion, roll-back and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.schema import EDGE_KEY
from engram.settings import EDGE_TYPES, SYMMETRIC_STORED


def problem(edges: DataFrame) -> Column:
    """What is wrong with an edge, null if nothing is."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return (
        F.when(~F.coalesce(F.col("edge_type").isin(*EDGE_TYPES), F.lit(False)), "edge_type")
        .when(blank("source_id") | blank("target_id"), "endpoint")
        .when(F.col("source_id") == F.col("target_id"), "self_loop")
        .when(~F.coalesce(F.col("weight").between(0, 1) & ~F.isnan("weight"), F.lit(False)), "weight")
        .when(blank("created_by"), "created_by")
        .when(blank("run_id"), "run_id")
    )


def canonical(edges: DataFrame) -> DataFrame:
    """Edges of symmetric types with the smaller id first."""
    flip = F.col("edge_type").isin(*SYMMETRIC_STORED) & (F.col("source_id") > F.col("target_id"))
    return edges.withColumns({"source_id": F.when(flip, F.col("target_id")).otherwise(F.col("source_id")), "target_id": F.when(flip, F.col("source_id")).otherwise(F.col("target_id"))})


def with_endpoints(edges: DataFrame, nodes: DataFrame, key: str = "memory_id") -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select(F.col(key).alias("__id")).distinct()
    for end in ("source_id", "target_id"):
        edges = edges.join(ids, F.col(end) == F.col("__id"), "left_semi")
    return edges


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with new merged in: greatest weight, latest last_seen_at, all else as first stored. Merging twice changes nothing."""
    both = stored.withColumn("batch", F.lit(0)).unionByName(canonical(new).withColumn("batch", F.lit(1)))
    rest = [c for c in stored.columns if c not in (*EDGE_KEY, "weight", "last_seen_at")]
    first = F.min_by(F.struct(*rest), F.struct("batch", "created_at", "created_by", "run_id"))
    out = both.groupBy(*EDGE_KEY).agg(F.max("weight").alias("weight"), F.max("last_seen_at").alias("last_seen_at"), first.alias("first"))
    return out.select(*(F.col(f"first.{c}") if c in rest else F.col(c) for c in stored.columns))


def merge_mentions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions by (memory_id, project, name): the weight stays, last_seen_at moves on."""
    key = ["memory_id", "project", "name"]
    both = stored.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    rest = [c for c in stored.columns if c not in (*key, "last_seen_at")]
    out = both.groupBy(*key).agg(F.max("last_seen_at").alias("last_seen_at"), F.min_by(F.struct(*rest), F.struct("batch", "created_at")).alias("first"))
    return out.select(*(F.col(f"first.{c}") if c in rest else F.col(c) for c in stored.columns))


def matching(source_id=None, target_id=None, edge_type=None, run_id=None, created_by=None, after=None) -> Column:
    """A condition on edges from what is given; at least one must be."""
    given = {"source_id": source_id, "target_id": target_id, "edge_type": edge_type, "run_id": run_id, "created_by": created_by}
    parts = [F.col(k) == v for k, v in given.items() if v is not None] + ([F.col("created_at") > after] if after is not None else [])
    if not parts:
        raise ValueError("a deletion needs a condition")
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return F.coalesce(out, F.lit(False))


def delete(edges: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The edges that stay, and (edge_type, removed) counts."""
    return edges.where(~condition), edges.where(condition).groupBy("edge_type").agg(F.count("*").alias("removed"))


def rollback(edges: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """delete() of one run; wildcards and blank ids are refused."""
    if not run_id or not run_id.strip() or run_id.strip() in ("*", "%", "all", "ALL"):
        raise ValueError("a roll-back needs the id of one run")
    return delete(edges, matching(run_id=run_id.strip()))


def without_nodes(edges: DataFrame, gone: DataFrame, key: str = "memory_id") -> DataFrame:
    """Edges that touch none of the given nodes."""
    ids = gone.select(F.col(key).alias("__id")).distinct()
    for end in ("source_id", "target_id"):
        edges = edges.join(ids, F.col(end) == F.col("__id"), "left_anti")
    return edges


def type_stats(edges: DataFrame) -> DataFrame:
    """Count, mean, least and greatest weight of every known type, with zeros for absent ones."""
    spark = edges.sparkSession
    types = spark.createDataFrame([(t,) for t in EDGE_TYPES], "edge_type string")
    own = edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.avg("weight").alias("avg_weight"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))
    return types.join(own, "edge_type", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def per_node(edges: DataFrame) -> DataFrame:
    """(node, edge_type, n): edges at each node, either end."""
    ends = edges.select("edge_type", F.explode(F.array("source_id", "target_id")).alias("node"))
    return ends.groupBy("node", "edge_type").agg(F.count("*").alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge as (node, other) from either end, with its direction."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), F.lit("out").alias("direction"), *rest)
    return out.unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), F.lit("in").alias("direction"), *rest))


def neighbors(edges: DataFrame, node, types: list[str] | None = None, direction: str = "both", min_weight: float = 0.0, limit: int = 20) -> DataFrame:
    """(node, other, direction, ...) at a node, by weight, then latest first; limit 0 is no limit."""
    rows = edges.where(F.col("weight") >= min_weight)
    if types:
        rows = rows.where(F.col("edge_type").isin(*types))
    rows = rows.where({"out": F.col("source_id") == node, "in": F.col("target_id") == node, "both": (F.col("source_id") == node) | (F.col("target_id") == node)}[direction])
    found = both_ways(rows).where(F.col("node") == node)
    if direction != "both":
        found = found.where(F.col("direction") == direction)
    found = found.orderBy(F.desc("weight"), F.desc_nulls_first("created_at"), "other", "edge_type")
    return found.limit(limit) if limit else found
