"""The driver's tables as the store's logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that queries take as now.
NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as items: project is the label, category and time follow from label and id."""
    kind = F.element_at(F.array(*map(F.lit, ("debug", "context", "research", "decision", "pattern"))), (F.col("label") % 5 + 1).cast("int"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("vec_id") % 40) * 86400)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("memory_id"), "embedding", F.col("label").alias("project"), kind.alias("category"),
        F.when(F.col("label") < 5, "decision").otherwise("note").alias("memory_type"), at.alias("event_time"),
    )


VECTORS_SQL = """vectors as (select vec_id as memory_id, embedding::DOUBLE[] as embedding, label as project,
  ['debug', 'context', 'research', 'decision', 'pattern'][label % 5 + 1] as category, case when label < 5 then 'decision' else 'note' end as memory_type,
  timestamp '2024-01-01 00:00:00' + to_days((vec_id % 40)::INTEGER) as event_time from embeddings)"""


def first_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query vector: one row."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as events of sessions."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("event_seq"), F.col("role").alias("memory_type"), "text",
    )


TURNS_SQL = "turns as (select conv_id * 1000 + turn as memory_id, conv_id as session_id, turn as event_seq, role as memory_type, text from conversations)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a timeline: project is the user, entity the number in props."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("memory_id"), F.col("event_id").alias("event_seq"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("memory_type"),
        F.col("user_id").alias("project"), "value", "props",
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as mentions: an order mentions its parts."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("memory_id"), F.lit("all").alias("project"), F.col("l_partkey").alias("name"), F.col("l_shipdate").alias("last_seen_at")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as edges from order to part, the type by line number, the weight by discount."""
    kind = F.element_at(F.array(*map(F.lit, ("SIMILAR_TO", "CO_OCCURS", "MEMORY_FOLLOWS", "SUPERSEDES", "CAUSED_BY", "PROMOTED_FROM", "COMPACTED_FROM"))), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), kind.alias("edge_type"), (F.col("l_discount") * 10).alias("weight"),
        F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("last_seen_at"), F.lit("loader").alias("created_by"), F.concat(F.lit("run"), (F.col("l_suppkey") % 5).cast("string")).alias("run_id"),
        F.lit(1).alias("edge_version"), F.lit(None).cast("string").alias("metadata"),
    )


EDGES_SQL = """edges as (select 'o' || l_orderkey as source_id, 'p' || l_partkey as target_id,
  ['SIMILAR_TO', 'CO_OCCURS', 'MEMORY_FOLLOWS', 'SUPERSEDES', 'CAUSED_BY', 'PROMOTED_FROM', 'COMPACTED_FROM'][l_linenumber] as edge_type,
  l_discount * 10 as weight, l_shipdate as created_at, l_shipdate as last_seen_at, 'loader' as created_by, 'run' || (l_suppkey % 5) as run_id from lineitem)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, supplier and customer as a graph."""
    edge = lambda t, a, x, b, y, w, k: table(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("source_id"), F.concat(F.lit(b), y).alias("target_id"), F.lit(w).alias("weight"), F.lit(k).alias("edge_type"))
    out = edge("nation", "n", "n_nationkey", "r", "n_regionkey", 0.9, "SIMILAR_TO").unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey", 0.8, "CO_OCCURS"))
    return out.unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey", 0.7, "MEMORY_FOLLOWS")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


PLACES_SQL = """places as (select 'n' || n_nationkey as source_id, 'r' || n_regionkey as target_id, 0.9::DOUBLE as weight, 'SIMILAR_TO' as edge_type from nation
  union all select 's' || s_suppkey, 'n' || s_nationkey, 0.8::DOUBLE, 'CO_OCCURS' from supplier union all select 'c' || c_custkey, 'n' || c_nationkey, 0.7::DOUBLE, 'MEMORY_FOLLOWS' from customer),
ways as (select source_id as node, target_id as other, weight, edge_type, 'out' as direction from places union all select target_id, source_id, weight, edge_type, 'in' from places)"""
