"""Retrieval quality: recall at k, reciprocal rank, and the gate between two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.settings import DEFAULTS


def quality(judged: DataFrame, k: int = 10, threshold: float = DEFAULTS.recall_threshold) -> DataFrame:
    """(query_id, recall_at_k, mrr) of judged(query_id, rank, score).

    Recall is relevant rows in the first k over k; mrr is 1 / the first relevant row's rank, or 0.
    """
    if k <= 0:
        return judged.select("query_id").distinct().select("query_id", F.lit(0.0).alias("recall_at_k"), F.lit(0.0).alias("mrr"))
    good = (F.col("score") >= threshold) & (F.col("rank") <= k)
    return judged.groupBy("query_id").agg((F.count_if(good) / F.lit(float(k))).alias("recall_at_k"), F.coalesce(1.0 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("mrr"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, side, recall and mrr before and after): side is common, before_only or after_only."""
    b = before.select("query_id", F.col("recall_at_k").alias("recall_before"), F.col("mrr").alias("mrr_before"), F.lit(True).alias("__b"))
    a = after.select("query_id", F.col("recall_at_k").alias("recall_after"), F.col("mrr").alias("mrr_after"), F.lit(True).alias("__a"))
    side = F.when(F.col("__a").isNull(), "before_only").when(F.col("__b").isNull(), "after_only").otherwise("common")
    return b.join(a, "query_id", "full").select("query_id", side.alias("side"), "recall_before", "recall_after", "mrr_before", "mrr_after")


def gate(compared: DataFrame, delta: float = DEFAULTS.gate_delta) -> DataFrame:
    """One row over the common queries: mean changes, and whether either reaches delta."""
    one = compared.where("side = 'common'").agg(
        F.count("*").alias("n_common"), F.coalesce(F.avg(F.col("recall_after") - F.col("recall_before")), F.lit(0.0)).alias("recall_delta"),
        F.coalesce(F.avg(F.col("mrr_after") - F.col("mrr_before")), F.lit(0.0)).alias("mrr_delta"),
    )
    return one.withColumn("passed", (F.col("recall_delta") >= delta) | (F.col("mrr_delta") >= delta))
