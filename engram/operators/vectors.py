"""Vector search: cosine, k nearest, similarity edges, duplicate and conflict probes, diverse selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.operators.index import block_scores, scaled
from engram.settings import DEFAULTS


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where the product of the norms is below 1e-10."""
    den = norm(a) * norm(b)
    return F.when(den < 1e-10, F.lit(0.0)).otherwise(dot(a, b) / den)


def non_zero(v: Column) -> Column:
    """Whether a vector has any component other than 0."""
    return F.exists(v, lambda x: x != 0)


def top_k(vectors: DataFrame, query: list[float], k: int, condition: Column | None = None) -> DataFrame:
    """The k rows nearest the query, with score. The condition is applied before any scoring."""
    rows = vectors if condition is None else vectors.where(condition)
    # the query is one literal; its norm is folded to a constant
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "memory_id").limit(k)


def neighbors(vectors: DataFrame, threshold: float = DEFAULTS.similar_threshold, pool: int = DEFAULTS.similar_pool, top: int = DEFAULTS.similar_top, asked: DataFrame | None = None) -> DataFrame:
    """(project, source_id, target_id, score, rank): each row's nearest in its project at or above the threshold; of the rows of asked(memory_id) only, if given.

    Exact, and so quadratic in a project's rows where all are asked: both sides lie in counted blocks of a
    project, a pair of blocks is one matrix product. VectorIndex is for projects too large for that.
    """
    if asked is not None:  # other projects have no part in it
        vectors = vectors.join(vectors.join(asked.select("memory_id"), "memory_id", "left_semi").select("project").distinct(), "project", "left_semi")
    rows = scaled(vectors, ["memory_id", "project"]).withColumn("cell", F.lit(0))
    left = rows if asked is None else rows.join(asked.select("memory_id"), "memory_id", "left_semi")
    right = rows.withColumnRenamed("memory_id", "target_id")
    scored = block_scores(left.withColumnRenamed("memory_id", "source_id"), right, threshold, min(pool, top) + 1).where("source_id != target_id")
    rank = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= min(pool, top)).select("project", "source_id", "target_id", "score", "rank")


def similarity_edges(vectors: DataFrame, **how) -> DataFrame:
    """(source_id, target_id, weight): undirected edges, the smaller id first, with the greatest weight."""
    n = neighbors(vectors, **how)
    return n.groupBy(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id")).agg(F.max("score").alias("weight"))


def probe(new: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(new_id, memory_id, score, rank): the k stored rows nearest each new row. Ranks come before any exclusion."""
    one = lambda rows, name: scaled(rows, ["memory_id"]).select(F.lit(0).alias("project"), F.lit(0).alias("cell"), F.col("memory_id").alias(name), "u")
    scored = block_scores(one(new, "source_id"), one(stored, "target_id"), float("-inf"), k, one_cell=True).select(F.col("source_id").alias("new_id"), F.col("target_id").alias("memory_id"), "score")
    rank = F.row_number().over(W.partitionBy("new_id").orderBy(F.desc("score"), "memory_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def duplicates(new: DataFrame, stored: DataFrame, threshold: float = DEFAULTS.duplicate_threshold, k: int = 3) -> DataFrame:
    """(new_id, memory_id, score): for each new row the best of its k nearest at or above the threshold, itself excluded."""
    hits = probe(new, stored, k).where((F.col("score") >= threshold) & (F.col("new_id") != F.col("memory_id")))
    first = F.row_number().over(W.partitionBy("new_id").orderBy("rank"))
    return hits.withColumn("first", first).where("first = 1").select("new_id", "memory_id", "score")


def conflicts(new: DataFrame, stored: DataFrame, low: float = DEFAULTS.conflict_low, high: float = DEFAULTS.duplicate_threshold, kind: str = "decision", k: int = 5) -> DataFrame:
    """(new_id, memory_id, score): those of the k nearest rows of one type that are alike but no duplicates."""
    hits = probe(new, stored.where(F.col("memory_type") == kind), k)
    return hits.where((F.col("score") >= low) & (F.col("score") < high) & (F.col("new_id") != F.col("memory_id"))).select("new_id", "memory_id", "score")


def nearest_squared(cache: DataFrame, query: list[float], k: int = 5, limit: float = 0.18) -> DataFrame:
    """Cached rows within a squared distance of the query, the nearest first."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = F.aggregate(F.zip_with("embedding", q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return cache.withColumn("distance", d).orderBy("distance", "memory_id").limit(k).where(F.col("distance") < limit)


def select_diverse(relevance: np.ndarray, vectors: np.ndarray, lam: float, top: int) -> list[int]:
    """Greedy choice: lam * relevance - (1 - lam) * greatest cosine to what was chosen; ties go to the earlier row."""
    span = relevance.max() - relevance.min()
    rel = (relevance - relevance.min()) / span if span > 1e-10 else np.ones(len(relevance))
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-10)
    chosen = [int(np.argmax(rel))]
    near = v @ v[chosen[0]]
    while len(chosen) < min(top, len(rel)):
        value = lam * rel - (1 - lam) * near
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
        near = np.maximum(near, v @ v[chosen[-1]])
    return chosen


def mmr(candidates: DataFrame, lam: float = DEFAULTS.mmr_lambda, top: int = DEFAULTS.top_k_final, pool: int = 200) -> DataFrame:
    """(query_id, memory_id, mmr_rank) of candidates(query_id, memory_id, relevance, prev_rank, embedding).

    The choice is sequential within a query, over its `pool` best candidates.
    """
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "prev_rank"))
    rows = candidates.withColumn("best", best).where(F.col("best") <= pool).select("query_id", "memory_id", "relevance", "prev_rank", "embedding")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("prev_rank", kind="stable")
        order = select_diverse(pdf.relevance.to_numpy(float), np.stack(pdf.embedding.to_numpy()).astype(float), lam, top)
        out = pdf.iloc[order][["query_id", "memory_id"]]
        return out.assign(mmr_rank=np.arange(1, len(out) + 1))

    kinds = dict(rows.dtypes)
    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, memory_id {kinds['memory_id']}, mmr_rank long")
