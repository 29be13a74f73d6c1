"""From candidate lists to ranked answers: fusion, rerank, scoring, duplicates, filters, budget."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions import scalars as X
from engram.settings import DEFAULTS, Settings


class Scorer(Protocol):
    """A reranker: a column function of (query, text)."""

    def __call__(self, query: Column, text: Column) -> Column: ...


def with_rank(df: DataFrame, *order: Column, query: str = "query_id", name: str = "rank") -> DataFrame:
    """1-based rank within each query."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(query).orderBy(*order)))


def filled_text(text: Column, source: Column, memory_id: Column) -> Column:
    """The text, or a placeholder that names the list and the id where it is blank."""
    label = F.when(source == "vector", "Vector Result ID: ").otherwise("Graph Result ID: ")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", text).otherwise(F.concat(label, memory_id.cast("string")))


def reciprocal_rank_fusion(lists: DataFrame, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """lists(query_id, source, rank, memory_id, text, ...) fused by equal text: rrf_score = sum of 1 / (k + rank).

    The vector list comes before the graph list; the first row of a text stands for it. The join
    of the two lists is one sum by text hash, with partial sums before the shuffle.
    """
    order = F.struct(F.when(F.col("source") == "vector", 0).otherwise(1).alias("list"), F.col("rank"))
    rows = lists.withColumn("text", filled_text(F.col("text"), F.col("source"), F.col("memory_id"))).withColumn("text_hash", F.md5("text"))
    rest = [c for c in rows.columns if c not in ("query_id", "text_hash", "rank")]
    fused = rows.groupBy("query_id", "text_hash").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"),
        F.min_by(F.struct(*rest), order).alias("first"),
        F.min(F.when(F.col("source") == "vector", F.col("rank"))).alias("initial_rank_vector"),
        F.min(F.when(F.col("source") != "vector", F.col("rank"))).alias("initial_rank_graph"),
    )
    return fused.select("query_id", "text_hash", "rrf_score", "initial_rank_vector", "initial_rank_graph", "first.*")


def rerank(candidates: DataFrame, scorers: list[Scorer] | None = None, top: int = DEFAULTS.top_k_final) -> DataFrame:
    """The best `top` of each query by the first scorer that scores any of its rows, else by the fused score.

    A scorer that gives a query nothing but nulls has failed there, and the next one is asked; one that
    works drops rows of blank text and rows that it gives no score. reranker_used names it.
    """
    rows = candidates.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("reranker_used", F.lit("rrf_only"))
    if scorers:
        by_query = W.partitionBy("query_id")  # a query's candidates are a bounded list
        scores = F.array(*(F.when(F.trim("text") != "", s(F.col("query"), F.col("text"))).cast("double") for s in scorers))
        rows = candidates.withColumn("__scores", scores)
        worked = F.coalesce(*(F.when(F.max(F.get("__scores", F.lit(i))).over(by_query).isNotNull(), F.lit(i)) for i in range(len(scorers))))
        rows = rows.withColumn("__tier", worked).withColumn("rerank_score", F.get("__scores", F.col("__tier")))
        rows = rows.where(F.col("__tier").isNull() | F.col("rerank_score").isNotNull())
        name = F.when(F.col("__tier").isNull(), "rrf_only").when(F.col("__tier") == 0, "scorer").otherwise(F.concat(F.lit("scorer_"), (F.col("__tier") + 1).cast("string")))
        rows = rows.withColumn("reranker_used", name).drop("__scores", "__tier")
    ranked = with_rank(rows, F.coalesce("rerank_score", "rrf_score").desc(), F.col("memory_id"), name="prev_rank")
    return ranked.where(F.col("prev_rank") <= top)


def time_weighted(rows: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds semantic_score_normalized, temporal_score and composite_score (6 places) and final_rank.

    rows: rrf_score, rerank_score, reranker_used, event_time, category, memory_type, prev_rank.
    """
    raw = X.raw_semantic(F.col("rerank_score"), F.col("rrf_score"))
    semantic = F.when(F.col("reranker_used") == "rrf_only", X.semantic_score(raw, "rrf")).otherwise(X.semantic_score(raw, "rerank"))
    scored = rows.withColumn("s", semantic).withColumn("t", X.temporal_decay(F.col("event_time"), X.category_of(F.col("category"), F.col("memory_type")), now, settings.half_lives))
    composite = X.composite_score(F.col("s"), F.col("t"), weights=X.pipeline_weights(settings))
    scored = scored.select(*rows.columns, F.round("s", 6).alias("semantic_score_normalized"), F.round("t", 6).alias("temporal_score"), F.round(composite, 6).alias("composite_score"))
    return with_rank(scored, F.desc("composite_score"), F.col("prev_rank"), name="final_rank")


def first_of_each_text(rows: DataFrame, *order: Column, group: list[str] | None = None) -> DataFrame:
    """One row of each md5 of text, the first in order."""
    # a partial minimum: of each text a task hands on one row
    keys, rows = group or [], rows.drop("text_hash")
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    found = rows.groupBy(*keys, F.md5(F.coalesce("text", F.lit(""))).alias("text_hash")).agg(first)
    return found.select(*(F.col(c) if c in keys else F.col(f"first.{c}") for c in rows.columns), "text_hash")


def merge_expansion(seeds: DataFrame, expansion: DataFrame, threshold: float = 0.0, keep: int = DEFAULTS.expansion_kept, top: int = DEFAULTS.top_k_final) -> DataFrame:
    """Seeds and the best few expansion rows, by composite score.

    An expansion row whose rerank score is below the threshold goes; one without takes its expansion score.
    """
    gate = expansion.where(F.col("rerank_score").isNull() | (F.col("rerank_score") >= threshold))
    gate = gate.withColumn("rerank_score", F.coalesce("rerank_score", "expansion_score")).withColumn("composite_score", F.coalesce("composite_score", "rerank_score"))
    best = with_rank(gate, F.desc("composite_score"), F.col("memory_id"), name="nth").where(F.col("nth") <= keep).drop("nth")
    rows = seeds.withColumn("is_expansion", F.lit(False)).unionByName(best.withColumn("is_expansion", F.lit(True)), allowMissingColumns=True)
    return with_rank(rows, F.desc_nulls_last("composite_score"), F.col("is_expansion"), F.col("memory_id"), name="final_rank").where(F.col("final_rank") <= top)


def first_branch(*branches: DataFrame, group: str = "query_id") -> DataFrame:
    """Of each query the rows of its first branch that has any."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)))
    return rows.withColumn("best", F.min("branch").over(W.partitionBy(group))).where("branch = best").drop("best")


def compile_filter(spec: dict) -> Column:
    """{key: value | {$eq, $ne, $gte, $gt, $lte, $lt, $in}} as one condition; all keys must hold."""
    ops = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gte": lambda c, v: c >= v, "$gt": lambda c, v: c > v,
        "$lte": lambda c, v: c <= v, "$lt": lambda c, v: c < v, "$in": lambda c, v: c.isin(*v),
    }
    out = F.lit(True)
    for key, want in spec.items():
        for op, value in (want if isinstance(want, dict) else {"$eq": want}).items():
            if op not in ops:
                raise ValueError(f"unknown operator {op}")
            out = out & ops[op](F.col(key), value)
    return out


def result_filter(rows: DataFrame, category: str | None = None, run_id: str | None = None, tags: list[str] | None = None, min_score: float | None = None) -> DataFrame:
    """Rows of a category and run that have all tags and the score; a row without score fails a minimum."""
    if category:
        rows = rows.where(F.lower(F.trim("category")) == category.strip().lower())
    if run_id:
        rows = rows.where(F.trim("run_id") == run_id.strip())
    if tags:
        rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    if min_score is not None:
        rows = rows.where(F.col("best_score") >= min_score)
    return rows


def named_in(text: Column, memory_id: Column, names: list[str], limit: int = 5) -> Column:
    """Whether the text or the id contains one of the first few names, in any case; blank names are skipped."""
    out = F.lit(False)
    for n in [x.strip().lower() for x in names if x.strip()][:limit]:
        out = out | F.contains(F.lower(text), F.lit(n)) | F.contains(F.lower(memory_id.cast("string")), F.lit(n))
    return out


def within_budget(rows: DataFrame, budget: int = DEFAULTS.token_budget, group: str = "query_id", order: str = "final_rank") -> DataFrame:
    """The longest prefix of each query's rows whose words sum to the budget at most, with the running sum."""
    words = rows.withColumn("n_words", X.word_estimate(F.col("text")))
    total = F.sum("n_words").over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return words.withColumn("words_so_far", total).where(F.col("words_so_far") <= budget)


def context(rows: DataFrame, group: str = "query_id", order: str = "final_rank") -> DataFrame:
    """(query_id, context): the texts of a query in order, one to a line."""
    return rows.groupBy(group).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"])).alias("context"))
