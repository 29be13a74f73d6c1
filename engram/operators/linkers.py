"""Batch linkers: edges between items from shared entities, order, causes and provenance marks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.operators.lineage import settle
from engram.settings import DEFAULTS


def degrees(mentions: DataFrame) -> DataFrame:
    """(project, name, degree): distinct items that mention each entity."""
    return mentions.select("project", "name", "memory_id").distinct().groupBy("project", "name").agg(F.count("*").alias("degree"))


def entities_of(mentions: DataFrame) -> DataFrame:
    """Each item's entities with their degrees, the most mentioned first."""
    rows = mentions.select("project", "name", "memory_id").distinct().join(degrees(mentions), ["project", "name"])
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("memory_id").orderBy(F.desc("degree"), "name")))


def memories_of(mentions: DataFrame, project, name, limit: int = 100) -> DataFrame:
    """Items that mention an entity, the latest seen first."""
    rows = mentions.where((F.col("project") == project) & (F.col("name") == name))
    return rows.orderBy(F.desc("last_seen_at"), "memory_id").limit(min(limit, 1000))


def without_hubs(mentions: DataFrame, hub: int = DEFAULTS.hub_degree) -> DataFrame:
    """Distinct mentions of entities with at most `hub` items, with their degree.

    Done before any pairing: what is left of an entity makes at most hub * (hub - 1) pairs, so the
    pairs grow with the number of entities, whatever the largest degree is.
    """
    return mentions.select("project", "name", "memory_id").distinct().join(degrees(mentions).where(F.col("degree") <= hub), ["project", "name"])


def shared_entity_neighbors(mentions: DataFrame, hub: int = DEFAULTS.hub_degree, start: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(memory_id, other_id, shared, weight): items that share entities; weight = min(1, shared / 5)."""
    kept = without_hubs(mentions, hub)
    left = kept if start is None else kept.join(start.select("memory_id"), "memory_id", "left_semi")
    right = kept.select("project", "name", F.col("memory_id").alias("other_id"))
    pairs = left.join(right, ["project", "name"]).where("memory_id != other_id")
    out = pairs.groupBy("memory_id", "other_id").agg(F.count("*").alias("shared")).withColumn("weight", F.least(F.lit(1.0), F.col("shared") / 5.0))
    if limit is None:
        return out
    rank = F.row_number().over(W.partitionBy("memory_id").orderBy(F.desc("shared"), "other_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def cooccurrence_edges(mentions: DataFrame, hub: int = DEFAULTS.hub_degree, cap: int = DEFAULTS.per_entity_cap, least: int = DEFAULTS.min_shared, latest: bool = False, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """(source_id, target_id, shared, weight): pairs of items with several common entities, weighted by rarity.

    From each item the first `cap` others of an entity count, by id or, with latest, those seen last; a pair is decided from its smaller
    id, or from the other one if that side has too few. weight = sum of ln(max degree / degree)
    over the shared entities, / 10, within 0.01 and 1, to 4 places. With `only`, the pairs whose smaller id it holds for.
    """
    kept = without_hubs(mentions, hub).withColumn("top_degree", F.max("degree").over(W.partitionBy("project", "memory_id")))
    order = ["memory_id"]
    if latest:
        seen = mentions.groupBy("project", "name", "memory_id").agg(F.max("last_seen_at").alias("seen"))
        kept, order = kept.join(seen, ["project", "name", "memory_id"]), [F.desc("seen"), "memory_id"]
    # an entity's members in order: the first `cap` others of each are among its first cap + 1, so no pairs are ranked
    kept = kept.withColumn("place", F.row_number().over(W.partitionBy("project", "name").orderBy(*order)))
    # each member takes the list of the first ones along: ids in one array are a small part of the bytes of a row for each pair
    firsts = kept.where(F.col("place") <= cap + 1).groupBy("project", "name").agg(F.array_sort(F.collect_list(F.struct("place", "memory_id"))).alias("firsts"))
    lists = kept.join(firsts, ["project", "name"]).select("memory_id", "degree", "top_degree", "place", F.col("firsts.memory_id").alias("others"))
    # dealt by item and in its order, so the pairs of an item are made and summed in one task, a batch at a time
    dealt = lists.where("memory_id is not null").repartition("memory_id").sortWithinPartitions("memory_id")
    kind = dict(kept.dtypes)["memory_id"]
    by_side = dealt.mapInArrow(lambda batches: shared_of_items(batches, cap, least), f"memory_id {kind}, other_id {kind}, shared long, w double")
    by_side = by_side if only is None else by_side.where(only(F.least("memory_id", "other_id")))
    ends = by_side.select(F.least("memory_id", "other_id").alias("source_id"), F.greatest("memory_id", "other_id").alias("target_id"), "memory_id", "shared", "w")
    one = ends.groupBy("source_id", "target_id").agg(F.min_by("shared", "memory_id").alias("shared"), F.min_by("w", "memory_id").alias("w"))
    return one.select("source_id", "target_id", "shared", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.01), F.col("w"))), 4).alias("weight"))


def shared_of_items(batches: Iterator[pa.RecordBatch], cap: int, least: int) -> Iterator[pa.RecordBatch]:
    """(memory_id, other_id, shared, w) with `least` shared entities or more, of (memory_id, degree, top_degree, place, others) in order of memory_id.

    The sums of the last item of a batch wait for the next one; nothing else is held.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        others = rows["others"].combine_chunks()
        of, other = np.asarray(pc.list_parent_indices(others)), pc.list_flatten(others)
        at = np.arange(len(of)) - np.searchsorted(of, of) + 1
        place, degree, top = (np.asarray(rows[c])[of] for c in ("place", "degree", "top_degree"))
        mine = rows["memory_id"].take(pa.array(of))
        counts = pc.and_(pc.not_equal(mine, other), pa.array(at - (place < at) <= cap))
        weight = np.log(np.maximum(top / degree, 1.0)) / 10
        pairs = pa.table({"memory_id": mine, "other_id": other, "shared": pa.array(np.ones(len(of), np.int64)), "w": pa.array(weight)}).filter(counts)
        pairs = pairs if held is None else pa.concat_tables([held, pairs])
        found = pairs.group_by(["memory_id", "other_id"], use_threads=False).aggregate([("shared", "sum"), ("w", "sum")]).select(["memory_id", "other_id", "shared_sum", "w_sum"]).rename_columns(["memory_id", "other_id", "shared", "w"])
        last = rows["memory_id"][-1]
        open_ = pc.equal(found["memory_id"], last)
        held = found.filter(open_)
        yield from found.filter(pc.and_(pc.invert(open_), pc.greater_equal(found["shared"], least))).to_batches()
    if held is not None:
        yield from held.filter(pc.greater_equal(held["shared"], least)).to_batches()


def touched_pairs(before: DataFrame, after: DataFrame, touched: DataFrame, hub: int = DEFAULTS.hub_degree, **how) -> tuple[DataFrame, DataFrame]:
    """(items, edges): the items whose pairs may differ between the mentions before and after, and all of their pairs after, as cooccurrence_edges gives them.

    touched: (project, name) of the entities whose mentions changed. What a pair weighs depends on the entities
    of its ends alone, so the items are the members of touched entities (not of those that were hubs and still are);
    pairs are made from the entities of these items and of their partners, each with all its
    mentions, so degrees and hub crossings are exact. Rows grow with the change, the hub bound and the cap.
    """
    key, ids = ["project", "name"], ["project", "memory_id"]
    touched, empty = touched.select(*key).distinct(), before.select("memory_id").limit(0)
    sides = [m.select(*key, "memory_id").distinct().join(touched, key, "left_semi").withColumn("side", F.lit(i)) for i, m in enumerate((before, after))]
    members = settle(sides[0].unionByName(sides[1]))
    small = members.groupBy(*key, "side").agg(F.count("*").alias("degree")).where(F.col("degree") <= hub)
    items = settle(members.join(small, [*key, "side"], "left_semi").select(*ids).distinct())
    if items.isEmpty():
        return empty, cooccurrence_edges(before.limit(0), hub, **how)
    own = after.select(*key, "memory_id").distinct()
    first = settle(own.join(own.join(items, ids, "left_semi").select(*key).distinct(), key, "left_semi"))
    partners = first.join(degrees(first).where(F.col("degree") <= hub), key, "left_semi").select(*ids).unionByName(items).distinct()
    second = own.join(partners, ids, "left_semi").select(*key).distinct()
    pairs = cooccurrence_edges(settle(after.join(second, key, "left_semi")), hub, **how)
    ends = items.select(F.col("memory_id").alias("__item")).distinct()
    either = pairs.select("*", F.explode(F.array("source_id", "target_id")).alias("__item")).join(ends, "__item", "left_semi")
    return items.select("memory_id").distinct(), either.drop("__item").distinct()


def causal_edges(fixes: DataFrame, failures: DataFrame, days: int = DEFAULTS.causal_days) -> DataFrame:
    """(source_id, target_id): a fix and the failure it names, in one project, 0 < time between < days."""
    f = failures.select(F.col("memory_id").alias("target_id"), F.col("project").alias("p"), F.col("event_time").alias("failed_at"))
    rows = fixes.join(f, (F.col("fixes_task_id") == F.col("target_id")) & (F.col("project") == F.col("p")))
    after = F.unix_micros(F.col("event_time").cast("timestamp")) - F.unix_micros(F.col("failed_at").cast("timestamp"))
    return rows.where((after > 0) & (after < days * 86_400_000_000)).select(F.col("memory_id").alias("source_id"), "target_id")


def edge_rows(pairs: DataFrame, edge_type: str, created_by: str, run_id: str, now: Column, weight: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Full edge rows from (source_id, target_id [, weight])."""
    return pairs.where("source_id != target_id").select(
        "source_id", "target_id", F.lit(edge_type).alias("edge_type"), (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"), now.cast("timestamp").alias("created_at"), now.cast("timestamp").alias("last_seen_at"),
        F.lit(created_by).alias("created_by"), F.lit(run_id).alias("run_id"), F.lit(1).alias("edge_version"), (F.lit(None) if metadata is None else metadata).cast("string").alias("metadata"),
    )


def supersedes(conflicts: DataFrame, run_id: str, now: Column) -> DataFrame:
    """One edge a conflict(new_id, memory_id, score), from the new item to the old."""
    reason = F.to_json(F.struct(F.concat(F.lit("conflict_detection: similarity="), F.format_string("%.3f", "score")).alias("reason")))
    return edge_rows(conflicts.select(F.col("new_id").alias("source_id"), F.col("memory_id").alias("target_id"), "score"), "SUPERSEDES", "conflict_detector", run_id, now, metadata=reason)


def promotions(items: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Edges of items(memory_id, promoted_from_id, promoted_from struct<old_id, from_layer, to_layer>); half a pair of layers is no promotion."""
    old = F.coalesce("promoted_from_id", "promoted_from.old_id")
    rows = items.where(old.isNotNull() & (F.trim(old) != "")).where(F.col("promoted_from.from_layer").isNull() == F.col("promoted_from.to_layer").isNull())
    layers = F.to_json(F.struct("promoted_from.from_layer", "promoted_from.to_layer"))
    return edge_rows(rows.select(F.col("memory_id").alias("source_id"), old.alias("target_id"), "promoted_from"), "PROMOTED_FROM", "promotion", run_id, now, metadata=layers)


# Columns that name what an item was compacted from, the first that is set counts.
MARKS = ("compacted_from", "_compacted_from", "source_ids")


def compactions(items: DataFrame, run_id: str, now: Column) -> DataFrame:
    """An edge to each source of items(memory_id, and any of MARKS as array<string>): the first mark counts; a list with a blank id makes none."""
    given = [F.col(c) for c in MARKS if c in items.columns]
    rows = items.withColumn("marked", F.coalesce(*given))
    good = F.coalesce((F.size("marked") > 0) & F.forall("marked", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(False))
    rows = rows.where(good).select(F.col("memory_id").alias("source_id"), F.explode(F.array_distinct("marked")).alias("target_id"))
    return edge_rows(rows, "COMPACTED_FROM", "compaction", run_id, now)


def run_tag(run_id: str, reserved: tuple[str, ...] = ("wt-", "test-")) -> str:
    """backfill-<id> of a usable run id; blank ids, wildcards and reserved prefixes are refused."""
    run_id = (run_id or "").strip()
    if not run_id or any(c in run_id for c in "*%") or run_id.lower() == "all" or run_id.startswith(reserved):
        raise ValueError(f"unusable run id {run_id!r}")
    return f"backfill-{run_id}"
