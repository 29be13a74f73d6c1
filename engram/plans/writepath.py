"""Writing items: ids, chronology, duplicates, conflicts, edges, sessions and timelines of a batch.

A write gives the rows that it changes, table by table; stored tables are read, never written anew.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import entities as N
from engram.functions import scalars as X
from engram.operators import edges as E
from engram.operators import linkers as L
from engram.operators import store as S
from engram.operators import timeline as T
from engram.operators import vectors as V
from engram.operators.lineage import settle
from engram.operators.snapshots import Change, Snapshot
from engram.schema import EDGE_KEY
from engram.settings import DEFAULTS, Settings

#: Key columns of each table.
KEYS = {
    "memories": ["memory_id"], "edges": EDGE_KEY, "mentions": ["memory_id", "project", "name"], "sessions": ["session_id"],
    "includes": ["session_id", "memory_id"], "timeline": ["scope", "memory_id"], "follows": ["session_id", "prev_session_id"],
}
#: Who writes CO_OCCURS edges from mentions; edges of others are left alone.
PAIR_WRITERS = ("cooccurrence_linker", "backfill")


@dataclass
class Tables:
    """The store's tables, and the snapshot that they are of."""

    memories: DataFrame
    edges: DataFrame
    mentions: DataFrame
    sessions: DataFrame
    includes: DataFrame
    timeline: DataFrame
    follows: DataFrame
    snapshot: Snapshot | None = None


def applied(t: Tables, changes: dict[str, Change]) -> Tables:
    """The tables after changes, without a store."""
    out = {f.name: getattr(t, f.name) for f in fields(t) if f.name != "snapshot"}
    for name, change in changes.items():
        key = KEYS[name]
        if change.deletes is not None:
            out[name] = out[name].join(change.deletes.select(*key), key, "left_anti").select(*out[name].columns)
        if change.upserts is not None:
            out[name] = S.overlay(out[name], change.upserts, key)
    return Tables(**out)


def prepare(batch: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """batch with memory_id, event_seq after all stored ones, event_time and memory_type. Rows without a vector are left out."""
    top = stored.agg(F.coalesce(F.max("event_seq"), F.lit(0))).first()[0]
    rows = batch.where(V.non_zero(F.col("embedding"))).withColumn("memory_id", X.content_id(F.col("memory_id"), F.col("text")))
    rows = rows.withColumn("event_time", F.coalesce("event_time", now.cast("timestamp"))).withColumn("memory_type", F.coalesce(F.nullif(F.col("memory_type"), F.lit("")), F.lit("memory")))
    return T.sequenced(rows.drop("event_seq"), "event_time", "memory_id", start=top)


def decide(rows: DataFrame, stored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """rows with duplicate_of, action and the id to write: a duplicate of a stored item is skipped, or updates it, or is appended.

    Rows are compared with stored items and with earlier rows of the batch.
    """
    earlier = rows.select("memory_id", "memory_type", "embedding", "event_seq")
    known = stored.select("memory_id", "memory_type", "embedding").withColumn("event_seq", F.lit(0).cast("long")).unionByName(earlier)
    hits = V.duplicates(rows, known.drop("event_seq"), settings.duplicate_threshold).join(known.select(F.col("memory_id"), F.col("event_seq").alias("old_seq")).groupBy("memory_id").agg(F.min("old_seq").alias("old_seq")), "memory_id")
    found = hits.select(F.col("new_id").alias("memory_id"), F.col("memory_id").alias("duplicate_of"), "old_seq")
    out = rows.join(found, "memory_id", "left").withColumn("duplicate_of", F.when(F.col("old_seq") < F.col("event_seq"), F.col("duplicate_of"))).drop("old_seq")
    action = X.duplicate_action(F.col("duplicate_of").isNotNull(), F.col("on_duplicate") if "on_duplicate" in rows.columns else F.lit(None).cast("string"), X.category_of(F.col("category"), F.col("memory_type")))
    return out.withColumn("action", action).withColumn("write_id", F.when(F.col("action") == "update", F.coalesce("duplicate_of", "memory_id")).otherwise(F.col("memory_id")))


def mention_rows(rows: DataFrame, now: Column, run_id: str, created_by: str = "entity_linker") -> DataFrame:
    """Mentions of rows(memory_id, project, entities, text): of the entities that are given, else of the names in the text; in canonical form."""
    given = F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.trim(F.coalesce(e, F.lit(""))) != "")
    own = rows.where("project is not null").withColumn("given", given)
    named = own.where(F.size("given") > 0).select("memory_id", "project", F.explode("given").alias("raw"))
    read = own.where(F.size("given") == 0).select("memory_id", "project", F.explode(N.identifiers_of()("text")).alias("raw"))
    own = named.unionByName(read).select("memory_id", "project", N.canon(F.col("raw")).alias("name")).where("name is not null").distinct()
    at = now.cast("timestamp")
    return own.select("memory_id", "project", "name", F.lit(1.0).alias("weight"), at.alias("created_at"), at.alias("last_seen_at"), F.lit(created_by).alias("created_by"), F.lit(run_id).alias("run_id"), F.lit(1).alias("edge_version"))


def marks(rows: DataFrame) -> DataFrame:
    """What items say that they were made from, read from extra: promoted_from_id, and compacted_from, a JSON list of ids."""
    return rows.select(
        "memory_id", F.col("extra.promoted_from_id").alias("promoted_from_id"), F.lit(None).cast("struct<old_id:string,from_layer:string,to_layer:string>").alias("promoted_from"),
        F.from_json("extra.compacted_from", "array<string>").alias("compacted_from"),
    )


def merged_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new edges after their merge with stored ones of the same keys."""
    new = settle(E.canonical(new))
    return E.merge(stored.join(new.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_semi").select(*stored.columns), new)


def merged_mentions(stored: DataFrame, new: DataFrame) -> DataFrame:
    key = KEYS["mentions"]
    return E.merge_mentions(stored.join(new.select(*key).distinct(), key, "left_semi").select(*stored.columns), new)


def pair_changes(stored: DataFrame, before: DataFrame, after: DataFrame, touched: DataFrame, memories: DataFrame, now: Column, run_id: str, settings: Settings = DEFAULTS) -> Change:
    """CO_OCCURS edges to write and to delete as mentions change: with them the edges are those that a backfill over all mentions would make.

    A pair that is there keeps who made it and when; its weight is the new one.
    """
    if touched.isEmpty():
        return Change(stored.limit(0), stored.limit(0).select(*EDGE_KEY))
    items, pairs = L.touched_pairs(before, after, touched, settings.hub_degree, cap=settings.per_entity_cap, least=settings.min_shared)
    new = E.with_endpoints(E.canonical(L.edge_rows(pairs, "CO_OCCURS", "cooccurrence_linker", run_id, now, weight=F.col("weight"))), memories)
    new = settle(new.select(*stored.columns))
    own = stored.where((F.col("edge_type") == "CO_OCCURS") & F.col("created_by").isin(*PAIR_WRITERS))
    near = own.join(items.withColumnRenamed("memory_id", "source_id"), "source_id", "left_semi").unionByName(own.join(items.withColumnRenamed("memory_id", "target_id"), "target_id", "left_semi").select(*own.columns)).distinct()
    kept = stored.join(new.select(*EDGE_KEY), EDGE_KEY, "left_semi").select(*EDGE_KEY, F.struct("created_at", "created_by", "run_id", "edge_version", "metadata").alias("old"))
    both = new.join(kept, EDGE_KEY, "left")
    same = lambda c: F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) if c in ("created_at", "created_by", "run_id", "edge_version", "metadata") else F.col(c)
    return Change(both.select(*(same(c) for c in stored.columns)), near.join(new.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*EDGE_KEY))


def write(batch: DataFrame, t: Tables, now: Column, run_id: str, settings: Settings = DEFAULTS) -> dict[str, Change]:
    """What a batch changes, linkers included; the same batch again changes no edge."""
    rows = decide(prepare(batch, t.memories, now), t.memories, settings).where("action != 'skip'")
    rows = rows.withColumn("memory_id", F.col("write_id")).select(*t.memories.columns)
    rows = settle(S.upsert(rows.limit(0), rows, ["memory_id"], "event_seq"))
    memories = S.overlay(t.memories, rows, ["memory_id"])
    decided = rows.where(X.category_of(F.col("category"), F.col("memory_type")) == "decision")
    edges = merged_edges(t.edges, E.with_endpoints(_links(rows, decided, memories, t, now, run_id, settings), memories))
    mentions = settle(merged_mentions(t.mentions, mention_rows(rows, now, run_id)))
    pairs = pair_changes(t.edges, t.mentions, S.overlay(t.mentions, mentions, KEYS["mentions"]), mentions, memories, now, run_id, settings)
    return {"memories": Change(rows), "edges": Change(edges.unionByName(pairs.upserts), pairs.deletes), "mentions": Change(mentions), **_sessions(rows, memories, t)}


def _sessions(rows: DataFrame, memories: DataFrame, t: Tables) -> dict[str, Change]:
    """New sessions, their links, and both scopes of the timeline."""
    links = rows.where("session_id is not null").select("session_id", "memory_id").distinct()
    fresh, _ = T.link_sessions(t.sessions.limit(0), links.join(t.sessions, "session_id", "left_anti"), rows)
    return {"sessions": Change(fresh), "includes": Change(links), "timeline": Change(T.scoped(rows).select(*t.timeline.columns))}


def _links(rows: DataFrame, decided: DataFrame, memories: DataFrame, t: Tables, now: Column, run_id: str, settings: Settings) -> DataFrame:
    ids = rows.select("memory_id")
    # only the new rows look for neighbors, and only sessions with new rows are ordered again
    similar = V.neighbors(memories.where(F.col("project").isNotNull()), settings.similar_threshold, settings.similar_pool, settings.similar_top, asked=ids)
    touched = memories.join(rows.select("session_id").distinct(), "session_id", "left_semi")
    follows = T.predecessors(touched).join(ids, F.col("source_id") == F.col("memory_id"), "left_semi")
    conflicts = V.conflicts(decided, t.memories, settings.conflict_low, settings.duplicate_threshold)
    fixes = L.causal_edges(rows.where("memory_type = 'bug_fix' and fixes_task_id is not null"), memories.where("memory_type = 'task_failed'"), settings.causal_days)
    out = L.edge_rows(similar, "SIMILAR_TO", "similarity_linker", run_id, now, weight=X.clamp(F.col("score")))
    out = out.unionByName(L.edge_rows(follows, "MEMORY_FOLLOWS", "temporal_linker", run_id, now))
    out = out.unionByName(L.supersedes(conflicts, run_id, now)).unionByName(L.edge_rows(fixes, "CAUSED_BY", "task_linker", run_id, now))
    made_from = marks(rows)
    return out.unionByName(L.promotions(made_from, run_id, now)).unionByName(L.compactions(made_from, run_id, now))


def write_many(batch: DataFrame, t: Tables, now: Column) -> dict[str, Change]:
    """The simple bulk write: items, sessions and timeline; no duplicate checks, no linkers."""
    rows = prepare(batch.where(F.trim(F.coalesce("text", F.lit(""))) != ""), t.memories, now).select(*t.memories.columns)
    rows = settle(S.upsert(rows.limit(0), rows, ["memory_id"], "event_seq"))
    return {"memories": Change(rows), **_sessions(rows, t.memories, t)}


def delete(t: Tables, gone: DataFrame, now: Column, run_id: str = "delete", settings: Settings = DEFAULTS) -> dict[str, Change]:
    """What the deletion of items changes: they, and all that touches them; pairs whose shared entities are fewer now are weighed again."""
    gone = gone.select("memory_id").distinct()
    keys = lambda name: Change(deletes=getattr(t, name).join(gone, "memory_id", "left_semi").select(*KEYS[name]))
    mentions = t.mentions.join(gone, "memory_id", "left_semi")
    touching = [t.edges.join(gone.withColumnRenamed("memory_id", end), end, "left_semi").select(*EDGE_KEY) for end in ("source_id", "target_id")]
    left = t.memories.join(gone, "memory_id", "left_anti")
    pairs = pair_changes(t.edges, t.mentions, t.mentions.join(gone, "memory_id", "left_anti"), mentions, left, now, run_id, settings)
    removed = touching[0].unionByName(touching[1]).unionByName(pairs.deletes)
    return {"memories": Change(deletes=gone), "edges": Change(pairs.upserts, removed), "mentions": keys("mentions"), "includes": keys("includes"), "timeline": keys("timeline")}
