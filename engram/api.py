"""The store as a whole: a folder of snapshots of all tables, and the calls that users make.

Reads return DataFrames. A write commits what it changes, all tables in one snapshot; it is refused (Conflict)
if another was committed since it read the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import schema
from engram.operators import edges as E
from engram.operators import graph as G
from engram.operators import linkers as L
from engram.operators import ops as O
from engram.operators import retrieval as Q
from engram.operators import timeline as T
from engram.operators.cache import VectorCache
from engram.operators.objectives import Objective, Watch
from engram.operators.snapshots import Change, SnapshotStore
from engram.operators.store import partial_update
from engram.plans import retrieve, writepath
from engram.settings import DEFAULTS, EDGE_TYPES, Settings
from engram.sources.readers import Embedder, HashEmbedder, embed

TABLES = {
    "memories": schema.MEMORIES, "edges": schema.EDGES, "mentions": schema.MENTIONS, "sessions": schema.SESSIONS,
    "includes": "session_id string, memory_id string", "timeline": schema.TIMELINE, "follows": schema.FOLLOWS,
}
MAX_BULK = 500


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(int(n), high))


class MemoryStore:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, settings: Settings = DEFAULTS, cache: VectorCache | None = None):
        self.spark, self.path, self.embedder, self.settings = spark, path.rstrip("/"), embedder or HashEmbedder(), settings
        self.cache = cache
        self._store = SnapshotStore(spark, self.path, {n: (s, writepath.KEYS[n]) for n, s in TABLES.items()} | {"jobs": (schema.JOBS, ["run_id", "kind", "part", "project"])})

    # ------------------------------------------------------------ tables

    def table(self, name: str) -> DataFrame:
        return self._store.snapshot().table(name)

    def tables(self) -> writepath.Tables:
        """All tables of one snapshot."""
        snapshot = self._store.snapshot()
        return writepath.Tables(**{n: snapshot.table(n) for n in TABLES}, snapshot=snapshot)

    def _commit(self, changes: dict[str, Change], t: writepath.Tables) -> None:
        """Commit changes that were computed from t."""
        self._store.commit(changes, t.snapshot)
        self._store.compact()

    def _rows(self, items: list[dict]) -> DataFrame:
        """Item dicts as rows of the memories schema with vectors; unknown keys go to extra, keys with _ are dropped."""
        columns = [c.split()[0] for c in schema.MEMORIES.split(", ")]
        rows = []
        for it in items:
            meta = {k: v for k, v in (it.get("metadata") or {}).items() if not k.startswith("_")}
            tags = meta.pop("tags", None)
            row = {c: meta.pop(c, None) for c in columns if c not in ("memory_id", "text", "embedding", "extra", "tags")}
            row |= {"memory_id": it.get("id"), "text": it.get("content"), "embedding": None, "tags": [tags] if isinstance(tags, str) else tags, "extra": {k: str(v) for k, v in meta.items()} or None}
            row["event_time"] = None if row["event_time"] is None else str(row["event_time"])
            rows.append(tuple(row[c] for c in columns))
        df = self.spark.createDataFrame(rows, schema.MEMORIES.replace("event_time timestamp", "event_time string"))
        df = df.withColumn("event_time", F.try_to_timestamp("event_time"))
        return df.withColumn("embedding", embed(F.col("text"), self.embedder)) if self.cache is None else self.cache.embedded(df).select(*columns)

    # ------------------------------------------------------------ writes

    def upsert(self, content: str, id: str | None = None, metadata: dict | None = None, now: Column | None = None, run_id: str = "api") -> str:  # noqa: A002
        """Write one item with all linkers; its id."""
        from hashlib import md5

        if not content or not content.strip():
            raise ValueError("content is empty")
        t = self.tables()
        self._commit(writepath.write(self._rows([{"content": content, "id": id, "metadata": metadata}]), t, F.current_timestamp() if now is None else now, run_id, self.settings), t)
        return id or md5(content.encode()).hexdigest()

    def bulk_upsert(self, items: list[dict], now: Column | None = None) -> dict:
        """Write up to MAX_BULK items without linkers; counts, a status and the errors by index."""
        if len(items) > MAX_BULK:
            raise ValueError(f"at most {MAX_BULK} items")
        checked = O.validate_items(self.spark.createDataFrame([(i, x.get("content")) for i, x in enumerate(items)], "item_index long, content string"))
        errors = {r.item_index: r.error for r in checked.where("error is not null").collect()}
        good = [x for i, x in enumerate(items) if i not in errors]
        if good:
            t = self.tables()
            self._commit(writepath.write_many(self._rows(good), t, F.current_timestamp() if now is None else now), t)
        return O.bulk_summary(checked).first().asDict() | {"errors": errors}

    def delete(self, id: str) -> bool:  # noqa: A002
        """Whether the item was there; it and all that touches it go."""
        gone, t = self.spark.createDataFrame([(id,)], "memory_id string"), self.tables()
        if t.memories.join(gone, "memory_id", "left_semi").isEmpty():
            return False
        self._commit(writepath.delete(t, gone, F.current_timestamp(), settings=self.settings), t)
        return True

    def create_checkpoint(self, session_id: str, summary: str, project: str | None = None, thread_id: str | None = None) -> str:
        t = self.tables()
        made = T.make_checkpoint(t.memories, t.sessions, session_id, summary, project, thread_id)
        row = made["memory"].drop("last_event_seq").withColumn("embedding", embed(F.col("text"), self.embedder)).withColumn("event_time", F.current_timestamp())
        row = t.memories.limit(0).unionByName(row, allowMissingColumns=True).select(*t.memories.columns)
        session = made["session"].withColumn("last_event_seq", F.col("last_event_seq") + 1)
        known = t.sessions.join(session.select("session_id"), "session_id", "left_semi").select(*t.sessions.columns)
        changes = {
            "memories": row, "sessions": partial_update(known, session, ["session_id"]), "timeline": made["timeline"].select(*t.timeline.columns),
            "includes": row.select("session_id", "memory_id"), "follows": made["follows"].distinct(),
        }
        self._commit({n: Change(df) for n, df in changes.items()}, t)
        return made["memory"].first().memory_id

    # ------------------------------------------------------------ reads

    def query(self, text: str, top_k: int = 15, expand_graph: bool = False, intent: str = "general", now: Column | None = None, names: list[str] | None = None, **filters) -> DataFrame:
        """Ranked items of a query; filters: category, run_id, tags, min_score. names: whose items are looked for along edges; None: those the query mentions."""
        t = self.tables()
        src = retrieve.Sources(t.memories, t.edges, t.mentions, t.sessions, t.includes, self.settings)
        out = retrieve.answer(src, text, self.embedder([text])[0], F.current_timestamp() if now is None else now, clamp(top_k, 1, 200), expand_graph, intent, names)
        return Q.result_filter(out.withColumn("best_score", retrieve.plain_score(out)), **filters)

    def recent_events(self, n: int = 20, **filters) -> DataFrame:
        return T.recent(self.table("memories").drop("embedding"), n, T.recent_filter(**filters))

    def session_events(self, session_id: str, limit: int = 50) -> DataFrame:
        return T.session_events(self.table("includes"), self.table("memories").drop("embedding"), session_id, clamp(limit, 1, 50))

    def session_timeline(self, session_id: str, limit: int = 100) -> DataFrame:
        return T.session_timeline(self.table("includes"), self.table("memories").drop("embedding"), session_id, clamp(limit, 1, 100))

    def session_chain(self, session_id: str, depth: int = 5) -> DataFrame:
        """A session and those before it, by distance."""
        starts = self.spark.createDataFrame([(session_id,)], "start string")
        return G.session_chain(self.table("follows"), starts, clamp(depth, 1, 20)).select("session_id", "distance")

    def decisions(self, query: str, limit: int = 10) -> DataFrame:
        """Decisions that hold the query's first words, each with up to three neighbors."""
        return G.decisions(self.table("memories").drop("embedding"), self.table("edges"), query, clamp(limit, 1, 50))

    def last_checkpoint(self, project: str | None = None, thread_id: str | None = None) -> DataFrame:
        rows = self.table("memories").drop("embedding").where("memory_type = 'checkpoint'").where(T.recent_filter(project, thread_id))
        return rows.orderBy(F.desc("event_seq")).limit(1)

    def related(self, id: str, types: list[str] | None = None, hops: int = 2, limit: int = 20) -> DataFrame:  # noqa: A002
        return G.related(self.table("edges"), id, types, clamp(hops, 1, 3), clamp(limit, 1, 50))

    def graph(self, id: str, hops: int = 2) -> tuple[DataFrame, DataFrame]:  # noqa: A002
        return G.ego(self.table("edges"), id, clamp(hops, 1, 3))

    def provenance(self, id: str, max_depth: int = 10, most: int | None = 30) -> tuple[DataFrame, DataFrame]:  # noqa: A002
        """Ancestors of an item, the first `most` of them (None: all), and a summary that says whether there are more."""
        chain, summary = G.provenance(self.table("edges"), self.spark.createDataFrame([(id,)], "start string"), clamp(max_depth, 1, 10))
        return (chain, summary.withColumn("truncated", F.lit(False))) if most is None else G.capped(chain, summary, most)

    def entity_memories(self, name: str, project: str, limit: int = 20) -> DataFrame:
        return L.memories_of(self.table("mentions"), project, name.strip().lower(), limit)

    def edge_stats(self) -> DataFrame:
        return E.type_stats(self.table("edges"))

    def health(self) -> dict[str, int]:
        """Rows of each table."""
        t = self.tables()
        return {n: getattr(t, n).count() for n in TABLES}

    def audit(self) -> DataFrame:
        """What the tables hold: rows, values by column, keys that are missing or repeated, properties, edges and items by type."""
        t = self.tables()
        kinds = {"edges": ("edge_type", list(EDGE_TYPES)), "memories": ("memory_type", [])}
        return O.audit({n: getattr(t, n) for n in TABLES}, writepath.KEYS, kinds)

    # ------------------------------------------------------------ batch jobs

    def check_objectives(self, samples: DataFrame, objectives: list[Objective], date: str, dry_run: bool = False, notes_path: str | None = None) -> list[dict]:
        """Results of a day's objectives; the day's edges by type are its totals. State and alerts lie beside the store's tables."""
        counts = self.table("edges").groupBy(F.col("edge_type").alias("type")).agg(F.count("*").alias("n"))
        return Watch(self.spark, f"{self.path}/watch", notes_path=notes_path).check(samples, objectives, counts, date, dry_run)

    def backfill(self, kind: str, run_id: str, now: Column | None = None, dry_run: bool = False, parts: int = 1) -> dict:
        """Recompute one kind of edges over all items: similarity, temporal, cooccurrence, causal, entities, promotion or compaction.

        Returns the edges found, also by project; unless dry_run they are merged. Promotions and compactions are read from
        extra: promoted_from_id, and compacted_from, a JSON list of ids. The same backfill again adds nothing.

        With parts > 1 the work is done in that many parts by hash (of the item asked, the session, or a pair's smaller id),
        each committed with its entry in the table of jobs in one snapshot. A backfill that was broken off, run again
        with the same run id, does only the parts that have no entry; its counts hold those done before. Rolling the run
        back forgets its entries.
        """
        tag, when = L.run_tag(run_id), F.current_timestamp() if now is None else now
        done: dict[int, dict[str, int]] = {}
        if parts > 1 and not dry_run:
            for r in self.table("jobs").where((F.col("run_id") == tag) & (F.col("kind") == kind)).collect():  # a row a part and project
                if r.parts != parts:
                    raise ValueError(f"run {tag} was begun in {r.parts} parts")
                done.setdefault(r.part, {})[r.project] = r.found
        run = [i for i in range(parts) if i not in done]
        for i in run:
            done[i] = self._backfill_part(kind, tag, when, i, parts, dry_run)
        counts: dict[str, int] = {}
        for found in done.values():
            for project, n in found.items():
                if n:
                    counts[project] = counts.get(project, 0) + n
        return {"kind": kind, "run_id": tag, "found": sum(counts.values()), "by_project": counts, "dry_run": dry_run, "parts_run": len(run)}

    def _backfill_part(self, kind: str, tag: str, when: Column, part: int, parts: int, dry_run: bool) -> dict[str, int]:
        """One part of a backfill; the edges found by project."""
        from engram.operators.vectors import neighbors

        t, least = self.tables(), self.settings.similar_threshold
        mine = lambda c: F.lit(True) if parts == 1 else F.pmod(F.xxhash64(c), F.lit(parts)) == part
        items, own = t.memories, t.memories.where(mine(F.col("memory_id")))
        edges = lambda pairs, name, **how: L.edge_rows(pairs, name, "backfill", tag, when, **how)

        def similar() -> DataFrame:
            asked = None if parts == 1 else own.where("project is not null")
            return edges(neighbors(items.where("project is not null"), least, asked=asked), "SIMILAR_TO", weight=F.least(F.col("score"), F.lit(1.0)))

        makers = {
            "similarity": similar,
            "temporal": lambda: edges(T.predecessors(items.where(mine(F.col("session_id")))), "MEMORY_FOLLOWS"),
            "cooccurrence": lambda: edges(L.cooccurrence_edges(t.mentions, only=None if parts == 1 else mine), "CO_OCCURS", weight=F.col("weight")),
            "causal": lambda: edges(L.causal_edges(own.where("memory_type = 'bug_fix'"), items.where("memory_type = 'task_failed'")), "CAUSED_BY"),
            "promotion": lambda: L.promotions(writepath.marks(own), tag, when),
            "compaction": lambda: L.compactions(writepath.marks(own), tag, when),
        }
        if kind == "entities":
            new = writepath.mention_rows(own, when, tag, "backfill").join(t.mentions, ["memory_id", "project", "name"], "left_anti")
            merged, table = writepath.merged_mentions(t.mentions, new), "mentions"
        else:
            new = E.with_endpoints(makers[kind](), items)
            merged, table = writepath.merged_edges(t.edges, new), "edges"
        by = new.join(items.select(F.col("memory_id").alias("__id"), F.col("project").alias("__project")), F.col("memory_id" if kind == "entities" else "source_id") == F.col("__id"))
        counts = {r[0]: r[1] for r in by.groupBy(F.coalesce("__project", F.lit(""))).count().collect()}
        if not dry_run:
            changes = {table: Change(merged)}
            if parts > 1:
                rows = [(tag, kind, part, parts, project, n) for project, n in (counts or {"": 0}).items()]
                changes["jobs"] = Change(self.spark.createDataFrame(rows, schema.JOBS))
            self._commit(changes, t)
        return counts

    def rollback(self, run_id: str, dry_run: bool = False) -> dict[str, int]:
        """Edges of a run by type, mentions as MENTIONS; removed unless dry_run."""
        t = self.tables()
        _, removed = E.rollback(t.edges, run_id)
        _, mentioned = E.rollback(t.mentions.withColumn("edge_type", F.lit("MENTIONS")), run_id)
        counts = {r.edge_type: r.removed for r in removed.unionByName(mentioned).groupBy("edge_type").agg(F.sum("removed").alias("removed")).collect()}
        jobs = t.snapshot.table("jobs").where(F.col("run_id") == run_id.strip()).select("run_id", "kind", "part", "project")
        if not dry_run and (counts or not jobs.isEmpty()):
            own = lambda name: Change(deletes=getattr(t, name).where(E.matching(run_id=run_id.strip())).select(*writepath.KEYS[name]))
            self._commit({"edges": own("edges"), "mentions": own("mentions"), "jobs": Change(deletes=jobs)}, t)
        return counts
