"""Timelines, sessions, sequences and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.operators.lineage import settle
from engram.operators.store import keyset_page


def scoped(events: DataFrame, project: str = "project") -> DataFrame:
    """Each event in its project's scope and in the global one, once where they are the same."""
    p = F.coalesce(F.col(project).cast("string"), F.lit("global"))
    return events.withColumn("scope", F.explode(F.array_distinct(F.array(p, F.lit("global")))))


def recent(events: DataFrame, n: int = 20, condition: Column | None = None) -> DataFrame:
    """The n latest events by event_seq; events without one are left out."""
    rows = events.where(F.col("event_seq").isNotNull())
    rows = rows if condition is None else rows.where(condition)
    return rows.orderBy(F.desc("event_seq")).limit(max(1, min(n, 200)))


def recent_filter(project=None, thread_id=None, memory_type=None, since_seq: int | None = None, since_time=None) -> Column:
    """Empty values ask for nothing; since_seq 0 does."""
    out = F.lit(True)
    for name, value in (("project", project), ("thread_id", thread_id), ("memory_type", memory_type)):
        if value:
            out = out & (F.col(name) == value)
    if since_seq is not None:
        out = out & (F.col("event_seq") >= since_seq)
    if since_time:
        out = out & (F.col("event_time") >= F.lit(since_time).cast("timestamp"))
    return out


def since(events: DataFrame, seq: int) -> DataFrame:
    return events.where(F.col("event_seq") >= seq).orderBy("event_seq")


def predecessors(events: DataFrame, session: str = "session_id") -> DataFrame:
    """(source_id, target_id): each event and the one before it in its session, by (event_seq, memory_id)."""
    w = W.partitionBy(session).orderBy("event_seq", "memory_id")
    rows = events.where(F.col(session).isNotNull()).select(F.col(session), F.col("memory_id").alias("source_id"), F.lag("memory_id").over(w).alias("target_id"), F.col("event_seq"))
    return rows.where("target_id is not null and source_id != target_id")


def micros(duration: str) -> int:
    """A number and a unit, from seconds to weeks, in microseconds."""
    n, unit = duration.split()
    return int(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}[unit.lower().rstrip("s")] * 1_000_000)


def predecessors_in_time(events: DataFrame, idle: str = "7 days", session: str = "session_id") -> DataFrame:
    """(source_id, target_id, session): each event and the one before it in its session by (event_time, event_seq, memory_id), if no longer ago than idle.

    Events without a session, time, event_seq or id are left out.
    """
    w = W.partitionBy("__session").orderBy("__at", "event_seq", "memory_id")
    rows = events.select(F.col(session).alias("__session"), F.unix_micros(F.col("event_time").cast("timestamp")).alias("__at"), "event_seq", "memory_id").dropna()
    rows = rows.select("__session", "memory_id", F.lag("memory_id").over(w).alias("before"), (F.col("__at") - F.lag("__at").over(w)).alias("gap"))
    return rows.where((F.col("gap") <= micros(idle)) & (F.col("memory_id") != F.col("before"))).select(F.col("memory_id").alias("source_id"), F.col("before").alias("target_id"), F.col("__session").alias(session))


def sequenced(rows: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """event_seq = start + 1, 2, ... in the given order, without holes.

    Rows are range-partitioned, sorted and numbered within their partition, and settled so: a range
    partitioning that is computed again need not be the same. Only one count a partition is summed
    on the way, so no task sees all rows.
    """
    place = F.monotonically_increasing_id()  # the partition's number from bit 33 on, the row's place below
    dealt = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place))
    local = dealt.withColumn("__p", F.shiftright("__at", 33)).withColumn("__i", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = local.groupBy("__p").agg(F.count("*").alias("__n"))
    # a row a partition
    before = settle(sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before")))
    return local.join(before, "__p").withColumn("event_seq", F.lit(start) + F.col("__before") + F.col("__i") + 1).drop("__at", "__p", "__i", "__before")


def session_page(events: DataFrame, after=None, size: int = 100, session: str = "session_id") -> DataFrame:
    """The next distinct sessions after one, in order; events without a session are left out."""
    return keyset_page(events.where(F.col(session).isNotNull()).select(session).distinct(), after, size, session)


def chronology(rows: DataFrame, now: Column) -> DataFrame:
    """event_time and memory_type where they are missing or blank."""
    return rows.withColumn("event_time", F.coalesce(F.nullif(F.col("event_time"), F.lit("")), now.cast("string"))).withColumn("memory_type", F.coalesce(F.nullif("memory_type", F.lit("")), F.lit("memory")))


def session_events(includes: DataFrame, events: DataFrame, session_id, limit: int = 50) -> DataFrame:
    """The latest events of a session."""
    ids = includes.where(F.col("session_id") == session_id).select("memory_id")
    return events.join(ids, "memory_id", "left_semi").orderBy(F.desc("event_seq"), "memory_id").limit(limit)


def session_timeline(includes: DataFrame, events: DataFrame, session_id, limit: int = 100) -> DataFrame:
    """The events of a session from the first on."""
    ids = includes.where(F.col("session_id") == session_id).select("memory_id")
    return events.join(ids, "memory_id", "left_semi").orderBy("event_seq", "memory_id").limit(min(limit, 100))


def link_sessions(sessions: DataFrame, links: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, includes) after links(session_id, memory_id): new sessions are made, links need their event."""
    own = links.join(events.select("memory_id"), "memory_id", "left_semi").select("session_id", "memory_id").distinct()
    fresh = own.select("session_id").distinct().join(sessions, "session_id", "left_anti")
    return sessions.unionByName(fresh, allowMissingColumns=True), own


def latest_session(sessions: DataFrame, project=None, thread_id=None, exclude=None) -> DataFrame:
    """The session of the greatest last_event_seq; sessions without one come last."""
    for name, value in (("project", project), ("thread_id", thread_id)):
        if value:
            sessions = sessions.where(F.col(name) == value)
    if exclude is not None:
        sessions = sessions.where(F.col("session_id") != exclude)
    return sessions.orderBy(F.desc_nulls_last("last_event_seq"), "session_id").limit(1)


def follows(sessions: DataFrame) -> DataFrame:
    """(session_id, prev_session_id): the session of the next smaller last_event_seq in its project and thread, never itself."""
    w = W.partitionBy("project", "thread_id").orderBy("last_event_seq", "session_id")
    rows = sessions.where(F.col("last_event_seq").isNotNull()).withColumn("prev_session_id", F.lag("session_id").over(w))
    return rows.where("prev_session_id is not null").select("session_id", "prev_session_id")


def last_checkpoint(rows: DataFrame, group: list[str]) -> DataFrame:
    """The checkpoint of the greatest event_seq of each group."""
    marks = rows.where(F.col("memory_type") == "checkpoint")
    return marks.groupBy(*group).agg(F.max_by(F.struct("memory_id", "event_seq"), F.struct("event_seq", "memory_id")).alias("c")).select(*group, "c.memory_id", "c.event_seq")


def make_checkpoint(events: DataFrame, sessions: DataFrame, session_id: str, summary: str, project: str | None = None, thread_id: str | None = None) -> dict[str, DataFrame]:
    """Rows that a checkpoint adds: the memory, its session, its two timeline scopes, and its link to the session before.

    last_event_seq is that of the events before the checkpoint itself.
    """
    last = events.agg(F.coalesce(F.max("event_seq"), F.lit(0)).alias("last_event_seq"))
    row = last.select(
        F.md5(F.lit(f"{session_id}:{summary}")).alias("memory_id"), F.lit(summary).alias("text"), (F.col("last_event_seq") + 1).alias("event_seq"), "last_event_seq",
        F.lit("checkpoint").alias("memory_type"), F.lit(project).cast("string").alias("project"), F.lit(thread_id).cast("string").alias("thread_id"), F.lit(session_id).alias("session_id"),
    )
    session = row.select("session_id", "last_event_seq", F.col("text").alias("summary"), "project", "thread_id")
    before = latest_session(sessions, project, thread_id, exclude=session_id).select(F.lit(session_id).alias("session_id"), F.col("session_id").alias("prev_session_id"))
    return {"memory": row, "session": session, "timeline": scoped(row), "follows": before}
