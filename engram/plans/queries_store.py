"""Queries of timelines, sessions, tables, edges and operational analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import scalars as X
from engram.operators import edges as E
from engram.operators import evaluation as EV
from engram.operators import linkers as L
from engram.operators import metrics as M
from engram.operators import objectives as B
from engram.operators import ops as O
from engram.operators import store as S
from engram.operators import timeline as T
from engram.operators.retrieval import context, first_branch, within_budget
from engram.plans import adapters as A
from engram.plans.base import query
from engram.settings import EDGE_TYPES

# ---------------------------------------------------------------- timelines and sessions


@query("recent_events", "select event_id as memory_id, event_type as memory_type from events where user_id = 7 order by event_id desc limit 20")
def recent_events(spark, d):
    return T.recent(A.events(spark, d), 20, T.recent_filter(project=7)).select("memory_id", "memory_type")


@query("recent_since_seq", "select event_id as memory_id from events where event_id >= 500")
def recent_since_seq(spark, d):
    return T.since(A.events(spark, d), 500).select("memory_id")


@query("recent_since_time", "select event_id as memory_id from events where event_type = 'error' and ts >= timestamp '2024-01-20 00:00:00' order by event_id desc limit 200")
def recent_since_time(spark, d):
    return T.recent(A.events(spark, d), 500, T.recent_filter(memory_type="error", since_time="2024-01-20 00:00:00")).select("memory_id")


@query("window_lower_bound", "with m as (select min(event_id) as low from (select event_id from events order by event_id desc limit 50)) select count(*) as n, min(event_id) as first_id from events, m where event_id >= low")
def window_lower_bound(spark, d):
    rows = A.events(spark, d)
    low = T.recent(rows, 50).agg(F.min("event_seq").alias("low"))
    # one row, the least of a window
    return rows.join(F.broadcast(low), F.col("event_seq") >= F.col("low")).agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"))


@query("timeline_scope_fanout", "select user_id::VARCHAR as scope, count(*) as n, max(event_id) as last_seq from events group by 1 union all select 'global', count(*), max(event_id) from events")
def timeline_scope_fanout(spark, d):
    return T.scoped(A.events(spark, d)).groupBy("scope").agg(F.count("*").alias("n"), F.max("event_seq").alias("last_seq"))


def _session(spark, d):
    rows = A.turns(spark, d)
    return rows.select("session_id", "memory_id"), rows


@query("session_events", f"with {A.TURNS_SQL} select memory_id, event_seq, memory_type from turns where session_id = 3 order by event_seq desc limit 50")
def session_events(spark, d):
    return T.session_events(*_session(spark, d), 3).select("memory_id", "event_seq", "memory_type")


@query("session_timeline", f"with {A.TURNS_SQL} select memory_id, event_seq, memory_type from turns where session_id = 3 order by event_seq limit 100")
def session_timeline(spark, d):
    return T.session_timeline(*_session(spark, d), 3).select("memory_id", "event_seq", "memory_type")


@query("latest_session", f"with {A.TURNS_SQL}, s as (select session_id, max(event_seq) as last_event_seq from turns group by 1) select * from s order by last_event_seq desc nulls last, session_id limit 1")
def latest_session(spark, d):
    return T.latest_session(A.turns(spark, d).groupBy("session_id").agg(F.max("event_seq").alias("last_event_seq")))


@query("session_predecessor", f"with {A.TURNS_SQL} select * from (select session_id, memory_id as source_id, lag(memory_id) over (partition by session_id order by event_seq, memory_id) as target_id from turns) where target_id is not null")
def session_predecessor(spark, d):
    return T.predecessors(A.turns(spark, d)).select("session_id", "source_id", "target_id")


@query("user_predecessor", "select * from (select event_id as source_id, lag(event_id) over (partition by user_id order by event_id) as target_id from events) where target_id is not null")
def user_predecessor(spark, d):
    return T.predecessors(A.events(spark, d), "project").select("source_id", "target_id")


@query("last_checkpoint", f"with {A.TURNS_SQL}, c as (select session_id, case when memory_type = 'system' then 'x' else 'checkpoint' end as memory_type, memory_id, event_seq from turns) select session_id, arg_max(memory_id, event_seq) as memory_id, max(event_seq) as event_seq from c where memory_type = 'checkpoint' group by 1")
def last_checkpoint(spark, d):
    rows = A.turns(spark, d).withColumn("memory_type", F.when(F.col("memory_type") == "system", "x").otherwise("checkpoint"))
    return T.last_checkpoint(rows, ["session_id"])


@query("sequence_assign", f"with {A.TURNS_SQL} select memory_id, 1000 + row_number() over (order by session_id, event_seq) as event_seq from turns")
def sequence_assign(spark, d):
    return T.sequenced(A.turns(spark, d).drop("event_seq").withColumnRenamed("memory_id", "id").withColumn("memory_id", F.col("id")), "session_id", "id", start=1000).select("memory_id", "event_seq")


@query("chronology", f"with {A.TURNS_SQL} select memory_id, case when memory_type = 'user' then 'memory' else memory_type end as memory_type, case when event_seq % 2 = 0 then '2024-02-01 00:00:00' else '2024-01-05' end as event_time from turns")
def chronology(spark, d):
    rows = A.turns(spark, d).withColumn("memory_type", F.when(F.col("memory_type") != "user", F.col("memory_type")).otherwise("")).withColumn("event_time", F.when(F.col("event_seq") % 2 != 0, "2024-01-05"))
    return T.chronology(rows, A.now()).select("memory_id", "memory_type", "event_time")


@query("session_sizes", f"with {A.TURNS_SQL}, s as (select session_id, count(*) as n from turns group by 1) select case when n < 5 then n::VARCHAR when n < 10 then '5-9' when n < 20 then '10-19' when n < 50 then '20-49' when n < 100 then '50-99' else '100+' end as size_class, count(*) as sessions from s group by 1")
def session_sizes(spark, d):
    return O.session_sizes(A.turns(spark, d))


@query("coverage_gate", "with e as (select event_id, ts, case when event_type <> 'error' then user_id end as s from events) select count(*) as total, count(s) as covered, count(*) filter (where ts >= timestamp '2024-01-25 00:00:00') as recent_total, count(s) filter (where ts >= timestamp '2024-01-25 00:00:00') as recent_covered, round(100.0::DOUBLE * count(s) / count(*), 2) as pct, round(100.0::DOUBLE * count(s) filter (where ts >= timestamp '2024-01-25 00:00:00') / count(*) filter (where ts >= timestamp '2024-01-25 00:00:00'), 2) as recent_pct, round(100.0::DOUBLE * count(s) / count(*), 2) >= 50 and round(100.0::DOUBLE * count(s) filter (where ts >= timestamp '2024-01-25 00:00:00') / count(*) filter (where ts >= timestamp '2024-01-25 00:00:00'), 2) >= 50 as passed from e")
def coverage_gate(spark, d):
    rows = A.events(spark, d).withColumn("session_id", F.when(F.col("memory_type") != "error", F.col("project")))
    return O.session_coverage(rows, F.lit("2024-01-25 00:00:00").cast("timestamp"))


# ---------------------------------------------------------------- tables


@query("vector_upsert", f"with {A.VECTORS_SQL}, u as (select memory_id, project, 0 as b from vectors union all select memory_id + 100, 99, 1 from vectors) select memory_id, arg_max(project, b) as project from u group by 1", longs="project")
def vector_upsert(spark, d):
    rows = A.vectors(spark, d).select("memory_id", "project")
    return S.upsert(rows, rows.select((F.col("memory_id") + 100).alias("memory_id"), F.lit(99).alias("project")), ["memory_id"])


@query("node_partial_update", f"with {A.VECTORS_SQL}, n as (select memory_id + 100 as memory_id, case when memory_id % 2 = 0 then 'new' end as category from vectors) select memory_id, coalesce(n.category, v.category) as category, coalesce(v.project, -1) as project from vectors v full join n using (memory_id)", longs="project")
def node_partial_update(spark, d):
    rows = A.vectors(spark, d).select("memory_id", "category", "project")
    new = rows.select((F.col("memory_id") + 100).alias("memory_id"), F.when(F.col("memory_id") % 2 == 0, "new").alias("category"))
    return S.partial_update(rows, new, ["memory_id"]).withColumn("project", F.coalesce("project", F.lit(-1)))


@query("bulk_validate", "with i as (select doc_id, case when doc_id % 10 = 0 then null when doc_id % 10 = 1 then '  ' else text end as content from documents) select count(*) as total, count(*) filter (where trim(coalesce(content, '')) <> '') as succeeded, count(*) filter (where trim(coalesce(content, '')) = '') as failed, 'partial_success' as status from i")
def bulk_validate(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 10 == 1, "  ").otherwise(F.col("text")).alias("content"))
    return O.bulk_summary(O.validate_items(rows))


@query("catalog_counts", "select 'documents' as table_name, (select count(*) from duckdb_columns() where table_name = 'documents') as n_columns, sum(c) as n, count(*) filter (where c > 1) as duplicate_keys from (select count(*) as c from documents group by doc_id) union all select 'conversations', (select count(*) from duckdb_columns() where table_name = 'conversations'), sum(c), count(*) filter (where c > 1) from (select count(*) as c from conversations group by conv_id, turn)", longs="n_columns n duplicate_keys")
def catalog_counts(spark, d):
    return O.catalog({t: A.table(spark, d, t) for t in ("documents", "conversations")}, {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]})


@query("fallback_branches", "with l as (select doc_id, lang, source from documents), a as (select source, doc_id, 0 as branch from l where lang = 'es'), b as (select source, doc_id, 1 from l where lang = 'fr'), u as (select * from a union all select * from b) select source, doc_id, branch from u where branch = (select min(branch) from u x where x.source = u.source)", longs="branch")
def fallback_branches(spark, d):
    rows = A.table(spark, d, "documents").select("source", "doc_id", "lang")
    return first_branch(rows.where("lang = 'es'").drop("lang"), rows.where("lang = 'fr'").drop("lang"), group="source").select("source", "doc_id", "branch")


@query("context_build", r"""with w as (select source, doc_id, text, case when trim(text) = '' then 0 else len(string_split_regex(trim(text, e' \t\n\r'), '\s+')) end as n_words from documents), r as (select *, sum(n_words) over (partition by source order by doc_id rows unbounded preceding) as so_far from w), c as (select source, string_agg(text, chr(10) order by doc_id) as context from r where so_far <= 3000 group by 1) select source, md5(context) as context_md5, length(context) as n_chars from c""")
def context_build(spark, d):
    rows = A.table(spark, d, "documents").select("source", "doc_id", "text")
    return context(within_budget(rows, group="source", order="doc_id"), group="source", order="doc_id").select("source", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"))


@query("tags_and_keys", "select doc_id, lang || ',' || source as tags, 'a' as keys from documents")
def tags_and_keys(spark, d):
    rows = A.table(spark, d, "documents")
    tags = X.normalize_tags(F.array(F.concat(F.lit(" "), "lang"), F.lit(""), F.col("source"), F.col("lang")))
    keys = X.public_keys(F.create_map(F.lit("a"), F.col("lang"), F.lit("_b"), F.col("lang")))
    return rows.select("doc_id", F.array_join(tags, ",").alias("tags"), F.array_join(F.map_keys(keys), ",").alias("keys"))


# ---------------------------------------------------------------- edges


@query("edge_validate", f"with {A.EDGES_SQL}, e as (select *, case when weight > 0.95 then weight + 1 else weight end as w, case when source_id like '%7' then ' ' else source_id end as s from edges) select coalesce(case when trim(s) = '' then 'endpoint' when w > 1 then 'weight' end, 'ok') as problem, count(*) as n from e group by 1")
def edge_validate(spark, d):
    rows = A.edges(spark, d).withColumn("weight", F.when(F.col("weight") > 0.95, F.col("weight") + 1).otherwise(F.col("weight"))).withColumn("source_id", F.when(F.col("source_id").like("%7"), " ").otherwise(F.col("source_id")))
    return rows.groupBy(F.coalesce(E.problem(rows), F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query("edge_upsert_merge", f"with {A.EDGES_SQL}, u as (select *, 0 as b from edges union all select source_id, target_id, edge_type, 1 - weight, created_at, last_seen_at + interval 1 day, created_by, run_id, 1 from edges where run_id = 'run1') select case when edge_type in ('SIMILAR_TO', 'CO_OCCURS') and b = 1 then least(source_id, target_id) else source_id end as source_id, case when edge_type in ('SIMILAR_TO', 'CO_OCCURS') and b = 1 then greatest(source_id, target_id) else target_id end as target_id, edge_type, round(max(weight), 6) as weight, max(last_seen_at) as last_seen_at, arg_min(run_id, (b, created_at, created_by, run_id)) as run_id from u group by 1, 2, 3")
def edge_upsert_merge(spark, d):
    rows = A.edges(spark, d)
    new = rows.where("run_id = 'run1'").withColumn("weight", 1 - F.col("weight")).withColumn("last_seen_at", F.col("last_seen_at") + F.expr("interval 1 day"))
    once = E.merge(rows, new)
    return once.select("source_id", "target_id", "edge_type", F.round("weight", 6).alias("weight"), "last_seen_at", "run_id")


@query("edge_rollback", f"with {A.EDGES_SQL} select edge_type, count(*) as removed from edges where run_id = 'run2' group by 1")
def edge_rollback(spark, d):
    return E.rollback(A.edges(spark, d), "run2")[1]


@query("edge_delete_by_tag", f"with {A.EDGES_SQL} select edge_type, count(*) as kept from edges where not (created_by = 'loader' and edge_type = 'SIMILAR_TO' and created_at > timestamp '1996-01-01 00:00:00') group by 1")
def edge_delete_by_tag(spark, d):
    kept, _ = E.delete(A.edges(spark, d), E.matching(created_by="loader", edge_type="SIMILAR_TO", after=F.lit("1996-01-01 00:00:00").cast("timestamp")))
    return kept.groupBy("edge_type").agg(F.count("*").alias("kept"))


@query("edge_delete_cascade", f"with {A.EDGES_SQL}, g as (select 'p' || p_partkey as id from part where p_size < 10) select edge_type, count(*) as kept from edges where source_id not in (select id from g) and target_id not in (select id from g) group by 1")
def edge_delete_cascade(spark, d):
    gone = A.table(spark, d, "part").where("p_size < 10").select(F.concat(F.lit("p"), "p_partkey").alias("memory_id"))
    return E.without_nodes(A.edges(spark, d), gone).groupBy("edge_type").agg(F.count("*").alias("kept"))


@query("edge_endpoints", f"with {A.EDGES_SQL}, o as (select 'o' || o_orderkey as id from orders where o_orderstatus = 'F' union all select 'p' || p_partkey from part) select edge_type, count(*) as n from edges where source_id in (select id from o) and target_id in (select id from o) group by 1")
def edge_endpoints(spark, d):
    nodes = A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("memory_id")).unionByName(A.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("memory_id")))
    return E.with_endpoints(A.edges(spark, d), nodes).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("edge_stats", f"with {A.EDGES_SQL}, t(edge_type) as (values ('SIMILAR_TO'), ('MENTIONS'), ('MEMORY_FOLLOWS'), ('SUPERSEDES'), ('PROMOTED_FROM'), ('COMPACTED_FROM'), ('CO_OCCURS'), ('CAUSED_BY'), ('RELATED_TASK')) select t.edge_type, count(e.weight) as n, round(avg(weight), 6) as avg_weight, round(min(weight), 6) as min_weight, round(max(weight), 6) as max_weight from t left join edges e on e.edge_type = t.edge_type group by 1")
def edge_stats(spark, d):
    r = E.type_stats(A.edges(spark, d))
    return r.select("edge_type", "n", *(F.round(c, 6).alias(c) for c in ("avg_weight", "min_weight", "max_weight")))


@query("edges_per_node", f"with {A.EDGES_SQL} select node, edge_type, count(*) as n from (select source_id as node, edge_type from edges union all select target_id, edge_type from edges) group by 1, 2")
def edges_per_node(spark, d):
    return E.per_node(A.edges(spark, d))


# ---------------------------------------------------------------- linkers


@query("entity_degree", "select name, degree from (select l_partkey as name, count(distinct l_orderkey) as degree from lineitem group by 1)")
def entity_degree(spark, d):
    return L.degrees(A.mentions(spark, d)).select("name", "degree")


@query("entity_memories", "select l_orderkey as memory_id, l_shipdate as last_seen_at from lineitem where l_partkey = 11 order by l_shipdate desc, l_orderkey limit 100")
def entity_memories(spark, d):
    return L.memories_of(A.mentions(spark, d), "all", 11).select("memory_id", "last_seen_at")


@query("hub_filtered_neighbors", "with m as (select distinct l_orderkey as o, l_partkey as p from lineitem), k as (select p from m group by 1 having count(*) <= 50), f as (select m.* from m join k using (p)) select a.o as memory_id, b.o as other_id, count(*) as shared, round(least(1, count(*) / 5.0::DOUBLE), 6) as weight from f a join f b on a.p = b.p and a.o <> b.o and a.o % 50 = 0 group by 1, 2")
def hub_filtered_neighbors(spark, d):
    rows = A.mentions(spark, d)
    start = A.table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("memory_id"))
    return L.shared_entity_neighbors(rows, start=start).select("memory_id", "other_id", "shared", F.round("weight", 6).alias("weight"))


CO = """with m as (select distinct l_orderkey as o, l_partkey as p from lineitem), k as (select p, count(*) as deg from m group by 1 having count(*) <= 50), f as (select m.*, deg, max(deg) over (partition by o) as top from m join k using (p)),
    x as (select a.o, b.o as other, a.p, a.deg, a.top, row_number() over (partition by a.o, a.p order by b.o) as n from f a join f b on a.p = b.p and a.o <> b.o),
    s as (select o, other, count(*) as shared, sum(ln(greatest(top / deg::DOUBLE, 1))) / 10 as w from x where n <= 30 group by 1, 2 having count(*) >= 2)
    select least(o, other) as source_id, greatest(o, other) as target_id, arg_min(shared, o) as shared, round(least(1, greatest(0.01, arg_min(w, o))), 4) as weight from s group by 1, 2"""


@query("cooccurrence_edges", CO)
def cooccurrence_edges(spark, d):
    return L.cooccurrence_edges(A.mentions(spark, d))


@query("hub_suppression_empty", "with m as (select distinct user_id as o, props as p from events), k as (select p from m group by 1 having count(*) <= 5) select a.o as memory_id, b.o as other_id, count(*) as shared from m a join m b on a.p = b.p and a.o <> b.o join k on k.p = a.p group by 1, 2")
def hub_suppression_empty(spark, d):
    rows = A.events(spark, d).select(F.col("project").alias("memory_id"), F.lit("all").alias("project"), F.col("props").alias("name"))
    return L.shared_entity_neighbors(rows, hub=5).select("memory_id", "other_id", "shared")


@query("causal_link", "select p.event_id as source_id, e.event_id as target_id from events p join events e on p.event_type = 'purchase' and e.event_type = 'error' and p.user_id = e.user_id and p.event_id - 1 = e.event_id or (p.event_type = 'purchase' and e.event_type = 'error' and p.user_id = e.user_id and e.event_id = p.event_id - p.event_id % 7) and p.ts > e.ts and epoch_us(p.ts) - epoch_us(e.ts) < 30 * 86400000000 and p.event_id <> e.event_id and p.event_id % 7 <> 1")
def causal_link(spark, d):
    rows = A.events(spark, d)
    named = F.explode(F.array_distinct(F.array(F.col("event_seq") - 1, F.col("event_seq") - F.col("event_seq") % 7)))
    fixes = rows.where("memory_type = 'purchase'").withColumn("fixes_task_id", named)
    return L.causal_edges(fixes, rows.where("memory_type = 'error'"))


@query("mentions_merge", "with m as (select l_orderkey as memory_id, l_partkey as name, l_shipdate as seen, case when l_linenumber <= 2 then 0 else 1 end as batch from lineitem) select memory_id, name, max(seen) as last_seen_at, arg_min(seen, (batch, seen)) as created_at, min(batch) = 0 as was_stored from m group by 1, 2")
def mentions_merge(spark, d):
    lines = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.lit("all").alias("project"), F.col("l_partkey").alias("name"), F.col("l_shipdate").alias("last_seen_at"), "l_linenumber")
    rows = lines.withColumn("created_at", F.col("last_seen_at")).withColumn("created_by", F.when(F.col("l_linenumber") <= 2, "stored").otherwise("new"))
    stored = E.merge_mentions(rows.limit(0).drop("l_linenumber"), rows.where("l_linenumber <= 2").drop("l_linenumber"))
    out = E.merge_mentions(stored, rows.where("l_linenumber > 2").drop("l_linenumber"))
    return out.select("memory_id", "name", "last_seen_at", "created_at", (F.col("created_by") == "stored").alias("was_stored"))


@query("provenance_writers", f"with {A.TURNS_SQL}, m as (select memory_id::VARCHAR as id, event_seq from turns) select id as source_id, 'm' || id as target_id, 'PROMOTED_FROM' as edge_type, 1.0::DOUBLE as weight, 'run' as run_id from m where event_seq % 3 = 0 union all select id, x || id, 'COMPACTED_FROM', 1.0, 'run' from m, (values ('a'), ('b')) v(x) where event_seq % 2 = 0")
def provenance_writers(spark, d):
    rows = A.turns(spark, d).select(F.col("memory_id").cast("string").alias("memory_id"), "event_seq")
    marks = rows.withColumn("promoted_from_id", F.when(F.col("event_seq") % 3 == 0, F.concat(F.lit("m"), "memory_id"))).withColumn("promoted_from", F.lit(None).cast("struct<old_id:string,from_layer:string,to_layer:string>"))
    marks = marks.withColumn("compacted_from", F.when(F.col("event_seq") % 2 == 0, F.array(F.concat(F.lit("a"), "memory_id"), F.concat(F.lit("b"), "memory_id"))))
    return L.promotions(marks, "run", A.now()).unionByName(L.compactions(marks, "run", A.now())).select("source_id", "target_id", "edge_type", "weight", "run_id")


# ---------------------------------------------------------------- operational analytics

BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@query(
    "histogram_p95",
    "with b(le) as (values (1.0::DOUBLE), (5), (10), (25), (50), (100), ('inf'::DOUBLE)), c as (select event_type as metric, le, count(*) filter (where value <= le)::DOUBLE as cum from events, b group by 1, 2), "
    "w as (select *, lag(le, 1, 0) over (partition by metric order by le) as below, lag(cum, 1, 0) over (partition by metric order by le) as before, max(cum) over (partition by metric) * 0.95 as target from c) "
    "select metric, round(arg_min(case when le = 'inf'::DOUBLE then below when cum - before <= 0 then le else below + (target - before) / (cum - before) * (le - below) end, le), 6) as p95 from w where cum >= target group by 1",
)
def histogram_p95(spark, d):
    rows = O.to_buckets(A.events(spark, d).withColumnRenamed("memory_type", "metric"), "value", BOUNDS, ["metric"])
    return O.histogram_quantile(rows).select("metric", F.round("quantile", 6).alias("p95"))


@query(
    "run_metrics",
    """with b(le, name) as (values (1.0::DOUBLE, '1'), (5, '5'), (10, '10'), (25, '25'), (50, '50'), (100, '100'), ('inf'::DOUBLE, '+Inf')) select 'event_value' as metric, '_bucket' as suffix, name as le, count(*) filter (where value <= le)::DOUBLE as value from events, b group by name
    union all select 'event_value', '_count', null, count(value)::DOUBLE from events union all select 'event_value', '_sum', null, round(sum(value), 4) from events
    union all select 'events', '_total', null, count(*)::DOUBLE from events union all select 'errors', '_total', null, count(*) filter (where event_type = 'error')::DOUBLE from events union all select 'last_id', '', null, max(event_id)::DOUBLE from events""",
)
def run_metrics(spark, d):
    """Counters, a gauge and a histogram of a job that reads all events once."""
    run = M.RunMetrics()
    rows = run.histogram(A.events(spark, d), "event_value", F.col("value"), BOUNDS)
    rows = run.counter(run.counter(rows, "events"), "errors", F.col("memory_type") == "error")
    run.gauge(rows, "last_id", F.max("memory_id")).write.format("noop").mode("overwrite").save()
    return run.samples(spark).select("metric", "suffix", F.col("labels")["le"].alias("le"), F.round("value", 4).alias("value"))


@query("error_rate", "select user_id, round(sum(case when event_type = 'error' then value else 0 end), 4) as errors, round(sum(value), 4) as total, round(sum(case when event_type = 'error' then value else 0 end) / sum(value), 6) as error_rate from events group by 1")
def error_rate(spark, d):
    r = O.error_rate(A.events(spark, d).withColumnRenamed("project", "user_id").withColumnRenamed("memory_type", "status"), ["user_id"])
    return r.select("user_id", F.round("errors", 4).alias("errors"), F.round("total", 4).alias("total"), F.round("error_rate", 6).alias("error_rate"))


@query(
    "daily_deviation",
    "with d as (select ts::DATE as day, count(*) as n from events group by 1), x as (select *, n - lag(n) over (order by day) as delta from d), "
    "y as (select *, case when count(delta) over (order by day rows between unbounded preceding and 1 preceding) >= 3 then quantile_cont(delta, 0.5) over (order by day rows between unbounded preceding and 1 preceding) end as m from x) "
    "select day::VARCHAR as day, n, delta::DOUBLE as delta, m::DOUBLE as median_delta, case when m is null or delta is null then 'no_data' when m > 0 and (delta > m * 2 or delta < m / 2) then 'violation' when m < 0 and (delta > m / 2 or delta < m * 2) then 'violation' when m = 0 and abs(delta) >= 2 then 'violation' else 'ok' end as status from y",
)
def daily_deviation(spark, d):
    daily = A.events(spark, d).groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("n"))
    r = O.daily_deviation(daily, 2.0)
    return r.withColumn("day", F.col("day").cast("string")).withColumn("delta", F.col("delta").cast("double"))


DAYS_SQL = "select ts::DATE as day, count(*) as n from events group by 1"
ASKED = [
    ("p95_error", "error", "p95", 20.0, "less_than"), ("p95_click", "click", "p95", 1000.0, "less_than"), ("p95_view", "view", "p95", 1.0, "greater_than"), ("p95_none", "absent", "p95", 1.0, "less_than"),
    ("rate_0", "u0", "error_rate", 0.01, "less_than"), ("rate_1", "u1", "error_rate", 0.9, "less_than"), ("change", "all", "daily_change", 2.0, "bounded"),
]


@query(
    "objectives",
    "with o(name, metric, kind, threshold, direction) as (values " + ", ".join(f"('{n}', '{m}', '{k}', {t}::DOUBLE, '{w}')" for n, m, k, t, w in ASKED) + "), "
    "b(le) as (values (1.0::DOUBLE), (5), (10), (25), (50), (100), ('inf'::DOUBLE)), c as (select event_type as metric, le, count(*) filter (where value <= le)::DOUBLE as cum from events, b group by 1, 2), "
    "w as (select *, lag(le, 1, 0) over (partition by metric order by le) as below, lag(cum, 1, 0) over (partition by metric order by le) as before, max(cum) over (partition by metric) * 0.95 as target from c), "
    "a as (select metric, 'p95' as kind, arg_min(case when le = 'inf'::DOUBLE then below when cum - before <= 0 then le else below + (target - before) / (cum - before) * (le - below) end, le) as actual from w where cum >= target group by 1 "
    "union all select 'u' || (user_id % 5), 'error_rate', count(*) filter (where event_type = 'error')::DOUBLE / count(*) from events group by 1), "
    f"d as ({DAYS_SQL}), x as (select *, n - lag(n) over (order by day) as delta from d), l as (select * from x order by day desc limit 1), m as (select case when count(delta) >= 3 then quantile_cont(delta, 0.5) end as m from x where day < (select day from l)), "
    "s as (select o.*, case kind when 'daily_change' then (select case when m is not null then delta::DOUBLE end from l, m) else a.actual end as actual from o left join a using (metric, kind)) "
    "select name, metric, kind, case when actual is null then 'no_data' when kind = 'daily_change' then (select case when (m > 0 and (delta > m * 2 or delta < m / 2)) or (m < 0 and (delta > m / 2 or delta < m * 2)) or (m = 0 and abs(delta) >= 2) then 'violation' else 'ok' end from l, m) "
    "when direction = 'less_than' and actual < threshold or direction = 'greater_than' and actual > threshold then 'ok' else 'violation' end as status, round(actual, 6) as actual, threshold, direction from s",
)
def objectives(spark, d):
    """Objectives of the events' values, error rates and days, from the samples that a metric text would hold."""
    rows = A.events(spark, d)
    label = lambda k, v: F.create_map(F.lit(k), v)
    buckets = O.to_buckets(rows.withColumnRenamed("memory_type", "metric"), "value", BOUNDS, ["metric"])
    samples = buckets.select("metric", F.lit("_bucket").alias("suffix"), label("le", F.col("le").cast("string")).alias("labels"), "value")
    made = rows.groupBy(F.concat(F.lit("u"), (F.col("project") % 5).cast("string")).alias("metric"), F.when(F.col("memory_type") == "error", "error").otherwise("ok").alias("outcome")).agg(F.count("*").cast("double").alias("value"))
    samples = samples.unionByName(made.select("metric", F.lit("_total").alias("suffix"), label("outcome", F.col("outcome")).alias("labels"), "value"))
    daily = rows.groupBy(F.to_date("event_time").cast("string").alias("date")).agg(F.count("*").alias("total"))
    last = daily.agg(F.max("date")).first()[0]  # one value
    return B.evaluate(samples, [B.Objective(*a) for a in ASKED], daily, last).withColumn("actual", F.round("actual", 6))


@query(
    "daily_state",
    "with c as (select ts::DATE as d, event_type as t, count(*) as n from events group by 1, 2) select d::VARCHAR as date, sum(n) as total, string_agg(t || '=' || n, ',' order by t) as types from c group by 1 order by 1 desc limit 7", longs="total",
)
def daily_state(spark, d):
    """The state of the last seven days after two runs: the second replaces the totals of the first, which saw every other event."""
    import uuid

    from engram.operators.lineage import shared_folder

    watch = B.Watch(spark, f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}")
    rows = A.events(spark, d).select(F.to_date("event_time").cast("string").alias("date"), F.col("memory_type").alias("type"), "memory_id")
    count = lambda r: r.groupBy("date", "type").agg(F.count("*").alias("n"))
    watch.record(count(rows.where("memory_id % 2 = 1")))
    watch.record(count(rows))
    pairs = F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return watch.daily().select("date", "total", F.array_join(pairs, ",").alias("types"))


AUDITED = {
    "documents": ("doc_id", "doc_id text lang source n_chars", ("lang", "en fr de xx")), "conversations": ("conv_id,turn", "conv_id turn role text", ("role", "user assistant system")),
    "edges": ("source_id,target_id,edge_type", "source_id target_id edge_type weight created_at last_seen_at created_by run_id", ("edge_type", " ".join(EDGE_TYPES))), "events": ("event_id", "event_id event_type user_id value props", None),
}


def _audit_sql() -> str:
    parts = []
    for t, (key, columns, kinds) in AUDITED.items():
        missing = " or ".join(f"{k} is null" for k in key.split(","))
        parts += [f"select 'rows' as section, '{t}' as table_name, '' as item, count(*) as n from {t}", f"select 'missing_keys', '{t}', '{key}', count(*) filter (where {missing}) from {t}"]
        parts += [f"select 'repeated_keys', '{t}', '{key}', count(*) from (select 1 from {t} where not ({missing}) group by {key} having count(*) > 1)"]
        parts += [f"select 'columns', '{t}', '{c}', count({c}) from {t}" for c in columns.split()]
        if kinds:
            wanted = ", ".join(f"('{v}')" for v in kinds[1].split())
            parts += [f"select 'kinds', '{t}', coalesce(k, v), coalesce(c, 0) from (select coalesce({kinds[0]}, '(null)') as k, count(*) as c from {t} group by 1) full join (values {wanted}) e(v) on k = v"]
    parts += ["select 'properties', 'events', 'props.' || k, count(*) from (select unnest(json_keys(props)) as k from events) group by k"]
    return f"with {A.EDGES_SQL} select section, table_name, item, n::BIGINT as n from (" + " union all ".join(parts) + ")"


@query("schema_audit", _audit_sql())
def schema_audit(spark, d):
    props = F.from_json("props", "map<string,string>").alias("props")
    events = A.table(spark, d, "events").select("event_id", "event_type", "user_id", "value", props)
    frames = {"documents": A.table(spark, d, "documents"), "conversations": A.table(spark, d, "conversations"), "edges": A.edges(spark, d), "events": events}
    tables = {t: frames[t].select(*columns.split()) for t, (_, columns, _) in AUDITED.items()}
    kinds = {t: (k[0], k[1].split()) for t, (_, _, k) in AUDITED.items() if k}
    return O.audit(tables, {t: key.split(",") for t, (key, _, _) in AUDITED.items()}, kinds)


@query("compaction_audit", f"with {A.EDGES_SQL}, c as (select * from edges where edge_type = 'COMPACTED_FROM') select count(*) filter (where created_at >= timestamp '1998-01-01 00:00:00') as recent, count(*) as total, case when count(*) filter (where created_at >= timestamp '1998-01-01 00:00:00') > 0 then 'ok' when count(*) > 0 then 'alert_regression' else 'alert_dead_letter' end as status from c")
def compaction_audit(spark, d):
    return O.compaction_audit(A.edges(spark, d), F.lit("1998-01-01 00:00:00").cast("timestamp")).select("recent", "total", "status")


@query("latency_percentiles", "select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as stdev, min(value) as least, max(value) as most from events group by 1")
def latency_percentiles(spark, d):
    r = O.latency_summary(A.events(spark, d).withColumnRenamed("memory_type", "event_type"), "value", ["event_type"])
    return r.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean", "stdev")), "least", "most")


@query("rolling_state", "with d as (select ts::DATE as date, max(event_id) as taken_at from events group by 1) select date::VARCHAR as date, taken_at from d order by d.date desc limit 7")
def rolling_state(spark, d):
    rows = A.events(spark, d).select(F.to_date("event_time").alias("date"), F.col("memory_id").alias("taken_at"))
    daily = rows.groupBy("date").agg(F.max("taken_at").alias("taken_at"))
    return S.latest_days(daily).withColumn("date", F.col("date").cast("string"))


# ---------------------------------------------------------------- evaluation

JUDGED = "j as (select source as query_id, quality as score, n_chars, doc_id, row_number() over (partition by source order by {order}) as rank from documents join labels using (doc_id))"


def _judged(spark, d, *order):
    rows = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id")
    from engram.operators.retrieval import with_rank

    return with_rank(rows.select(F.col("source").alias("query_id"), F.col("quality").cast("double").alias("score"), "n_chars", "doc_id"), *order)


MRR = "select query_id, round(count(*) filter (where score >= 0.5 and rank <= 10) / 10.0::DOUBLE, 6) as recall_at_k, round(coalesce(1.0::DOUBLE / min(rank) filter (where score >= 0.5 and rank <= 10), 0), 6) as mrr from {t} group by 1"


@query("recall_mrr", "with " + JUDGED.format(order="n_chars desc, doc_id") + " " + MRR.format(t="j"))
def recall_mrr(spark, d):
    r = EV.quality(_judged(spark, d, F.desc("n_chars"), F.col("doc_id")))
    return r.select("query_id", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"))


@query(
    "eval_gate",
    "with " + JUDGED.format(order="n_chars, doc_id") + ", " + JUDGED.format(order="n_chars desc, doc_id").replace("j as", "k as", 1) + ", b as (" + MRR.format(t="j") + "), a as (" + MRR.format(t="k") + ") "
    "select count(*) as n_common, round(avg(a.recall_at_k - b.recall_at_k), 5) as recall_delta, round(avg(a.mrr - b.mrr), 5) as mrr_delta, avg(a.recall_at_k - b.recall_at_k) >= 0.05 or avg(a.mrr - b.mrr) >= 0.05 as passed from a join b using (query_id)",
)
def eval_gate(spark, d):
    before, after = EV.quality(_judged(spark, d, F.col("n_chars"), F.col("doc_id"))), EV.quality(_judged(spark, d, F.desc("n_chars"), F.col("doc_id")))
    r = EV.gate(EV.compare(before, after))
    return r.select("n_common", F.round("recall_delta", 5).alias("recall_delta"), F.round("mrr_delta", 5).alias("mrr_delta"), "passed")


# ---------------------------------------------------------------- writing


@query("bulk_write", f"with {A.TURNS_SQL}, w as (select memory_id, session_id, event_seq, memory_type from turns where trim(coalesce(text, '')) <> '') select count(*) as memories, count(distinct session_id) as sessions, 2 * count(*) as timeline_rows, max(rank) as last_seq from (select *, row_number() over (order by memory_id) as rank from w)")
def bulk_write(spark, d):
    from engram import schema
    from engram.api import TABLES
    from engram.plans import writepath

    rows = A.turns(spark, d).select(
        F.col("memory_id").cast("string").alias("memory_id"), "text", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.col("event_seq"), F.timestamp_seconds(F.col("memory_id")).alias("event_time"), "memory_type",
        F.lit(None).cast("string").alias("category"), F.lit("p").alias("project"), F.col("session_id").cast("string").alias("session_id"),
    )
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    batch = empty["memories"].unionByName(rows, allowMissingColumns=True).select(*(c.split()[0] for c in schema.MEMORIES.split(", ")))
    t = writepath.Tables(**empty)
    t = writepath.applied(t, writepath.write_many(batch, t, A.now()))
    one = t.memories.agg(F.count("*").alias("memories"), F.max("event_seq").alias("last_seq"))
    # single-row totals
    return one.join(t.sessions.agg(F.count("*").alias("sessions"))).join(t.timeline.agg(F.count("*").alias("timeline_rows")))


# ---------------------------------------------------------------- snapshots


def _customers_store(spark, d):
    """customer as a base, then an upsert and a deletion as deltas, each of all tables in one commit."""
    import uuid

    from engram.operators.lineage import shared_folder
    from engram.operators.snapshots import Change, SnapshotStore

    tables = {"customers": ("c_custkey long, c_nationkey long, total double", ["c_custkey"]), "nations": ("n_nationkey long, customers long", ["n_nationkey"])}
    store = SnapshotStore(spark, f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}", tables, large=1)
    customers, orders, nations = A.table(spark, d, "customer"), A.table(spark, d, "orders"), A.table(spark, d, "nation")
    count = lambda rows: rows.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    base = customers.select("c_custkey", "c_nationkey", F.lit(0.0).alias("total"))
    first = store.commit({"customers": Change(base), "nations": Change(count(base))}, store.snapshot())
    first = store.compact()
    spent = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    second = store.commit({"customers": Change(base.drop("total").join(spent, "c_custkey"))}, first)
    gone = second.table("customers").join(nations.where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return store.commit({"customers": Change(deletes=gone.select("c_custkey")), "nations": Change(deletes=gone.select(F.col("c_nationkey").alias("n_nationkey")))}, second)


@query(
    "snapshot_merge",
    """select c_custkey, c_nationkey, coalesce(t, 0) as total, n as customers from customer left join (select o_custkey, round(sum(o_totalprice), 2) as t from orders group by 1) on o_custkey = c_custkey
    join (select c_nationkey as k, count(*) as n from customer group by 1) on k = c_nationkey where c_nationkey not in (select n_nationkey from nation where n_regionkey = 2)""",
)
def snapshot_merge(spark, d):
    """Rows of a base, of deltas over it and without deleted ones, of two tables of one snapshot."""
    last = _customers_store(spark, d)
    return last.table("customers").join(last.table("nations").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey", "c_nationkey", "total", "customers")


@query(
    "time_predecessors",
    """select source_id, target_id, session_id from (select event_id as source_id, lag(event_id) over w as target_id, user_id as session_id, ts::timestamp - lag(ts::timestamp) over w as gap
    from events where user_id is not null and ts is not null window w as (partition by user_id order by ts, event_id)) where gap <= interval 6 hour""",
)
def time_predecessors(spark, d):
    """Events of a user and the ones before them in time, within six hours; a stream gives the same edges."""
    rows = A.events(spark, d).withColumnRenamed("project", "session_id")
    return T.predecessors_in_time(rows, "6 hours")
