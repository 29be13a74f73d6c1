"""Queries of column functions, deletions, sessions and marks that no other module runs over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import router as R
from engram.functions import scalars as X
from engram.operators import edges as E
from engram.operators import graph as G
from engram.operators import linkers as L
from engram.operators import retrieval as Q
from engram.operators import store as S
from engram.operators import timeline as T
from engram.operators import vectors as V
from engram.plans import adapters as A
from engram.plans import retrieve
from engram.plans.base import query
from engram.plans.queries_search import CONFLICTS


def _documents(spark, d):
    return A.table(spark, d, "documents")


# ---------------------------------------------------------------- scores and texts


@query("best_scores", "select doc_id, coalesce(case when doc_id % 3 > 0 then quality end, n_chars)::DOUBLE as best_score from documents left join labels using (doc_id)")
def best_scores(spark, d):
    rows = _documents(spark, d).join(A.table(spark, d, "labels"), "doc_id", "left")
    first = F.when(F.col("doc_id") % 3 > 0, F.col("quality").cast("string")).otherwise("junk")
    return rows.select("doc_id", X.best_score(first, F.col("n_chars")).alias("best_score"))


@query("plain_scores", "select doc_id, coalesce(case when doc_id % 3 = 0 then quality::DOUBLE end, case when doc_id % 5 > 0 then n_chars / 1000.0::DOUBLE end, 0) as score from documents left join labels using (doc_id)")
def plain_scores(spark, d):
    rows = _documents(spark, d).join(A.table(spark, d, "labels"), "doc_id", "left")
    rows = rows.withColumn("rerank_score", F.when(F.col("doc_id") % 3 == 0, F.col("quality").cast("double"))).withColumn("rrf_score", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") / F.lit(1000.0)))
    return rows.select("doc_id", retrieve.plain_score(rows).alias("score"))


@query(
    "score_forms",
    """with l as (select doc_id, n_chars, quality::DOUBLE as q from documents left join labels using (doc_id))
    select doc_id, round(case when doc_id % 4 > 0 then least(greatest((n_chars - 100) / 4900.0::DOUBLE, 0), 1) else 0.5 end, 6) as graph_score, round(coalesce(nullif(q, 0), case when doc_id % 2 = 0 then n_chars / 1000.0::DOUBLE end, 0.5), 6) as raw_semantic from l""",
)
def score_forms(spark, d):
    rows = _documents(spark, d).join(A.table(spark, d, "labels"), "doc_id", "left")
    low = F.when(F.col("doc_id") % 4 > 0, F.lit(100.0)).otherwise(F.lit(5000.0))  # bounds the wrong way round are no bounds
    rrf = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") / F.lit(1000.0))
    graph = X.graph_score(F.col("n_chars"), low, F.lit(5000.0))
    return rows.select("doc_id", F.round(graph, 6).alias("graph_score"), F.round(X.raw_semantic(F.col("quality").cast("double"), rrf), 6).alias("raw_semantic"))


@query("parsed_times", "select event_id as memory_id, epoch_us(case when event_id % 4 > 0 then ts end) as at from events")
def parsed_times(spark, d):
    text = F.when(F.col("memory_id") % 4 == 1, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(F.col("memory_id") % 4 == 2, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    text = text.when(F.col("memory_id") % 4 == 3, F.concat(F.lit("  "), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))).when(F.col("memory_id") % 8 == 0, " ").otherwise("tomorrow-ish")
    return A.events(spark, d).select("memory_id", F.unix_micros(X.parse_time(text)).alias("at"))


@query("safe_tokens", "select p_partkey, regexp_replace(lower(p_name || '/' || p_type), '[^a-z0-9_-]', '_', 'g') as token from part")
def safe_tokens(spark, d):
    return A.table(spark, d, "part").select("p_partkey", X.safe_token(F.concat("p_name", F.lit("/"), "p_type")).alias("token"))


@query("metadata_texts", """select doc_id, case when doc_id % 5 = 0 then '_raw' else 'lang,source' end as keys, case when doc_id % 5 = 0 then 'plain ' || lang else '{"lang":"' || lang || '","source":"' || source || '"}' end as written from documents""")
def metadata_texts(spark, d):
    given = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    rows = _documents(spark, d).withColumn("written", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("plain "), "lang")).otherwise(X.metadata_json(given)))
    return rows.select("doc_id", F.array_join(F.map_keys(X.metadata_map(F.col("written"))), ",").alias("keys"), "written")


@query(
    "recall_questions",
    """with t as (select conv_id, turn, lower(text) as t, text from conversations) select conv_id, turn, regexp_matches(t, 'remember|recall|memory|past|previous|do you know|do you have|heard of|familiar with|know anything about|tell me about|what about|know of') as is_recall,
    case when contains(t, 'the') and not contains(t, 'harbour') and not contains(t, 'tide') then text || ' harbour tide' else text end as boosted from t""", longs="conv_id turn")
def recall_questions(spark, d):
    rows = A.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", X.is_recall(F.col("text")).alias("is_recall"), X.boosted(F.col("text"), "the", ["harbour", "tide"]).alias("boosted"))


@query("recall_categories", "select conv_id, turn, case when regexp_matches(lower(text), 'remember|recall|memory|past|previous|do you know|do you have|heard of|familiar with|know anything about|tell me about|what about|know of') then 'past_conversation' else role end as category from conversations", longs="conv_id turn")
def recall_categories(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", X.recall_category(F.col("text"), F.col("role")).alias("category"))


@query("candidate_texts", "select doc_id, md5(substr(coalesce(case when doc_id % 3 = 0 and trim(text) <> '' then text end, case when doc_id % 3 = 2 then source || ': ' || text end, 'all of ' || doc_id), 1, 1000)) as text_md5 from documents")
def candidate_texts(spark, d):
    content = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("  ")
    text = F.when(F.col("doc_id") % 3 == 2, F.concat("source", F.lit(": "), "text"))
    return _documents(spark, d).select("doc_id", F.md5(X.candidate_text(content, text, F.concat(F.lit("all of "), F.col("doc_id").cast("string")))).alias("text_md5"))


@query("named_items", "select doc_id from documents where contains(lower(text), 'apache license') or contains(doc_id::VARCHAR, 'apache license') or contains(lower(text), '77') or contains(doc_id::VARCHAR, '77')")
def named_items(spark, d):
    return _documents(spark, d).where(Q.named_in(F.col("text"), F.col("doc_id"), [" Apache License ", "  ", "77"])).select("doc_id")


@query("content_ids", "select doc_id, case when doc_id % 3 = 1 then 'given' || doc_id else md5(text) end as memory_id from documents")
def content_ids(spark, d):
    given = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" given"), "doc_id", F.lit(" "))).when(F.col("doc_id") % 3 == 2, "  ")
    return _documents(spark, d).select("doc_id", X.content_id(given, F.col("text")).alias("memory_id"))


@query("expansion_modes", "select doc_id, lang not in ('en', 'fr') as expands from documents")
def expansion_modes(spark, d):
    mode = F.when(F.col("lang") == "en", R.NOT_EXPANDED[0]).when(F.col("lang") == "fr", R.NOT_EXPANDED[1]).otherwise("HYBRID")
    return _documents(spark, d).select("doc_id", R.expands(mode).alias("expands"))


# ---------------------------------------------------------------- edges and graphs


@query("supersedes_edges", f"""select new_id as source_id, memory_id as target_id, 'SUPERSEDES' as edge_type, 1.0::DOUBLE as weight, 'conflict_detector' as created_by, '{{"reason":"conflict_detection: similarity=' || printf('%.3f', score) || '"}}' as metadata from ({CONFLICTS})""")
def supersedes_edges(spark, d):
    rows = A.vectors(spark, d)
    found = V.conflicts(rows.where("memory_id % 50 = 0"), rows, 0.25, 0.35).withColumn("score", F.round("score", 6))
    return L.supersedes(found, "run", A.now()).select("source_id", "target_id", "edge_type", "weight", "created_by", "metadata")


@query("item_entities", "with m as (select distinct l_orderkey as o, l_partkey as p from lineitem), d as (select p, count(*) as degree from m group by 1) select o as memory_id, p as name, degree, row_number() over (partition by o order by degree desc, p) as rank from m join d using (p)")
def item_entities(spark, d):
    return L.entities_of(A.mentions(spark, d)).select("memory_id", "name", "degree", "rank")


@query("promotion_layers", """select doc_id::VARCHAR as source_id, 'old' || doc_id as target_id, case when doc_id % 4 = 0 then '{"from_layer":"a","to_layer":"b"}' else '{}' end as metadata from documents where doc_id % 4 in (0, 2)""")
def promotion_layers(spark, d):
    """Both layers make a promotion, and none; half a pair makes none."""
    layer = lambda name, *kinds: F.when((F.col("doc_id") % 4).isin(*kinds), name).cast("string").alias(f"{'from' if name == 'a' else 'to'}_layer")
    old = F.concat(F.lit("old"), "doc_id")
    rows = _documents(spark, d).select(F.col("doc_id").cast("string").alias("memory_id"), F.when(F.col("doc_id") % 4 != 0, old).alias("promoted_from_id"), F.struct(F.when(F.col("doc_id") % 4 == 0, old).alias("old_id"), layer("a", 0, 1), layer("b", 0, 3)).alias("promoted_from"))
    return L.promotions(rows, "run", A.now()).select("source_id", "target_id", "metadata")


@query("edge_delete_from", f"with {A.EDGES_SQL} select edge_type, count(*) as removed from edges where target_id = 'p11' and edge_type in ('CO_OCCURS', 'SIMILAR_TO') group by 1")
def edge_delete_from(spark, d):
    rows = A.edges(spark, d)
    one, two = (E.delete(rows, E.matching(target_id="p11", edge_type=t))[1] for t in ("CO_OCCURS", "SIMILAR_TO"))
    return one.unionByName(two)


@query("edges_landed", f"with {A.EDGES_SQL}, o as (select 'o' || o_orderkey as id from orders where o_orderstatus = 'F' union all select 'p' || p_partkey from part) select count(*) as landed from (select distinct case when edge_type in ('SIMILAR_TO', 'CO_OCCURS') then least(source_id, target_id) else source_id end, case when edge_type in ('SIMILAR_TO', 'CO_OCCURS') then greatest(source_id, target_id) else target_id end, edge_type from edges where source_id in (select id from o) and target_id in (select id from o))")
def edges_landed(spark, d):
    nodes = A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("memory_id")).unionByName(A.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("memory_id")))
    rows = A.edges(spark, d)
    return E.merge(rows.limit(0), E.with_endpoints(rows, nodes)).agg(F.count("*").alias("landed"))


@query("multihop_latest", f"""with recursive {A.PLACES_SQL}, h(node, dist) as (select 'r0', 0 union select other, dist + 1 from h join ways using (node) where dist < 3), m as (select node, min(dist) as distance from h group by 1)
    select node, distance from m where distance > 0 order by distance, length(node) desc nulls last, node desc limit 20""", longs="distance")
def multihop_latest(spark, d):
    places = A.places(spark, d)
    seqs = places.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct().withColumn("event_seq", F.length("node"))
    return G.multihop(places, spark.range(1).select(F.lit("r0").alias("node")), 3, seqs=seqs).select("node", "distance")


@query("ego_counts", f"""with recursive {A.PLACES_SQL}, h(node, dist) as (select 'n3', 0 union select other, dist + 1 from h join ways using (node) where dist < 2), m as (select distinct node from h),
    e as (select distinct source_id, target_id, edge_type from places where source_id in (select node from m) and target_id in (select node from m))
    select least((select count(*) from m), 200) as n_nodes, least((select count(*) from e), 400) as n_edges, (select count(*) from m) > 200 or (select count(*) from e) > 400 as truncated""")
def ego_counts(spark, d):
    return G.ego_summary(A.places(spark, d), "n3")


@query("decision_recall", f"""with {A.PLACES_SQL}, m as (select 's' || s_suppkey as id, s_name from supplier where s_suppkey % 2 = 0 and contains(lower(s_name), '00') order by s_suppkey desc limit 10), n as (select distinct id, other from m join ways on node = id)
    select id as memory_id, string_agg(other, ',' order by other) as related from n group by 1""")
def decision_recall(spark, d):
    rows = A.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("memory_id"), F.col("s_name").alias("text"), F.col("s_suppkey").alias("event_seq"), F.when(F.col("s_suppkey") % 2 == 0, "decision").otherwise("note").alias("memory_type"))
    out = G.decisions(rows, A.places(spark, d), "  00 ", 10)
    return out.select("memory_id", F.array_join(F.transform("related", lambda r: r["other"]), ",").alias("related"))


# ---------------------------------------------------------------- sessions


@query("session_pages", "select distinct conv_id as session_id from conversations where conv_id > 5 order by 1 limit 20")
def session_pages(spark, d):
    return T.session_page(A.turns(spark, d), 5, 20)


@query("item_pages", "select doc_id, n_chars from documents where doc_id > 50 order by doc_id limit 40")
def item_pages(spark, d):
    return S.keyset_page(_documents(spark, d).select("doc_id", "n_chars"), 50, 40, "doc_id")


@query("session_links", f"with {A.TURNS_SQL} select session_id, count(distinct memory_id) as members, session_id % 3 <> 0 as is_new from turns where event_seq % 2 = 0 group by 1")
def session_links(spark, d):
    rows = A.turns(spark, d)
    known = rows.where("session_id % 3 = 0").select("session_id").distinct().withColumn("last_event_seq", F.lit(1).cast("long"))
    links = rows.select("session_id", "memory_id").unionByName(rows.select("session_id", "memory_id")).unionByName(rows.select("session_id", (-1 - F.col("memory_id")).alias("memory_id")))
    sessions, includes = T.link_sessions(known, links, rows.where("event_seq % 2 = 0"))
    members = includes.groupBy("session_id").agg(F.count("*").alias("members"))
    return sessions.join(members, "session_id").select("session_id", "members", F.col("last_event_seq").isNull().alias("is_new"))


@query("session_follows", f"with {A.TURNS_SQL}, s as (select session_id, max(event_seq) as last, session_id % 7 as project from turns group by 1) select * from (select session_id, lag(session_id) over (partition by project order by last, session_id) as prev_session_id from s) where prev_session_id is not null")
def session_follows(spark, d):
    sessions = A.turns(spark, d).groupBy("session_id").agg(F.max("event_seq").alias("last_event_seq")).withColumn("project", F.col("session_id") % 7).withColumn("thread_id", F.lit("t"))
    return T.follows(sessions)


@query("checkpoint_rows", f"with {A.TURNS_SQL}, t as (select max(event_seq) as last from turns) select unnest(['p', 'global']) as scope, last + 1 as event_seq, md5('s1:so far') as memory_id, last as last_event_seq from t")
def checkpoint_rows(spark, d):
    rows = A.turns(spark, d)
    sessions = spark.createDataFrame([("s0", 3, "p", None)], "session_id string, last_event_seq long, project string, thread_id string")
    made = T.make_checkpoint(rows, sessions, "s1", "so far", "p")
    return made["timeline"].select("scope", "event_seq", "memory_id", "last_event_seq")


@query("rerank_cascade", "select source as query_id, doc_id as memory_id, case when source < 'src5' then -n_chars::DOUBLE else n_chars::DOUBLE end as rerank_score, case when source < 'src5' then 'scorer_2' else 'scorer' end as reranker_used from documents where trim(text) <> '' qualify row_number() over (partition by source order by case when source < 'src5' then -n_chars else n_chars end desc, doc_id) <= 15")
def rerank_cascade(spark, d):
    """The first scorer fails on some queries, where the second is asked."""
    rows = _documents(spark, d).select(F.col("source").alias("query_id"), F.col("source").alias("query"), F.col("doc_id").alias("memory_id"), "text", F.lit(0.01).alias("rrf_score"), "n_chars")
    scorers = [lambda q, t: F.when(q >= "src5", F.length(t)), lambda q, t: -F.length(t)]
    return Q.rerank(rows, scorers).select("query_id", "memory_id", "rerank_score", "reranker_used")
