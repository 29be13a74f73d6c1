"""Queries of search, fusion, scoring and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import entities as N
from engram.functions import router as R
from engram.functions import scalars as X
from engram.operators import retrieval as Q
from engram.operators import vectors as V
from engram.operators.index import VectorIndex
from engram.plans import adapters as A
from engram.plans.base import query

COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


TOP = f"with {A.VECTORS_SQL}, q as (select embedding as e from vectors where memory_id = 0) select memory_id, project, round({cos('embedding', 'e')}, 6) as score from vectors, q {{where}} order by {cos('embedding', 'e')} desc, memory_id limit 10"


@query("vector_topk", TOP.format(where=""), longs="project")
def vector_topk(spark, d):
    return V.top_k(A.vectors(spark, d), A.first_vector(spark, d), 10).select("memory_id", "project", F.round("score", 6).alias("score"))


@query("vector_topk_filtered", TOP.format(where="where project in (1, 3, 5)"), longs="project")
def vector_topk_filtered(spark, d):
    wanted = Q.compile_filter({"project": {"$in": [1, 3, 5]}})
    return V.top_k(A.vectors(spark, d), A.first_vector(spark, d), 10, wanted).select("memory_id", "project", F.round("score", 6).alias("score"))


@query("point_lookup", "select vec_id as memory_id, label as project from embeddings where vec_id in (1, 5, 9, 100000000)", longs="project")
def point_lookup(spark, d):
    from engram.operators.store import lookup

    return lookup(A.vectors(spark, d), [1, 5, 9, 100_000_000]).select("memory_id", "project")


@query(
    "similarity_edges",
    f"""with {A.VECTORS_SQL}, p as (select a.memory_id as s, b.memory_id as t, {cos('a.embedding', 'b.embedding')} as score from vectors a join vectors b on a.project = b.project and a.memory_id <> b.memory_id),
    r as (select *, row_number() over (partition by s order by score desc, t) as n from p where score >= 0.25)
    select least(s, t) as source_id, greatest(s, t) as target_id, round(max(score), 6) as weight from r where n <= 10 group by all""",
)
def similarity_edges(spark, d):
    return V.similarity_edges(A.vectors(spark, d), threshold=0.25).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


# every fiftieth row is asked, against all rows; ranks come before the row itself is left out
PROBE = f"""with {A.VECTORS_SQL}, p as (select a.memory_id as new_id, b.memory_id, {cos('a.embedding', 'b.embedding')} as score from vectors a join vectors b on a.memory_id % 50 = 0 {{kind}}),
    r as (select *, row_number() over (partition by new_id order by score desc, memory_id) as n from p)"""
CONFLICTS = PROBE.format(kind="and b.memory_type = 'decision'") + " select new_id, memory_id, round(score, 6) as score from r where n <= 5 and score >= 0.25 and score < 0.35 and new_id <> memory_id"


@query("dedup_probe", PROBE.format(kind="") + " select new_id, arg_min(memory_id, n) as memory_id, round(arg_min(score, n), 6) as score from r where n <= 3 and score >= 0.3 and new_id <> memory_id group by new_id")
def dedup_probe(spark, d):
    rows = A.vectors(spark, d)
    return V.duplicates(rows.where("memory_id % 50 = 0"), rows, threshold=0.3).select("new_id", "memory_id", F.round("score", 6).alias("score"))


@query("conflict_band", CONFLICTS)
def conflict_band(spark, d):
    rows = A.vectors(spark, d)
    return V.conflicts(rows.where("memory_id % 50 = 0"), rows, 0.25, 0.35).select("new_id", "memory_id", F.round("score", 6).alias("score"))


# the same with all rows asked
PROBE_ALL = f"""with {A.VECTORS_SQL}, p as (select a.memory_id as new_id, b.memory_id, {cos('a.embedding', 'b.embedding')} as score from vectors a join vectors b on true {{kind}}),
    r as (select *, row_number() over (partition by new_id order by score desc, memory_id) as n from p)"""


@query("dedup_probe_all", PROBE_ALL.format(kind="") + " select new_id, arg_min(memory_id, n) as memory_id, round(arg_min(score, n), 6) as score from r where n <= 3 and score >= 0.3 and new_id <> memory_id group by new_id")
def dedup_probe_all(spark, d):
    rows = A.vectors(spark, d)
    return V.duplicates(rows, rows, threshold=0.3).select("new_id", "memory_id", F.round("score", 6).alias("score"))


@query("conflict_band_all", PROBE_ALL.format(kind="and b.memory_type = 'decision'") + " select new_id, memory_id, round(score, 6) as score from r where n <= 5 and score >= 0.25 and score < 0.35 and new_id <> memory_id")
def conflict_band_all(spark, d):
    rows = A.vectors(spark, d)
    return V.conflicts(rows, rows, 0.25, 0.35).select("new_id", "memory_id", F.round("score", 6).alias("score"))


@query(
    "index_recall",
    f"""with {A.VECTORS_SQL}, p as (select a.memory_id as s, b.memory_id as t, {cos('a.embedding', 'b.embedding')} as score from vectors a join vectors b on a.memory_id % 50 = 0 and a.memory_id <> b.memory_id),
    r as (select *, row_number() over (partition by s order by score desc, t) as n from p where score >= 0.25)
    select count(*) as neighbors, true as recall_reached, 0 as wrong from r where n <= 10""", longs="wrong")
def index_recall(spark, d):
    """Every row indexed as one project; every fiftieth asked: its exact neighbors, whether 0.9 of them are found, and how many others are."""
    rows = A.vectors(spark, d).withColumn("project", F.lit(1))
    asked = rows.where("memory_id % 50 = 0")
    index = VectorIndex.build(rows, 0.25)
    exact = V.neighbors(rows, 0.25, asked=asked).select("source_id", "target_id", F.lit(True).alias("exact"))
    found = exact.limit(0).drop("exact").withColumn("found", F.lit(True)) if index is None else index.search(asked, 0.25).select("source_id", "target_id", "score", F.lit(True).alias("found"))
    both = exact.join(found, ["source_id", "target_id"], "full")
    # what the index finds besides is a neighbor too, of a rank that one missed has left
    hit = F.count_if(F.col("exact") & F.col("found"))
    return both.agg(F.count("exact").alias("neighbors"), (hit >= 0.9 * F.count("exact")).alias("recall_reached"), F.count_if(F.col("exact").isNull() & ~(F.col("score") >= 0.25)).alias("wrong"))


@query(
    "semantic_cache",
    f"""with {A.VECTORS_SQL}, q as (select embedding as e from vectors where memory_id = 0), s as (select memory_id, list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1] - z[2]) ** 2)) as dist from vectors, q)
    select memory_id, round(dist, 6) as distance from (select * from s order by dist, memory_id limit 5) where dist < 1.4""",
)
def semantic_cache(spark, d):
    return V.nearest_squared(A.vectors(spark, d), A.first_vector(spark, d), limit=1.4).select("memory_id", F.round("distance", 6).alias("distance"))


def _lists(spark, d):
    """Two candidate lists of one query: 50 nearest vectors, and 50 items by id; texts where there are any."""
    rows, docs = A.vectors(spark, d), A.table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), "text")
    near = V.top_k(rows, A.first_vector(spark, d), 50).drop("embedding").withColumn("query_id", F.lit(1))
    near = Q.with_rank(near, F.desc("score"), F.col("memory_id")).withColumn("source", F.lit("vector")).withColumn("score", X.vector_score(F.col("score")))
    graph = rows.drop("embedding").orderBy("memory_id").limit(50).withColumn("query_id", F.lit(1)).withColumn("score", F.lit(0.5))
    graph = Q.with_rank(graph, F.col("memory_id")).withColumn("source", F.lit("graph"))
    return near.unionByName(graph).join(docs, "memory_id", "left")


FUSED = f"""with {A.VECTORS_SQL}, q as (select embedding as e from vectors where memory_id = 0),
    s as (select memory_id, project, category, memory_type, event_time, {cos('embedding', 'e')} as score from vectors, q),
    n as (select *, row_number() over (order by score desc, memory_id) as rank from s),
    lists as (select memory_id, category, memory_type, event_time, rank, 'vector' as source from n where rank <= 50
      union all select * from (select memory_id, category, memory_type, event_time, row_number() over (order by memory_id) as rank, 'graph' as source from vectors) where rank <= 50),
    t as (select lists.*, case when trim(coalesce(text, '')) <> '' then text when lists.source = 'vector' then 'Vector Result ID: ' || memory_id else 'Graph Result ID: ' || memory_id end as text2
      from lists left join documents on doc_id = memory_id),
    h as (select *, md5(text2) as text_hash, case when source = 'vector' then 0 else 1 end * 1000 + rank as pos from t),
    f as (select text_hash, sum(1.0::DOUBLE / (60 + rank)) as rrf, arg_min(memory_id, pos) as memory_id, arg_min(category, pos) as category, arg_min(event_time, pos) as event_time,
      min(case when source = 'vector' then rank end) as initial_rank_vector, min(case when source = 'graph' then rank end) as initial_rank_graph from h group by 1)"""


@query("rrf_fusion", FUSED + " select text_hash, memory_id, round(rrf, 6) as rrf_score, coalesce(initial_rank_vector, 0) as initial_rank_vector, coalesce(initial_rank_graph, 0) as initial_rank_graph from f")
def rrf_fusion(spark, d):
    return Q.reciprocal_rank_fusion(_lists(spark, d)).select("text_hash", "memory_id", F.round("rrf_score", 6).alias("rrf_score"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("initial_rank_vector", "initial_rank_graph")))


@query(
    "fused_ranked",
    FUSED
    + """, r as (select *, row_number() over (order by rrf desc, memory_id) as prev_rank from f), b as (select *, epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(event_time) as age,
      case category when 'debug' then 7 when 'context' then 14 when 'research' then 30 when 'decision' then 90 when 'pattern' then 180 else 30 end as life from r where prev_rank <= 15),
    c as (select *, least(greatest(rrf / 0.035, 0), 1) as s, case when age < 0 then 1 else greatest(0.01, exp(-ln(2) * (age / 86400e6) / life)) end as t from b),
    e as (select *, round(least(greatest(0.55 * s + 0.30 * t + 0.10 * 0.5 + 0.05 * 0.5, 0), 1), 6) as composite_score from c)
    select memory_id, round(s, 6) as semantic_score, round(t, 6) as temporal_score, composite_score, row_number() over (order by composite_score desc, prev_rank) as final_rank from e""",
)
def fused_ranked(spark, d):
    ranked = Q.rerank(Q.reciprocal_rank_fusion(_lists(spark, d)))
    out = Q.time_weighted(ranked, A.now())
    return out.select("memory_id", F.col("semantic_score_normalized").alias("semantic_score"), "temporal_score", "composite_score", "final_rank")


@query(
    "mmr_select",
    f"""with recursive {A.VECTORS_SQL}, q as (select embedding as e from vectors where memory_id = 0),
    c as (select memory_id, embedding, {cos('embedding', 'e')} as score, row_number() over (order by {cos('embedding', 'e')} desc, memory_id) as prev_rank from vectors, q qualify prev_rank <= 50),
    n as (select *, (score - min(score) over ()) / (max(score) over () - min(score) over ()) as rel from c),
    near as (select a.memory_id as a, b.memory_id as b, {cos('a.embedding', 'b.embedding')} as c from n a, n b),
    pick(step, chosen) as (select 1, [(select memory_id from n order by rel desc, prev_rank limit 1)] union all select step + 1, list_append(chosen, (select arg_max(v.memory_id, (v.value, -v.prev_rank)) from
      (select n.memory_id, n.prev_rank, 0.7 * n.rel - 0.3 * max(near.c) as value from n join near on near.a = n.memory_id and list_contains(chosen, near.b) where not list_contains(chosen, n.memory_id) group by n.memory_id, n.prev_rank, n.rel) v)) from pick where step < 15)
    select unnest(chosen) as memory_id, generate_subscripts(chosen, 1) as mmr_rank from pick where step = 15""",
)
def mmr_select(spark, d):
    near = V.top_k(A.vectors(spark, d), A.first_vector(spark, d), 50).withColumn("query_id", F.lit(1))
    ranked = Q.with_rank(near, F.desc("score"), F.col("memory_id"), name="prev_rank").withColumnRenamed("score", "relevance")
    return V.mmr(ranked).select("memory_id", "mmr_rank")


NEAREST = f"q as (select embedding as e from vectors where memory_id = 0), z as (select memory_id, {cos('embedding', 'e')} as score, row_number() over (order by {cos('embedding', 'e')} desc, memory_id) as n from vectors, q)"


@query(
    "expansion_merge",
    f"""with {A.VECTORS_SQL}, {NEAREST}, s as (select memory_id, (memory_id % 97) / 97.0::DOUBLE as composite_score, false as is_expansion from z where n <= 20),
    x as (select memory_id, case when memory_id % 3 = 0 then null else (memory_id % 7 - 3) / 3.0::DOUBLE end as rerank_score, (memory_id % 11) / 11.0::DOUBLE as expansion_score from z where n between 21 and 81),
    g as (select memory_id, coalesce(rerank_score, expansion_score) as composite_score, true as is_expansion from x where rerank_score is null or rerank_score >= 0),
    b as (select * from (select *, row_number() over (order by composite_score desc, memory_id) as n from g) where n <= 3), u as (select * from s union all select memory_id, composite_score, is_expansion from b)
    select memory_id, round(composite_score, 6) as composite_score, is_expansion, final_rank from (select *, row_number() over (order by composite_score desc, is_expansion, memory_id) as final_rank from u) where final_rank <= 15""",
)
def expansion_merge(spark, d):
    near = V.top_k(A.vectors(spark, d), A.first_vector(spark, d), 81).select("memory_id", "score").withColumn("query_id", F.lit(1))
    rows = Q.with_rank(near, F.desc("score"), F.col("memory_id"), name="n").drop("score")
    seeds = rows.where("n <= 20").drop("n").withColumn("composite_score", F.col("memory_id") % 97 / F.lit(97.0))
    x = rows.where("n > 20").drop("n").withColumn("composite_score", F.lit(None).cast("double")).withColumn("expansion_score", F.col("memory_id") % 11 / F.lit(11.0))
    x = x.withColumn("rerank_score", F.when(F.col("memory_id") % 3 != 0, (F.col("memory_id") % 7 - 3) / F.lit(3.0)))
    return Q.merge_expansion(seeds, x).select("memory_id", F.round("composite_score", 6).alias("composite_score"), "is_expansion", "final_rank")


@query("exact_dedup", "select text_hash, doc_id from (select md5(text) as text_hash, doc_id, row_number() over (partition by md5(text) order by doc_id) as n from documents) where n = 1")
def exact_dedup(spark, d):
    # the text itself is not carried on: one row a text and task is shuffled
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    return Q.first_of_each_text(docs, F.col("doc_id")).select("text_hash", "doc_id")


QUERIES = [
    "what did we decide about the storage layer", "recent decisions about auth", "what is the latest best practice for deployment", "what happened in yesterday's session",
    "tell me about the most recent research on databases", "compare vector databases and graph databases", "who is the lead engineer", "hello world", "", "   ", "why did we choose parquet",
    "pick up where we left off", "how do we deploy", "related services", "link between cache and store", "Explain the connection between A and B", "list all relationship types", "pros and cons of the usual approach",
]


# the modes that these have by the rules, and by the older rules
MODES = ["DECISION", "DECISION", "PATTERN", "SESSION", "TEMPORAL_SEMANTIC", "GRAPH", "VECTOR", "HYBRID", "HYBRID", "HYBRID", "DECISION", "SESSION", "PATTERN", "HYBRID", "GRAPH", "GRAPH", "VECTOR", "DECISION"]
OLDER = ["HYBRID", "HYBRID", "VECTOR", "HYBRID", "HYBRID", "GRAPH", "VECTOR", "HYBRID", "HYBRID", "HYBRID", "HYBRID", "HYBRID", "HYBRID", "HYBRID", "GRAPH", "HYBRID", "HYBRID", "HYBRID"]


def _phrased(spark, d, phrases: list[str]):
    """Every conversation turn as a query: one of the phrases before its text, by its number."""
    one = F.element_at(F.array(*map(F.lit, phrases)), (F.col("memory_id") % len(phrases) + 1).cast("int"))
    return A.turns(spark, d).select(F.col("memory_id").alias("query_id"), F.concat(one, F.lit(" "), F.coalesce("text", F.lit(""))).alias("q"))


def _phrases_sql(phrases: list[str], *more: list) -> str:
    """turns with each one's phrase (p) and what goes with it (m0, m1, ...)."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    rows = ", ".join("(" + ", ".join(map(quoted, (i, p, *(m[i] for m in more)))) + ")" for i, p in enumerate(phrases))
    names = ", ".join(["i", "p", *(f"m{k}" for k in range(len(more)))])
    return f"{A.TURNS_SQL}, phrases({names}) as (values {rows}), asked as (select memory_id as query_id, phrases.*, p || ' ' || coalesce(text, '') as q from turns join phrases on memory_id % {len(phrases)} = i)"


@query("route_queries", f"with {_phrases_sql(QUERIES, MODES)} select query_id, m0 as mode from asked")
def route_queries(spark, d):
    return _phrased(spark, d, QUERIES).select("query_id", R.route(F.col("q")).alias("mode"))


@query("route_queries_legacy", f"with {_phrases_sql(QUERIES, OLDER)} select query_id, m0 as mode from asked")
def route_queries_legacy(spark, d):
    return _phrased(spark, d, QUERIES).select("query_id", R.route_by_keywords(F.col("q")).alias("mode"))


@query(
    "temporal_decay",
    """with e as (select event_id as memory_id, case event_type when 'error' then 'debug' when 'purchase' then 'decision' when 'view' then 'context' when 'signup' then 'pattern' end as category,
      epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(ts) as age from events), l as (select *, case category when 'debug' then 7 when 'context' then 14 when 'decision' then 90 when 'pattern' then 180 else 30 end as life from e)
    select memory_id, category, round(case when age < 0 then 1 else greatest(0.01, exp(-ln(2) * (age / 86400e6) / life)) end, 6) as temporal_score from l""",
)
def temporal_decay(spark, d):
    kind = F.when(F.col("memory_type") == "error", "debug").when(F.col("memory_type") == "purchase", "decision").when(F.col("memory_type") == "view", "context").when(F.col("memory_type") == "signup", "pattern")
    rows = A.events(spark, d).withColumn("category", kind)
    return rows.select("memory_id", "category", F.round(X.temporal_decay(F.col("event_time"), F.col("category"), A.now()), 6).alias("temporal_score"))


@query(
    "composite_score",
    f"""with {A.VECTORS_SQL}, q as (select embedding as e from vectors where memory_id = 0), s as (select memory_id, {cos('embedding', 'e')} as c, epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(event_time) as age from vectors, q),
    r as (select memory_id, 1 / (1 + exp(-c)) as logistic, (least(greatest(c, -1), 1) + 1) / 2 as v, case when age < 0 then 1 else greatest(0.01, exp(-ln(2) * (age / 86400e6) / 30)) end as t from s)
    select memory_id, round(logistic, 6) as logistic, round(v, 6) as normalized, round(least(greatest(0.55 * v + 0.30 * t + 0.075, 0), 1), 6) as composite from r""",
)
def composite_score(spark, d):
    q = F.array(*(F.lit(float(x)) for x in A.first_vector(spark, d)))
    rows = A.vectors(spark, d).select("memory_id", "event_time", V.cosine(F.col("embedding"), q).alias("c"))
    v = X.vector_score(F.col("c"))
    t = X.temporal_decay(F.col("event_time"), F.lit("default"), A.now())
    return rows.select("memory_id", F.round(X.semantic_score(F.col("c"), "rerank"), 6).alias("logistic"), F.round(v, 6).alias("normalized"), F.round(X.composite_score(v, t), 6).alias("composite"))


@query(
    "duplicate_action",
    """with e as (select event_id as memory_id, event_id % 2 = 0 as found, (['skip', 'update', 'append', 'other', null])[(event_id // 2 % 5)::INT + 1] as explicit,
      (['debug', 'scratch', 'decision', 'research', 'context', 'pattern', 'x', null])[(event_id // 10 % 8)::INT + 1] as category from events)
    select *, case when not found then 'append' when explicit in ('skip', 'update', 'append') then explicit when category in ('debug', 'scratch') then 'skip' when category = 'decision' then 'update'
      when category in ('research', 'context', 'pattern') then 'append' else 'skip' end as action from e""",
)
def duplicate_action(spark, d):
    pick = lambda values, step: F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(F.col("memory_id") / step), F.lit(len(values))).cast("int"))
    explicit = pick(("skip", "update", "append", "other", None), 2)
    category = pick(("debug", "scratch", "decision", "research", "context", "pattern", "x", None), 10)
    rows = A.events(spark, d).select("memory_id", (F.col("memory_id") % 2 == 0).alias("found"), explicit.alias("explicit"), category.alias("category"))
    return rows.withColumn("action", X.duplicate_action(F.col("found"), F.col("explicit"), F.col("category")))


@query(
    "metadata_filter",
    """select doc_id, best_score from (select d.doc_id, d.source, round(coalesce(l.quality, 0) * 0.5 + d.n_chars % 100 / 200.0::DOUBLE, 6) as best_score, [d.lang, 's' || (d.doc_id % 3)] as tags, d.lang as category from documents d left join labels l using (doc_id))
    where lower(trim(category)) = 'en' and trim(source) = 'src1' and list_has_all(tags, ['en', 's1']) and best_score >= 0.2""",
)
def metadata_filter(spark, d):
    rows = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id", "left")
    score = F.round(F.coalesce("quality", F.lit(0)) * 0.5 + F.col("n_chars") % 100 / F.lit(200.0), 6)
    rows = rows.select("doc_id", F.col("lang").alias("category"), F.col("source").alias("run_id"), F.array(F.col("lang"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).alias("tags"), score.alias("best_score"))
    return Q.result_filter(rows, category=" EN ", run_id="src1", tags=["en", "s1"], min_score=0.2).select("doc_id", "best_score")


@query(
    "token_budget",
    r"""with w as (select source, doc_id, case when trim(text) = '' then 0 else len(string_split_regex(trim(text, e' \t\n\r'), '\s+')) end as n_words from documents),
    r as (select *, sum(n_words) over (partition by source order by doc_id rows unbounded preceding)::BIGINT as words_so_far from w) select source, doc_id, n_words::BIGINT as n_words, words_so_far from r where words_so_far <= 3000""",
)
def token_budget(spark, d):
    rows = A.table(spark, d, "documents").select("source", "doc_id", "text")
    return Q.within_budget(rows, group="source", order="doc_id").select("source", "doc_id", "n_words", "words_so_far")


@query("canon_entities", "select p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') as name from part")
def canon_entities(spark, d):
    return A.table(spark, d, "part").select("p_partkey", N.canon(F.col("p_name")).alias("name"))


CAMEL = r"list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*')))"


@query("camelcase_entities", f"with n as (select doc_id, {CAMEL} as l from documents) select doc_id, list_aggregate(list_sort(l), 'string_agg', ',') as names from n where len(l) > 0")
def camelcase_entities(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", N.pattern_names(F.col("text")).alias("n")).where(F.size("n") > 0)
    return rows.select("doc_id", F.array_join(F.array_sort("n"), ",").alias("names"))


@query("content_entities")
def content_entities(spark, d):
    """Up to 20 names of each page; like a write, it reads the first 100,000 bytes of a page."""
    return A.table(spark, d, "pages").select("page_id", N.identifiers_of()(F.col("html")).alias("n")).select("page_id", F.size("n").alias("n_names"), F.array_join("n", ",").alias("names"))


MENTIONING = ["Ask Neo4j Team about the API", "redis and python with docker", "nothing here", "The Circuit Breaker of New York uses the SDK", "LLM LLM MT5"]


# what they mention: place, name, kind, confidence
MENTIONED = [
    [("neo4j", "technology", 1.0), ("API", "technology", 0.8)],
    [("redis", "technology", 1.0), ("python", "technology", 1.0), ("docker", "technology", 1.0)],
    [],
    [("circuit breaker", "concept", 1.0), ("SDK", "technology", 0.8), ("The Circuit Breaker", "unknown", 0.6), ("New York", "unknown", 0.6)],
    [("mt5", "technology", 1.0), ("LLM", "technology", 0.8)],
]
_MENTIONED_SQL = ", ".join(f"({i}, {k}, '{n}', '{t}', {c}::DOUBLE)" for i, rows in enumerate(MENTIONED) for k, (n, t, c) in enumerate(rows))


@query("query_entities", f"with {_phrases_sql(MENTIONING)}, found(i, place, name, entity_type, confidence) as (values {_MENTIONED_SQL}) select query_id, place, name, entity_type, confidence from asked join found using (i)", longs="place")
def query_entities(spark, d):
    found = _phrased(spark, d, MENTIONING).select("query_id", F.posexplode(N.query_mentions(F.col("q"))).alias("place", "e"))
    return found.select("query_id", "place", "e.name", "e.entity_type", "e.confidence")


DATES = ["what did we do today", "Yesterday we met", "plans of last week", "Last month was long", "today and yesterday", "no date"]


@query(
    "relative_dates",
    f"with {_phrases_sql(DATES)}" + """
    select query_id, replace(replace(replace(replace(replace(replace(replace(replace(q, 'today', 'February 01, 2024'), 'Today', 'February 01, 2024'), 'yesterday', 'January 31, 2024'), 'Yesterday', 'January 31, 2024'),
      'last week', 'between January 22, 2024 and January 28, 2024'), 'Last week', 'between January 22, 2024 and January 28, 2024'), 'last month', 'between January 01, 2024 and January 31, 2024'), 'Last month', 'between January 01, 2024 and January 31, 2024') as resolved from asked""",
)
def relative_dates(spark, d):
    return _phrased(spark, d, DATES).select("query_id", X.relative_dates(F.col("q"), A.now()).alias("resolved"))


@query(
    "judge_scores",
    "select doc_id, case doc_id % 4 when 0 then (n_chars % 100) / 100.0::DOUBLE when 3 then 0.0::DOUBLE end as score, doc_id % 3 + 1 as padded from documents", longs="padded",
)
def judge_scores(spark, d):
    """Replies of a judge about documents: a score between 0 and 1, one above, words, and 0."""
    cents = F.lpad((F.col("n_chars") % 100).cast("string"), 2, "0")
    reply = F.element_at(F.array(F.concat(F.lit('{"score": 0.'), cents, F.lit("}")), F.concat(F.lit('{"score": 2.'), cents, F.lit("}")), F.lit("junk"), F.lit('{"score": 0}')), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = A.table(spark, d, "documents").select("doc_id", reply.alias("r"), (F.col("doc_id") % 3 + 1).cast("int").alias("n"))
    scored = rows.withColumn("score", X.judged_score(F.col("r")))
    return scored.select("doc_id", "score", F.size(X.fit_scores(F.array("score"), F.col("n"))).alias("padded"))


@query("semantic_search")
def semantic_search(spark, d):
    from engram.plans import retrieve

    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), "text")
    rows = A.vectors(spark, d).join(docs, "memory_id", "left").withColumn("event_seq", F.col("memory_id"))
    out = retrieve.semantic(retrieve.Sources(rows), A.first_vector(spark, d), A.now())
    return out.select("memory_id", "composite_score", "answer_rank")


@query("routed_answers")
def routed_answers(spark, d):
    """One query of each mode, answered over all items."""
    from functools import reduce

    from engram.plans import retrieve

    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), "text")
    rows = A.vectors(spark, d).join(docs, "memory_id", "left").withColumn("event_seq", F.col("memory_id"))
    vector = A.first_vector(spark, d)
    asked = ["hello world", "what did we do today", "recent decisions about auth", "how do we deploy", "tell me about the most recent research"]
    parts = [retrieve.answer(retrieve.Sources(rows), q, vector, A.now(), 5).select(F.lit(q).alias("query"), "routing_mode", "memory_id", "answer_rank") for q in asked]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _items(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), "text")
    return A.vectors(spark, d).join(docs, "memory_id", "left").withColumn("event_seq", F.col("memory_id"))


@query(
    "search_many",
    f"""with {A.VECTORS_SQL}, items as (select v.*, coalesce(nullif(trim(text), ''), null) as known, text from vectors v left join documents on doc_id = v.memory_id),
    near as (select a.memory_id as query_id, b.memory_id, 'vector' as source, row_number() over (partition by a.memory_id order by {cos('a.embedding', 'b.embedding')} desc, b.memory_id) as rank from vectors a join vectors b on a.memory_id % 50 = 0 qualify rank <= 50),
    graph as (select q.memory_id as query_id, g.memory_id, 'graph' as source, g.rank from (select memory_id, row_number() over (order by memory_id) as rank from vectors qualify rank <= 50) g join vectors q on q.memory_id % 50 = 0),
    lists as (select l.*, i.category, i.event_time, md5(case when i.known is not null then i.text else (case source when 'vector' then 'Vector Result ID: ' else 'Graph Result ID: ' end) || l.memory_id end) as h from (select * from near union all select * from graph) l join items i using (memory_id)),
    f as (select query_id, h, sum(1.0::DOUBLE / (60 + rank)) as rrf, arg_min(memory_id, (case source when 'vector' then 0 else 1 end) * 1000 + rank) as memory_id, arg_min(category, (case source when 'vector' then 0 else 1 end) * 1000 + rank) as category, arg_min(event_time, (case source when 'vector' then 0 else 1 end) * 1000 + rank) as event_time from lists group by 1, 2),
    r as (select *, row_number() over (partition by query_id order by rrf desc, memory_id) as prev_rank from f qualify prev_rank <= 15),
    b as (select *, epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(event_time) as age, case category when 'debug' then 7 when 'context' then 14 when 'research' then 30 when 'decision' then 90 when 'pattern' then 180 else 30 end as life from r),
    c as (select *, least(greatest(rrf / 0.035, 0), 1) as s, case when age < 0 then 1 else greatest(0.01, exp(-ln(2) * (age / 86400e6) / life)) end as t from b),
    e as (select *, round(least(greatest(0.55 * s + 0.30 * t + 0.10 * 0.5 + 0.05 * 0.5, 0), 1), 6) as composite_score from c)
    select query_id, memory_id, composite_score, row_number() over (partition by query_id order by composite_score desc, prev_rank) as final_rank from e""",
)
def search_many(spark, d):
    """Every fiftieth item as a query against all items, in one plan."""
    from engram.plans import retrieve

    rows = _items(spark, d)
    queries = rows.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), F.lit("").alias("query"), "embedding")
    return retrieve.ranked_many(retrieve.Sources(rows), queries, A.now()).select("query_id", "memory_id", "composite_score", "final_rank")


@query("answers_many")
def answers_many(spark, d):
    """Every conversation turn as a query, answered by its mode over all items; its vector is that of the item its number names."""
    from engram.plans import retrieve

    rows = _items(spark, d)
    turns = A.turns(spark, d).select(F.col("memory_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), (F.col("memory_id") % 500).alias("vec"))
    # no number is beyond 499, so that only those items meet the turns
    named = A.vectors(spark, d).where("memory_id < 500").select(F.col("memory_id").alias("vec"), "embedding")
    queries = turns.join(named, "vec").drop("vec")
    return retrieve.answer_many(retrieve.Sources(rows), queries, A.now(), 5).select("query_id", "routing_mode", "memory_id", "answer_rank")
