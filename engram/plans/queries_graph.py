"""Queries of traversals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engram.operators import edges as E
from engram.operators import graph as G
from engram.operators import vectors as V
from engram.plans import adapters as A
from engram.plans.base import query
from engram.plans.queries_search import cos


@query("neighbors", f"with {A.EDGES_SQL}, b as (select target_id as node, source_id as other, 'in' as direction, edge_type, weight, created_at from edges where target_id = 'p11' and weight >= 0.2 union all select source_id, target_id, 'out', edge_type, weight, created_at from edges where source_id = 'p11' and weight >= 0.2) select other, direction, edge_type, round(weight, 6) as weight from b order by b.weight desc, created_at desc nulls first, other, edge_type limit 20")
def neighbors(spark, d):
    return E.neighbors(A.edges(spark, d), "p11", min_weight=0.2).select("other", "direction", "edge_type", F.round("weight", 6).alias("weight"))


@query(
    "multihop_entities",
    f"""with recursive {A.PLACES_SQL}, h(node, dist) as (select 'r0', 0 union select other, dist + 1 from h join ways using (node) where dist < 3), m as (select node, min(dist) as distance from h group by 1)
    select node, distance, round(1.0::DOUBLE / (1 + distance), 6) as graph_score from m where distance > 0 order by 1.0::DOUBLE / (1 + distance) desc, node desc limit 20""", longs="distance")
def multihop_entities(spark, d):
    starts = spark.range(1).select(F.lit("r0").alias("node"))
    return G.multihop(A.places(spark, d), starts, 3).select("node", "distance", F.round("graph_score", 6).alias("graph_score"))


@query(
    "graph_expansion",
    f"""with {A.VECTORS_SQL}, p as (select a.memory_id as s, b.memory_id as t, {cos('a.embedding', 'b.embedding')} as score from vectors a join vectors b on a.project = b.project and a.memory_id <> b.memory_id),
    r as (select *, row_number() over (partition by s order by score desc, t) as n from p where score >= 0.25),
    e as (select least(s, t) as a, greatest(s, t) as b, max(score) as w from r where n <= 10 group by 1, 2), w2 as (select a as node, b as other, w from e union all select b, a, w from e),
    nb as (select * from (select *, row_number() over (partition by node order by w desc, other) as n from w2) where n <= 5),
    q as (select embedding as q from vectors where memory_id = 0), seeds as (select memory_id as node, {cos('embedding', 'q')} as score from vectors, q order by 2 desc, 1 limit 20),
    h1 as (select other as node, max(score * w * 0.5) as score from seeds join nb using (node) where other not in (select node from seeds) group by 1),
    h2 as (select other as node, max(score * w * 0.5) as score from h1 join nb using (node) where other not in (select node from seeds) and other not in (select node from h1) group by 1),
    u as (select *, 1 as hop from h1 union all select *, 2 from h2) select node, round(score, 6) as expansion_score, hop from u order by score desc, node limit 20""", longs="hop")
def graph_expansion(spark, d):
    from dataclasses import replace

    from engram.settings import DEFAULTS

    rows = A.vectors(spark, d)
    edges = V.similarity_edges(rows, threshold=0.25).withColumn("edge_type", F.lit("SIMILAR_TO")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    seeds = V.top_k(rows, A.first_vector(spark, d), 20).select(F.col("memory_id").alias("node"), "score")
    out = G.expand(edges, seeds, settings=replace(DEFAULTS, min_edge_weight=0.25))
    return out.select("node", F.round("expansion_score", 6).alias("expansion_score"), "hop")


@query(
    "related_bfs",
    f"""with {A.PLACES_SQL}, nb as (select * from (select node, other, edge_type, weight, row_number() over (partition by node order by weight desc, other, edge_type) as n from ways) where n <= 50),
    h1 as (select other as node, edge_type, weight, n as place from nb where node = 'n3'), f1 as (select * from h1 where place <= 20),
    c2 as (select nb.other as node, nb.edge_type, nb.weight, f1.place as pp, nb.n, row_number() over (partition by nb.other order by f1.place, nb.n) as k from f1 join nb on nb.node = f1.node where nb.other <> 'n3' and nb.other not in (select node from h1)),
    u as (select node, edge_type, weight, 1 as hop from h1 union all select node, edge_type, weight, 2 from c2 where k = 1) select node, edge_type, round(weight, 6) as weight, hop from u order by u.weight desc, hop, node limit 20""", longs="hop")
def related_bfs(spark, d):
    return G.related(A.places(spark, d), "n3").select("node", "edge_type", F.round("weight", 6).alias("weight"), "hop")


@query(
    "ego_subgraph",
    f"""with recursive {A.PLACES_SQL}, h(node, dist) as (select 'n3', 0 union select other, dist + 1 from h join ways using (node) where dist < 2), m as (select node, min(dist) as distance from h group by 1 order by min(dist), node limit 200)
    select source_id, target_id, edge_type from places where source_id in (select node from m) and target_id in (select node from m) order by weight desc, source_id, target_id, edge_type limit 400""",
)
def ego_subgraph(spark, d):
    return G.ego(A.places(spark, d), "n3")[1].select("source_id", "target_id", "edge_type")


@query(
    "shortest_path_len",
    f"""with recursive {A.PLACES_SQL}, h(node, dist) as (select 's1', 0 union select other, dist + 1 from h join ways using (node) where dist < 6)
    select 'n' || nation.n_nationkey as goal, min(dist) as length from h, nation where node = 'n' || nation.n_nationkey and n_nationkey < 5 group by 1""", longs="length")
def shortest_path_len(spark, d):
    asked = A.table(spark, d, "nation").where("n_nationkey < 5").select(F.lit("s1").alias("start"), F.concat(F.lit("n"), "n_nationkey").alias("goal"))
    return G.shortest_paths(A.places(spark, d), asked, 6).select("goal", "length")


@query(
    "shortest_paths",
    f"""with recursive {A.EDGES_SQL}, ways as (select source_id as node, target_id as other from edges union select target_id, source_id from edges),
    q as (select 'o' || o_orderkey as start, 'p' || o_custkey as goal from orders where o_orderkey % 50 = 0),
    h(start, node, dist) as (select start, start, 0 from q union select start, other, dist + 1 from h join ways using (node) where dist < 5)
    select start, goal, min(dist) as length from q join h using (start) where node = goal group by 1, 2""", longs="length")
def shortest_paths(spark, d):
    """Every fiftieth order to the part that has its customer's number, over all order and part edges. Orders go by even numbers, parts by odd ones: shorter than names."""
    order, part = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    edges = A.table(spark, d, "lineitem").select(order("l_orderkey").alias("source_id"), part("l_partkey").alias("target_id"))
    asked = A.table(spark, d, "orders").where("o_orderkey % 50 = 0").select(order("o_orderkey").alias("start"), part("o_custkey").alias("goal"))
    named = lambda letter, c: F.concat(F.lit(letter), F.shiftright(c, 1)).alias(c)
    return G.shortest_paths(edges, asked, 5).select(named("o", "start"), named("p", "goal"), "length")


# customers of a nation as versions: each comes from the next one, every fifth also from the one before and from the third one after, so there are cycles
VERSIONS_SQL = """v as (select c_custkey as s, c_nationkey as g, row_number() over (partition by c_nationkey order by c_custkey) as i from customer),
e as (select v.s, w.s as t, case when w.i > v.i then case when w.i = v.i + 1 then 'SUPERSEDES' else 'COMPACTED_FROM' end else 'PROMOTED_FROM' end as k from v join v w on w.g = v.g and (w.i = v.i + 1 or (v.s % 5 = 0 and w.i in (v.i - 1, v.i + 3)))),
w(start, node, k, depth, path) as (select s, t, k, 1, [s, t] from e where s % 50 = 0 union all select start, t, e.k, depth + 1, list_append(path, t) from w join e on s = node where depth < 6 and not list_contains(path, t))"""


def versions(spark, d):
    """Provenance edges among customers, and those with a key divisible by 50 as starts."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    v = A.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("g"), place.alias("i"))
    steps = F.when(F.col("source_id") % 5 == 0, F.array(F.lit(1), F.lit(-1), F.lit(3))).otherwise(F.array(F.lit(1)))
    kind = F.when(F.col("step") == 1, "SUPERSEDES").when(F.col("step") == 3, "COMPACTED_FROM").otherwise("PROMOTED_FROM")
    asked = v.select("source_id", "g", "i", F.explode(steps).alias("step")).withColumn("edge_type", kind).withColumn("i", F.col("i") + F.col("step"))
    edges = asked.join(v.select(F.col("source_id").alias("target_id"), "g", "i"), ["g", "i"]).select("source_id", "target_id", "edge_type")
    return edges, v.where("source_id % 50 = 0").select(F.col("source_id").alias("start"))


@query("provenance_closure", f"with recursive {VERSIONS_SQL} select start, node, min(depth) as depth, min(k) filter (depth = least) as edge_type from (select *, min(depth) over (partition by start, node) as least from w) group by 1, 2", longs="depth")
def provenance_closure(spark, d):
    return G.provenance(*versions(spark, d), 6)[0].select("start", "node", "depth", "edge_type")


@query(
    "provenance_sources",
    f"""with recursive {VERSIONS_SQL}, gone as (select distinct start, path[len(path) - 1] as node from w), a as (select distinct start, node from w),
    sources as (select start, string_agg(node::varchar, ',' order by node) as sources from a anti join gone using (start, node) group by 1)
    select s as start, sources, coalesce(max(depth), 0) as depth, coalesce(max(depth), 0) >= 6 as depth_limited from v left join w on w.start = s left join sources on sources.start = s where s % 50 = 0 group by 1, 2""", longs="depth")
def provenance_sources(spark, d):
    return G.provenance(*versions(spark, d), 6)[1].select("start", F.array_join("original_sources", ",").alias("sources"), "depth", "depth_limited")


@query(
    "provenance_capped",
    f"""with recursive {VERSIONS_SQL}, gone as (select distinct start, path[len(path) - 1] as node from w), a as (select start, node, min(depth) as depth from w group by 1, 2),
    r as (select *, row_number() over (partition by start order by depth, node) as place, count(*) over (partition by start) as n, (start, node) in (select (start, node) from gone) as left_again from a)
    select s as start, coalesce(string_agg(node::VARCHAR, ',' order by place) filter (place <= 5), '') as chain, string_agg(node::VARCHAR, ',' order by node) filter (not left_again and (place <= 5 or n <= 5)) as sources, coalesce(max(n), 0) > 5 as truncated
    from v left join r on r.start = s where s % 50 = 0 group by 1""",
)
def provenance_capped(spark, d):
    """The first five ancestors of each start and the sources that are among them."""
    edges, starts = versions(spark, d)
    chain, summary = G.capped(*G.provenance(edges, starts, 6), 5)
    first = chain.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("c"))
    out = summary.join(first, "start", "left").withColumn("chain", F.coalesce(F.array_join(F.transform("c", lambda e: e["node"].cast("string")), ","), F.lit("")))
    return out.select("start", "chain", F.when(F.size("original_sources") > 0, F.array_join("original_sources", ",")).alias("sources"), "truncated")


@query("session_chain", "with recursive f as (select * from (select distinct conv_id as s, lag(conv_id) over (order by conv_id) as p from (select distinct conv_id from conversations)) where p is not null), c(start, session_id, distance) as (select conv_id, conv_id, 0 from (select distinct conv_id from conversations) union all select start, p, distance + 1 from c join f on s = session_id where distance < 5) select * from c", longs="distance")
def session_chain(spark, d):
    from engram.operators import timeline as T

    sessions = A.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("conv_id").alias("last_event_seq")).withColumn("project", F.lit("p")).withColumn("thread_id", F.lit("t"))
    return G.session_chain(T.follows(sessions), sessions.select(F.col("session_id").alias("start")), 5)


@query("node_exists", "select id, id in (select vec_id from embeddings) as found from (values (1), (2), (100000000)) t(id)", longs="id")
def node_exists(spark, d):
    return G.existing(A.vectors(spark, d), spark.createDataFrame([(1,), (2,), (100_000_000,)], "id long"))
