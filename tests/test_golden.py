"""Fixed cases of scalar functions, routing, entities, traversals and selection."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import entities as N
from engram.functions import router as R
from engram.functions import scalars as X
from engram.operators import edges as E
from engram.operators import evaluation as EV
from engram.operators import graph as G
from engram.operators import linkers as L
from engram.operators import ops as O
from engram.operators import retrieval as Q
from engram.operators import vectors as V
from engram.settings import EDGE_TYPES

ROUTES = [
    ("", "HYBRID"), ("   ", "HYBRID"), (None, "HYBRID"), ("recent decisions about auth", "DECISION"), ("what is the latest best practice for deployment", "PATTERN"),
    ("what happened in yesterday's session", "SESSION"), ("tell me about the most recent research on databases", "TEMPORAL_SEMANTIC"), ("compare vector databases and graph databases", "GRAPH"),
    ("who is the lead engineer", "VECTOR"), ("hello world", "HYBRID"), ("related services", "HYBRID"),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_routes(spark):
    rows = spark.createDataFrame(ROUTES, "q string, want string").select("q", "want", R.route(F.col("q")).alias("got")).collect()
    assert [(r.q, r.got) for r in rows] == ROUTES


@pytest.mark.parametrize("time,category,want", [
    (None, "debug", 0.5), ("junk", "debug", 0.5), ("", "debug", 0.5), ("2014-01-01T00:00:00Z", "debug", 0.01), ("2024-01-01T00:00:00+00:00", "default", 0.5),
    ("2030-01-01T00:00:00Z", "debug", 1.0), ("2023-11-02T00:00:00", "pattern", 0.7071), ("2024-01-01T00:00:00Z", None, 0.5), ("2024-01-01T00:00:00Z", "unheard", 0.5),
])
def test_decay(spark, time, category, want):
    now = F.lit("2024-01-31T00:00:00Z").cast("timestamp")
    got = one(spark, X.temporal_decay(X.parse_time(F.lit(time).cast("string")), F.lit(category).cast("string"), now))
    assert got == pytest.approx(want, abs=1e-4)


def test_half_life_override():
    assert X.merge_half_lives({"debug": 3, "own": 60})["decision"] == 90 and X.merge_half_lives({"debug": 3})["debug"] == 3
    assert X.merge_half_lives({"debug": "x"}) == X.merge_half_lives(None) == X.merge_half_lives([1])


def test_scores(spark):
    assert one(spark, X.composite_score(F.lit(1.0), F.lit(0.0))) == pytest.approx(0.625)
    assert one(spark, X.semantic_score(F.lit(0.0), "rerank")) == 0.5
    assert one(spark, X.semantic_score(F.lit(-800.0), "rerank")) == 0.0
    assert one(spark, X.vector_score(F.lit(0.9))) == pytest.approx(0.95)
    assert one(spark, X.graph_score(F.lit(3.0), F.lit(1.0), F.lit(1.0))) == 0.5
    assert one(spark, X.raw_semantic(F.lit(0.0), F.lit(0.02))) == 0.02
    assert one(spark, X.raw_semantic(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.5
    assert one(spark, X.best_score(F.lit("x"), F.lit("0.0"), F.lit("2"))) == 0.0


def test_rrf_of_a_row_that_leads_both_lists(spark):
    rows = [(1, "vector", 1, "a", "same"), (1, "graph", 1, "b", "same"), (1, "graph", 2, "c", " "), (1, "vector", 2, "d", None)]
    out = {r.memory_id: r for r in Q.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id long, source string, rank int, memory_id string, text string")).collect()}
    assert out["a"].rrf_score == pytest.approx(2 / 61) and (out["a"].initial_rank_vector, out["a"].initial_rank_graph) == (1, 1)
    assert out["c"].text == "Graph Result ID: c" and out["d"].text == "Vector Result ID: d"


@pytest.mark.parametrize("raw,want", [("Neo4j", "neo4j"), ("  Foo   Bar  ", "foo bar"), ("./agents/memory_router.py", "agents/memory_router.py"), ("agents\\memory_router.py", "agents/memory_router.py"), ("AB", "alpha-beta"), ("  ", None), ("a/b/", "a/b"), ("/", "/"), ("./", "")])
def test_canonical_names(spark, raw, want):
    aliases = {"ab": "alpha-beta"}
    assert one(spark, N.canon(F.lit(raw), aliases)) == (want or None) == N.canon_text(raw, aliases)


def test_identifiers():
    text = "see docs/guides/README.md and watcher.py, MemoryEdge or `free text`; README.md again, MemoryEdge, Claude"
    assert N.identifiers(text) == ["docs/guides/README.md", "watcher.py", "MemoryEdge", "free text", "README.md", "README"]
    assert N.identifiers("") == [] and N.identifiers("agents/memory_router.py") == ["agents/memory_router.py"]
    assert len(N.identifiers(" ".join(f"f{i}.py" for i in range(50)))) == 20


def test_query_mentions(spark):
    got = one(spark, N.query_mentions(F.lit("Ask Neo4j Team and New York about the API, API and redis")))
    assert [(e.name, e.confidence) for e in got] == [("neo4j", 1.0), ("redis", 1.0), ("API", 0.8), ("New York", 0.6)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 25), st.integers(1, 6), st.floats(0, 1), st.integers(0, 10**6))
def test_diverse_selection_against_the_definition(n, top, lam, seed):
    rng = np.random.default_rng(seed)
    rel, v = rng.random(n), rng.standard_normal((n, 8))
    got = V.select_diverse(rel, v, lam, top)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    norm = (rel - rel.min()) / (rel.max() - rel.min()) if np.ptp(rel) > 1e-10 else np.ones(n)
    chosen = [int(np.argmax(norm))]
    while len(chosen) < min(top, n):
        rest = [i for i in range(n) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (round(lam * norm[i] - (1 - lam) * max(unit[i] @ unit[j] for j in chosen), 12), -i)))
    assert got == chosen


def test_diverse_selection_by_relevance_alone():
    assert V.select_diverse(np.array([0.1, 0.9, 0.5]), np.eye(3), 1.0, 3) == [1, 2, 0]


PROV = [("A", "B", "SUPERSEDES"), ("A", "C", "PROMOTED_FROM"), ("C", "D", "COMPACTED_FROM"), ("P", "Q", "SUPERSEDES"), ("Q", "P", "SUPERSEDES")]


def test_provenance(spark):
    edges = spark.createDataFrame(PROV, "source_id string, target_id string, edge_type string")
    chain, summary = G.provenance(edges, spark.createDataFrame([("A",), ("P",), ("Z",)], "start string"))
    assert {(r.start, r.node, r.depth) for r in chain.collect()} == {("A", "B", 1), ("A", "C", 1), ("A", "D", 2), ("P", "Q", 1)}
    got = {r.start: (r.original_sources, r.depth, r.depth_limited) for r in summary.collect()}
    assert got == {"A": (["B", "D"], 2, False), "P": (["Q"], 1, False), "Z": (None, 0, False)}
    _, cut = G.provenance(edges, spark.createDataFrame([("A",)], "start string"), 1)
    assert cut.first().depth_limited and cut.first().original_sources == ["B", "C"]


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, "X"), ("b", "c", 1.0, "X"), ("d", "c", 1.0, "X"), ("a", "d", 1.0, "X"), ("y", "z", 1.0, "X")], "source_id string, target_id string, weight double, edge_type string")
    assert G.shortest_path(edges, "a", "c").first().path == ["a", "b", "c"]
    assert G.shortest_path(edges, "a", "z").isEmpty() and G.shortest_path(edges, "a", "a").first().length == 0


def test_cooccurrence_weight(spark):
    rows = [(f"m{i}", "p", "python") for i in range(8)] + [(m, "p", e) for m, e in [("A", "python"), ("B", "python"), ("A", "graph"), ("B", "graph"), ("A", "cache"), ("B", "cache"), ("C", "cache")]]
    got = L.cooccurrence_edges(spark.createDataFrame(rows, "memory_id string, project string, name string")).collect()
    assert [(r.source_id, r.target_id, r.shared, r.weight) for r in got] == [("A", "B", 3, 0.2813)]


BAD = [("SIMILAR_TO", "a", "b", 0.5, "x", "r", None), ("NOPE", "a", "b", 0.5, "x", "r", "edge_type"), ("SIMILAR_TO", "a", "b", -0.1, "x", "r", "weight"), ("SIMILAR_TO", "a", "b", 1.1, "x", "r", "weight"), ("SIMILAR_TO", "", "b", 0.5, "x", "r", "endpoint"), ("SIMILAR_TO", "a", "a", 0.5, "x", "r", "self_loop"), ("SIMILAR_TO", "a", "b", 0.5, " ", "r", "created_by"), ("SIMILAR_TO", "a", "b", 0.5, "x", "", "run_id"), ("SIMILAR_TO", "a", "b", float("nan"), "x", "r", "weight")]


def test_edge_problems(spark):
    df = spark.createDataFrame(BAD, "edge_type string, source_id string, target_id string, weight double, created_by string, run_id string, want string")
    assert [r.want for r in df.collect()] == [r.got for r in df.select(E.problem(df).alias("got")).collect()]
    assert "RELATED_TASK" in EDGE_TYPES


def test_merge_twice_changes_nothing(spark):
    t = "timestamp '2024-01-0{}'"
    row = lambda s, d, k, w, day: f"select '{s}' source_id, '{d}' target_id, '{k}' edge_type, cast({w} as double) weight, {t.format(day)} created_at, {t.format(day)} last_seen_at, 'me' created_by, 'run{day}' run_id, 1 edge_version, cast(null as string) metadata"
    old = spark.sql(row("a", "b", "SIMILAR_TO", 0.9, 1))
    new = spark.sql(row("b", "a", "SIMILAR_TO", 0.4, 2) + " union all " + row("b", "a", "SUPERSEDES", 1, 2))
    once = E.merge(old, new)
    got = {(r.source_id, r.edge_type): (r.weight, r.run_id, str(r.last_seen_at)[:10]) for r in once.collect()}
    assert got == {("a", "SIMILAR_TO"): (0.9, "run1", "2024-01-02"), ("b", "SUPERSEDES"): (1.0, "run2", "2024-01-02")}
    assert sorted(map(tuple, E.merge(once, new).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    for bad in ("", " ", "*", "ALL", None):
        with pytest.raises(ValueError):
            E.rollback(once, bad)


def test_quality_and_gate(spark):
    rows = [("q1", 1, 0.2), ("q1", 2, 0.5), ("q1", 11, 0.9), ("q2", 1, 0.1)]
    df = spark.createDataFrame(rows, "query_id string, rank int, score double")
    assert {r.query_id: (r.recall_at_k, r.mrr) for r in EV.quality(df, 10).collect()} == {"q1": (0.1, 0.5), "q2": (0.0, 0.0)}
    assert {r.recall_at_k for r in EV.quality(df, 0).collect()} == {0.0}
    frame = lambda *x: spark.createDataFrame(list(x), "query_id string, recall_at_k double, mrr double")
    compared = EV.compare(frame(("a", 0.1, 0.5), ("b", 0.1, 0.5)), frame(("a", 0.15, 0.5), ("c", 1.0, 1.0)))
    assert {r.query_id: r.side for r in compared.collect()} == {"a": "common", "b": "before_only", "c": "after_only"}
    assert EV.gate(compared, 0.0499).first().passed and not EV.gate(compared, 0.06).first().passed


def test_histogram_quantile(spark):
    rows = [("a", 0.0005, 0.0), ("a", 0.001, 0.0), ("a", 0.002, 10.0), ("a", 0.005, 30.0), ("a", 0.01, 100.0), ("a", float("inf"), 100.0), ("b", 1.0, 0.0), ("b", float("inf"), 10.0), ("c", 1.0, 0.0)]
    got = {r.metric: r.quantile for r in O.histogram_quantile(spark.createDataFrame(rows, "metric string, le double, value double")).collect()}
    assert got["a"] == pytest.approx(0.005 + 65 / 70 * 0.005) and got["b"] == 1.0 and got["c"] is None


def test_bulk_states(spark):
    df = lambda *t: O.bulk_summary(O.validate_items(spark.createDataFrame(list(enumerate(t)), "item_index long, content string"))).first()
    assert [df("a", "b").status, df("a", " ").status, df(None, "").status] == ["success", "partial_success", "error"]


def test_run_tags():
    assert L.run_tag(" r1 ") == "backfill-r1"
    for bad in ("", "a*", "100%", "ALL", "wt-x"):
        with pytest.raises(ValueError):
            L.run_tag(bad)


def test_filters(spark):
    df = spark.createDataFrame([(1, " Work ", "r", ["a", "b"], 0.5), (2, "work", "r", ["a"], None), (3, "x", "r", None, 0.9)], "id long, category string, run_id string, tags array<string>, best_score double")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(Q.result_filter(df, category="WORK")) == [1, 2] and ids(Q.result_filter(df, tags=["a", "b"])) == [1] and ids(Q.result_filter(df, min_score=0.1)) == [1, 3]
    assert ids(df.where(Q.compile_filter({"id": {"$gte": 2}, "category": "x"}))) == [3]
    with pytest.raises(ValueError):
        Q.compile_filter({"id": {"$near": 2}})
