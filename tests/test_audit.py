"""Audits of tables, chains that are cut, names that a query mentions, and these through the store."""

import pytest
from pyspark.sql import functions as F

from engram.api import MemoryStore
from engram.operators import graph as G
from engram.operators import ops as O
from engram.operators.objectives import Objective
from engram.settings import EDGE_TYPES
from engram.sources.readers import HashEmbedder


def NOW():
    return F.lit("2024-02-01T00:00:00Z").cast("timestamp")


def test_audit(spark):
    rows = [(1, "a", "x", {"p": "1", "q": None}), (1, "a", None, {"p": "2"}), (None, "b", "y", None), (2, None, "y", {})]
    t = spark.createDataFrame(rows, "id long, part string, kind string, more map<string,string>")
    got = {(r.section, r.item): r.n for r in O.audit({"t": t}, {"t": ["id", "part"]}, {"t": ("kind", ["y", "z"])}).collect()}
    assert got == {
        ("rows", ""): 4, ("missing_keys", "id,part"): 2, ("repeated_keys", "id,part"): 1,
        ("columns", "id"): 3, ("columns", "part"): 3, ("columns", "kind"): 3, ("columns", "more"): 3,
        ("properties", "more.p"): 2, ("properties", "more.q"): 1,
        ("kinds", "x"): 1, ("kinds", "y"): 2, ("kinds", "(null)"): 1, ("kinds", "z"): 0,
    }
    none = {(r.section, r.item): r.n for r in O.audit({"t": t.limit(0)}, {"t": ["id"]}, {"t": ("kind", ["y"])}).collect()}
    assert set(none.values()) == {0} and ("kinds", "y") in none and ("repeated_keys", "id") in none


@pytest.mark.parametrize("n,truncated", [(3, False), (4, False), (5, True)])
def test_capped(spark, n, truncated):
    # a line of n ancestors, the last is the source; and a short way to a second source
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "SUPERSEDES") for i in range(n - 1)] + [("n0", "s", "PROMOTED_FROM")], "source_id string, target_id string, edge_type string")
    chain, summary = G.provenance(edges, spark.createDataFrame([("n0",), ("alone",)], "start string"))
    cut, out = G.capped(chain, summary, 4)
    by = {r.start: r for r in out.collect()}
    assert by["n0"].truncated is truncated and by["alone"].truncated is False
    want = sorted((r.depth, r.node) for r in chain.collect())[:4]
    assert sorted((r.depth, r.node) for r in cut.collect()) == want
    assert set(by["n0"].original_sources) == {"s", f"n{n - 1}"} & {x for _, x in want}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = MemoryStore(spark, str(tmp_path_factory.mktemp("audited")), HashEmbedder(16))
    s.bulk_upsert([{"content": t, "id": f"m{i}", "metadata": {"project": "p", "session_id": "s", "memory_type": "note", "color": "red"}} for i, t in enumerate(["we use redis for queues", "plain words", "other words", "further words"])], NOW())
    s.backfill("temporal", "a", NOW())
    return s


def test_store_audit_and_objectives(store, spark):
    got = {(r.table_name, r.section, r.item): r.n for r in store.audit().collect()}
    assert got["memories", "rows", ""] == 4 and got["memories", "properties", "extra.color"] == 4 and got["memories", "kinds", "note"] == 4
    assert got["edges", "kinds", "MEMORY_FOLLOWS"] == 3 and all(("edges", "kinds", t) in got for t in EDGE_TYPES)
    assert all(n == 0 for (_, s, _), n in got.items() if s in ("missing_keys", "repeated_keys"))
    samples = spark.createDataFrame([("made_total", "", {"outcome": "error"}, 1.0)], "metric string, suffix string, labels map<string,string>, value double")
    asked = [Objective("errors", "made_total", "error_rate", 0.5), Objective("change", "edges", "daily_change", 10.0, "bounded")]
    assert [r["status"] for r in store.check_objectives(samples, asked, "2024-02-01")] == ["violation", "no_data"]
    assert spark.read.parquet(f"{store.path}/watch/data/daily/*").where("date is not null").first().total == 3


def test_query_looks_for_the_names_it_mentions(store, monkeypatch):
    from engram.plans import retrieve

    seen = []
    step = retrieve.semantic
    monkeypatch.setattr(retrieve, "semantic", lambda src, vector, now, names=None, *a: seen.append(names) or step(src, vector, now, names, *a))
    named = store.query("explain Redis", 4, now=NOW())
    assert seen == [["redis"]] and not named.isEmpty()
    store.query("explain nothing", 4, now=NOW())
    store.query("explain Redis", 4, now=NOW(), names=["docker"])
    assert seen[1:] == [[], ["docker"]]
