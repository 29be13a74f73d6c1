"""The store end to end: writes, linkers, searches, traversals, roll-back."""

import pytest
from pyspark.sql import functions as F

from engram.api import MemoryStore
from engram.sources.readers import HashEmbedder

def NOW():
    return F.lit("2024-02-01T00:00:00Z").cast("timestamp")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = MemoryStore(spark, str(tmp_path_factory.mktemp("store")), HashEmbedder(32))
    meta = lambda i, **x: {"project": "p", "session_id": f"s{i % 2}", "memory_type": "note", "event_time": f"2024-01-0{i + 1}T00:00:00Z", **x}
    items = [{"content": f"item {i} about cats and storage layer number {i}", "id": f"m{i}", "metadata": meta(i, tags="x", own="kept", _hidden=1)} for i in range(5)]
    out = s.bulk_upsert([*items, {"content": "  "}, {"content": None}], NOW())
    assert (out["total"], out["succeeded"], out["failed"], out["status"]) == (7, 5, 2, "partial_success") and set(out["errors"]) == {5, 6}
    return s


def test_bulk_rows(store):
    rows = {r.memory_id: r for r in store.table("memories").collect()}
    assert rows["m0"].tags == ["x"] and rows["m0"].extra == {"own": "kept"} and sorted(r.event_seq for r in rows.values()) == [1, 2, 3, 4, 5]
    assert store.table("timeline").count() == 10 and store.table("edges").count() == 0


def test_upsert_links_and_search(store):
    new = store.upsert("item 9 about cats and storage layer number 9", "m9", {"project": "p", "session_id": "s0", "entities": ["Cats", " "], "category": "research"}, NOW())
    assert new == "m9" and store.health()["memories"] == 6
    kinds = {r.edge_type for r in store.table("edges").collect()}
    assert "MEMORY_FOLLOWS" in kinds
    assert [r.memory_id for r in store.entity_memories("cats", "p").collect()] == ["m9"]
    found = store.query("storage layer with cats", now=NOW()).collect()
    assert {r.memory_id for r in found} == {"m0", "m1", "m2", "m3", "m4", "m9"} and {r.routing_mode for r in found} == {"HYBRID"}
    assert [r.memory_id for r in store.query("what happened today", 2, now=NOW()).orderBy("answer_rank").collect()] == ["m9", "m4"]
    assert store.query("storage layer", now=NOW(), category="nothing").count() == 0
    assert store.query("storage cats", expand_graph=True, now=NOW()).count() >= 6


def test_duplicates_are_skipped(store):
    before = store.health()["memories"]
    store.upsert("item 1 about cats and storage layer number 1", "copy", {"project": "p"}, NOW())
    assert store.health()["memories"] == before
    with pytest.raises(ValueError):
        store.upsert("  ")


def test_sessions_and_checkpoints(store):
    assert [r.memory_id for r in store.session_timeline("s0").collect()][:3] == ["m0", "m2", "m4"]
    mark = store.create_checkpoint("s0", "so far so good", "p")
    assert store.last_checkpoint("p").first().memory_id == mark


def test_sessions_follow_each_other(store):
    store.create_checkpoint("s1", "begun", "p")
    store.create_checkpoint("s2", "went on", "p")
    assert [(r.session_id, r.distance) for r in store.session_chain("s2").orderBy("distance").collect()][:2] == [("s2", 0), ("s1", 1)]


def test_rollback_takes_mentions(store):
    store.upsert("quite another matter of ships", "ships", {"project": "q", "entities": ["Harbour"]}, NOW(), run_id="run-7")
    assert store.entity_memories("harbour", "q").count() == 1
    assert store.rollback("run-7", dry_run=True)["MENTIONS"] == 1 and store.entity_memories("harbour", "q").count() == 1
    assert store.rollback("run-7")["MENTIONS"] == 1 and store.entity_memories("harbour", "q").count() == 0
    assert store.rollback("run-7") == {}
    found = store.backfill("entities", "again", NOW())
    assert found["found"] >= 1 and found["by_project"]["q"] == 1 and store.entity_memories("harbour", "q").count() == 1
    assert store.backfill("entities", "again", NOW())["found"] == 0
    with pytest.raises(ValueError):
        store.rollback("*")


def test_promotions_and_compactions_from_marks(store):
    store.upsert("a summary of both items", "sum", {"project": "p", "compacted_from": ["m0", "m1"], "promoted_from_id": "m2"}, NOW())
    assert store.backfill("compaction", "c1", NOW())["found"] == 2 and store.backfill("promotion", "c1", NOW())["found"] == 1
    assert store.provenance("sum")[1].first().original_sources == ["m0", "m1", "m2"]


def test_decisions(store):
    store.upsert("We keep all tables in versioned folders", "d1", {"project": "p", "memory_type": "decision"}, NOW())
    assert [r.memory_id for r in store.decisions("  keep ALL tables ").collect()] == ["d1"]


def test_a_failed_commit_changes_nothing(store, monkeypatch):
    before = store.health()
    monkeypatch.setattr(store._store, "_rename_new", lambda old, new: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert("a text that never arrives", "lost", {"project": "p", "entities": ["x"]}, NOW())
    monkeypatch.undo()
    assert store.health() == before and store.table("memories").where("memory_id = 'lost'").isEmpty()
    store.upsert("a text that arrives", "found", {"project": "p"}, NOW())
    assert store.health()["memories"] == before["memories"] + 1


def test_backfill_and_rollback(store):
    assert store.backfill("temporal", "one", NOW(), dry_run=True)["found"] >= 3
    assert store.backfill("temporal", "one", NOW())["run_id"] == "backfill-one"
    n = store.table("edges").count()
    assert store.backfill("temporal", "two", NOW())["found"] >= 3 and store.table("edges").count() == n
    removed = store.rollback("backfill-one")
    assert store.table("edges").count() == n - sum(removed.values())
    assert store.related("m9").count() >= 0 and store.provenance("m9")[1].first().depth == 0
    assert {r.edge_type: r.n for r in store.edge_stats().collect()}["RELATED_TASK"] == 0


def test_delete(store):
    assert store.delete("m3") and not store.delete("m3")
    assert store.table("memories").where("memory_id = 'm3'").isEmpty() and store.table("timeline").where("memory_id = 'm3'").isEmpty()
