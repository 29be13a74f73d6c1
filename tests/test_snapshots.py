"""The snapshot store under races, crashes and compaction; pairs of shared entities kept up by writes."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import linkers as L
from engram.operators.snapshots import Change, Conflict, SnapshotStore
from engram.plans import writepath
from engram.schema import EDGES, MENTIONS

TABLES = {"a": ("id long, kind string, v string", ["id", "kind"]), "b": ("id long, n long", ["id"])}


def store(spark, path, **how):
    return SnapshotStore(spark, f"{path}/s", TABLES, **how)


def a_rows(spark, rows):
    return spark.createDataFrame(rows, TABLES["a"][0])


def b_rows(spark, rows):
    return spark.createDataFrame(rows, TABLES["b"][0])


def content(snapshot, name):
    return sorted((tuple(r) for r in snapshot.table(name).collect()), key=str)


def test_of_two_racing_writers_one_is_refused(spark, tmp_path, monkeypatch):
    """One writer is stopped between its draft and the rename; the other one commits meanwhile."""
    one, two = store(spark, tmp_path), store(spark, tmp_path)
    start = one.commit({"a": Change(a_rows(spark, [(0, "k", "base")]))}, one.snapshot())
    rename = one._rename_new
    seen = []

    def stopped(old, new):
        seen.append(content(two.snapshot(), "a"))  # a reader meanwhile: the draft is not there
        two.commit({"a": Change(a_rows(spark, [(20, "k", "two")]))}, two.snapshot())
        return rename(old, new)

    monkeypatch.setattr(one, "_rename_new", stopped)
    with pytest.raises(Conflict):
        one.commit({"a": Change(a_rows(spark, [(10, "k", "one")]))}, start)
    monkeypatch.undo()
    assert seen == [[(0, "k", "base")]] and content(two.snapshot(), "a") == [(0, "k", "base"), (20, "k", "two")]
    one.commit({"a": Change(a_rows(spark, [(10, "k", "one")]))}, one.snapshot())
    assert len(content(two.snapshot(), "a")) == 3 and two.versions() == [1, 2, 3]


def test_a_crash_between_tables_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    first = s.commit({"a": Change(a_rows(spark, [(1, "k", "x")])), "b": Change(b_rows(spark, [(1, 1)]))}, s.snapshot())
    put = s._put
    monkeypatch.setattr(s, "_put", lambda name, rows: put(name, rows) if name == "a" else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        s.commit({"a": Change(a_rows(spark, [(1, "k", "y")])), "b": Change(b_rows(spark, [(1, 2)]))}, first)
    monkeypatch.undo()
    again = store(spark, tmp_path)
    assert again.versions() == [1] and content(again.snapshot(), "a") == [(1, "k", "x")] and content(again.snapshot(), "b") == [(1, 1)]
    assert again.vacuum(older_than=3600) == 0 and again.vacuum(older_than=-5) == 1  # what the lost writer left
    assert content(again.snapshot(), "a") == [(1, "k", "x")]


def test_a_reader_keeps_the_tables_of_one_snapshot(spark, tmp_path):
    s = store(spark, tmp_path, fan=2, large=1)
    old = s.commit({"a": Change(a_rows(spark, [(1, "k", "old")])), "b": Change(b_rows(spark, [(1, 1)]))}, s.snapshot())
    s.commit({"a": Change(a_rows(spark, [(1, "k", "new")])), "b": Change(b_rows(spark, [(1, 2)]))}, old)
    s.compact()
    assert content(old, "a") == [(1, "k", "old")] and content(old, "b") == [(1, 1)]
    assert content(s.snapshot(), "a") == [(1, "k", "new")] and content(s.snapshot(), "b") == [(1, 2)]
    assert content(s.snapshot(1), "b") == [(1, 1)]
    assert content(store(spark, tmp_path / "none").snapshot(), "a") == []


@pytest.mark.parametrize("fan, ratio, large", [(2, 0.5, 1 << 40), (3, 1e9, 1 << 40), (100, 0.5, 1)])
def test_random_histories_match_a_dictionary(spark, tmp_path, fan, ratio, large):
    rng, s, want = random.Random(fan), store(spark, tmp_path, fan=fan, ratio=ratio, large=large), {}
    snapshot = s.snapshot()
    for step in range(9):
        up = {(rng.randint(0, 9), rng.choice([None, "k", "l"])): f"v{step}" for _ in range(rng.randint(0, 5))}
        gone = {(rng.randint(0, 9), rng.choice([None, "k", "l"])) for _ in range(rng.randint(0, 4))}
        change = Change(a_rows(spark, [(*k, v) for k, v in up.items()]) if up or step % 2 else None, a_rows(spark, [(*k, None) for k in gone]).select("id", "kind") if gone else None)
        snapshot = s.commit({"a": change}, snapshot)
        for k in gone:
            want.pop(k, None)
        want |= up
        if step % 2:
            snapshot = s.compact()
        assert content(snapshot, "a") == sorted(((*k, v) for k, v in want.items()), key=str)
    files = s.snapshot().files["a"]
    assert len(files.deltas) <= 9 and (ratio > 1 or files.base or fan == 100)


def test_a_small_write_does_not_grow_with_the_table(spark, tmp_path):
    """Bytes written for one row over a table of 10 and of 200,000 rows; the base is not shuffled when it is read."""
    written = []
    for n in (10, 200_000):
        s = store(spark, tmp_path / str(n), large=1)
        first = s.commit({"b": Change(spark.range(n).select("id", (F.col("id") * 7).alias("n")))}, s.snapshot())
        base = s.compact()
        last = s.commit({"b": Change(b_rows(spark, [(3, -1)]), b_rows(spark, [(5, 0)]).select("id"))}, base)
        assert last.files["b"].base == base.files["b"].base and first.version == 1
        written.append(sum(b for _, b in last.files["b"].deltas))
        assert last.table("b").count() == n - 1 and last.table("b").where("id = 3").first().n == -1
    assert written[1] <= 1.2 * written[0]
    plan = last.table("b")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# ---------------------------------------------------------------- pairs of shared entities


def mention_table(spark, pairs):
    at = "2024-01-01 00:00:00"
    rows = spark.createDataFrame([(m, p, n, 1.0, at, at, "entity_linker", "run", 1) for p, n, m in pairs], MENTIONS.replace("timestamp", "string"))
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "last_seen_at")})


def test_pairs_kept_up_equal_the_backfill(spark):
    """Random histories of new and of removed mentions, entities that become hubs and cease to be."""
    from engram.settings import Settings

    rng, settings = random.Random(7), Settings(hub_degree=4, per_entity_cap=2, min_shared=2)
    now = F.lit("2024-02-01").cast("timestamp")
    items = [f"m{i}" for i in range(12)]
    memories = spark.createDataFrame([(m,) for m in items], "memory_id string")
    have, edges = set(), spark.createDataFrame([], EDGES)
    for step in range(7):
        fresh = {("p" if int(m[1:]) % 3 else "q", f"e{rng.randint(0, 7)}", m) for m in rng.sample(items, 4) for _ in range(3)} - have
        gone = set(rng.sample(sorted(have), min(len(have), 5))) if step % 3 == 2 else set()
        before, have = have, (have | fresh) - gone
        old, new = (mention_table(spark, sorted(x)) for x in (before, have))
        change = writepath.pair_changes(edges, old, new, mention_table(spark, sorted(fresh | gone)), memories, now, f"run{step}", settings)
        t = writepath.Tables(memories, edges, new, *[memories] * 4)
        edges = spark.createDataFrame(writepath.applied(t, {"edges": change}).edges.collect(), EDGES)
        want = {(r.source_id, r.target_id, r.weight) for r in L.cooccurrence_edges(new, 4, 2, 2).collect()}
        assert {(r.source_id, r.target_id, r.weight) for r in edges.collect()} == want
    assert want
