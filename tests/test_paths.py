"""Paths of a table of pairs against a search from each start on its own."""

from collections import defaultdict

import numpy as np
import pytest

from engram.operators import graph as G


def least_path(ways, start, goal, depth):
    """The least of the shortest paths: layers from the goal, then the least next node from the start."""
    far, layer = {goal: 0}, [goal]
    for d in range(1, depth + 1):
        layer = [m for n in layer for m in ways[n] if m not in far and not far.update({m: d})]
    if start not in far:
        return None
    path = [start]
    while path[-1] != goal:
        path.append(min(m for m in ways[path[-1]] if far.get(m, -1) == far[path[-1]] - 1))
    return path


@pytest.mark.parametrize(("seed", "nodes", "n", "depth"), [(1, 60, 70, 7), (2, 40, 90, 4), (3, 120, 130, 10), (4, 30, 20, 1)])
def test_paths_match_a_search_from_each_start(spark, seed, nodes, n, depth):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, nodes, (n, 2))] + [(0, 0)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, nodes + 3, (200, 2))] + [(nodes + 9, nodes + 9), (1, 1)]
    ways = defaultdict(set)
    for a, b in edges:
        ways[a].add(b), ways[b].add(a)
    got = G.shortest_paths(spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame([*pairs, *pairs[:5], (None, 1), (1, None)], "start long, goal long"), depth).collect()
    want = {(a, b): p for a, b in pairs if (p := least_path(ways, a, b, depth)) is not None}
    assert {(r.start, r.goal): r.path for r in got} == want and len(got) == len(want)
    assert all(r.length == len(r.path) - 1 for r in got)
    assert depth == 1 or len(want) >= 50


def test_no_pairs_and_no_edges(spark):
    edges, none = spark.createDataFrame([], "source_id string, target_id string"), spark.createDataFrame([], "start string, goal string")
    assert G.shortest_paths(edges, none).count() == 0
    assert [r.path for r in G.shortest_paths(edges, spark.createDataFrame([("a", "a"), ("a", "b")], "start string, goal string")).collect()] == [["a"]]


def test_the_last_hop_keeps_only_what_meets_the_other_end(spark, monkeypatch):
    """Of 20 * 20 nodes three hops away from the start one is the goal: the others were written too."""
    edges = [(0, i) for i in range(1, 21)] + [(i, 100 * i + j) for i in range(1, 21) for j in range(20)] + [(507, 9000)]
    kept, settle = [], G.settle

    def counted(df):
        out = settle(df)
        kept.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(G, "settle", counted)
    got = G.shortest_paths(spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame([(0, 9000)], "start long, goal long"), 3).collect()
    assert [r.path for r in got] == [[0, 5, 507, 9000]]
    assert [n for columns, n in kept if "before" in columns] == [20, 1, 1]


def shuffled(spark):
    """Bytes of the shuffle files that are on this machine now."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))


def test_a_hop_leaves_no_shuffle_files(spark):
    """They stayed until the driver happened to collect garbage: the sum over all hops filled the disk."""
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b) + 3000) for a, b in rng.integers(0, 3000, (12000, 2))], "source_id long, target_id long")
    pairs = spark.createDataFrame([(i, i + 3000) for i in range(600)], "start long, goal long")
    before = shuffled(spark)
    out = G.shortest_paths(edges, pairs, 5)
    left = shuffled(spark) - before
    assert left <= 0 and out.count() > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_slices_and_short_lists_give_the_same_paths(spark, monkeypatch):
    """The last hop in slices of few frontier rows, and hubs whose neighbors fill many lists."""
    rng = np.random.default_rng(6)
    edges = [(0, i) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(1, 200, (150, 2))]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (80, 2))]
    frames = spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame(pairs, "start long, goal long")
    ways = defaultdict(set)
    for a, b in edges:
        ways[a].add(b), ways[b].add(a)
    want = {(a, b): p for a, b in pairs if (p := least_path(ways, a, b, 3)) is not None}
    last, settle = [], G.settle
    monkeypatch.setattr(G, "settle", lambda df: (last.append(df.columns), settle(df))[1])
    monkeypatch.setattr(G, "FRONTIER_ROWS", 40)
    monkeypatch.setattr(G, "LIST_NODES", 7)
    got = G.shortest_paths(*frames, 3).collect()
    assert {(r.start, r.goal): r.path for r in got} == want and len(want) >= 20
    assert last.count(["pair", "node", "before"]) > 4
