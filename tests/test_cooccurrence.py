"""Pairs of items that share entities: against pairs made one by one, in batches of a few rows; what is shuffled is a list a mention."""

import itertools
import math
import random

from engram.operators import linkers as L


def naive(mentions, hub, cap, least):
    members = {}
    for item, name in set(mentions):
        members.setdefault(name, []).append(item)
    members = {n: sorted(m) for n, m in members.items() if len(m) <= hub}
    top = {}
    for m in members.values():
        for i in m:
            top[i] = max(top.get(i, 0), len(m))
    sides = {}
    for m in members.values():
        for i in m:
            for o in [x for x in m if x != i][:cap]:
                n, w = sides.get((i, o), (0, 0.0))
                sides[i, o] = n + 1, w + math.log(max(top[i] / len(m), 1)) / 10
    out = {}
    for i, o in sorted(p for p, (n, _) in sides.items() if n >= least):
        n, w = sides[i, o]
        out.setdefault((min(i, o), max(i, o)), (n, round(min(1, max(0.01, w)), 4)))
    return out


def test_pairs_equal_those_made_one_by_one(spark):
    rnd = random.Random(3)
    mentions = [(rnd.randrange(60), f"e{int(40 * rnd.random() ** 2)}") for _ in range(500)]
    df = spark.createDataFrame([(i, "p", n) for i, n in mentions], "memory_id long, project string, name string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, (hub, cap, least) in itertools.product((3, 10_000), ((50, 30, 2), (20, 4, 2), (20, 3, 1))):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            got = {(r.source_id, r.target_id): (r.shared, r.weight) for r in L.cooccurrence_edges(df, hub, cap, least).collect()}
            want = naive(mentions, hub, cap, least)
            assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1.1e-4 for k in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    # no row is made for a pair before its item's task
    plan = L.cooccurrence_edges(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "[memory_id, other_id" not in plan and "Generate" not in plan
