"""Versioned tables, readers, and streams that agree with batch."""

import pytest
from pyspark.sql import functions as F

from engram.operators import edges as E
from engram.operators import store as S
from engram.operators import timeline as T
from engram.operators.linkers import edge_rows
from engram.sources import readers as RD
from engram.streaming import streams as ST


def test_versions(spark, tmp_path):
    table = S.Versioned(spark, f"{tmp_path}/t")
    assert table.read() is None and table.write(spark.range(3)) == 1 and table.write(table.read().union(spark.range(10, 12))) == 2
    assert table.read().count() == 5 and table.versions() == [1, 2]


def test_a_table_changed_by_another_is_refused(spark, tmp_path):
    one, two = (S.Versioned(spark, f"{tmp_path}/t") for _ in range(2))
    one.write(spark.range(1))
    one.read(), two.read()
    assert two.write(spark.range(2)) == 2
    with pytest.raises(OSError):
        one.write(spark.range(3))
    assert one.read().count() == 2 and one.write(spark.range(3)) == 3
    (tmp_path / "t" / ".claim-4").write_text("")  # of a writer that was lost
    with pytest.raises(OSError):
        one.write(spark.range(4))
    assert one.release(3600) == [] and one.release(-5) == [4] and one.write(spark.range(4)) == 4 and one.read().count() == 4


def test_a_writer_stopped_between_claim_and_rename_loses_nothing(spark, tmp_path):
    one, two = (S.Versioned(spark, f"{tmp_path}/t") for _ in range(2))
    one.write(spark.range(1))
    one.read(), two.read()
    draft = one.draft(spark.range(2))
    (tmp_path / "t" / ".claim-2").write_text("")  # one has claimed version 2 and not yet renamed its draft
    with pytest.raises(OSError):
        two.write(spark.range(3))
    (tmp_path / "t" / ".claim-2").unlink()
    assert one.publish(draft) == 2 and two.read().count() == 2


def test_provenance_of_diamonds_and_cycles(spark):
    from engram.operators import graph as G

    rows = [(f"a{i}", f"{x}{i}", "SUPERSEDES") for i in range(8) for x in "bc"] + [(f"{x}{i}", f"a{i + 1}", "PROMOTED_FROM") for i in range(8) for x in "bc"] + [("x", "y", "SUPERSEDES"), ("y", "x", "SUPERSEDES")]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string")
    chain, summary = G.provenance(edges, spark.createDataFrame([("a0",), ("a5",), ("x",)], "start string"))
    got = {r.start: (r.depth, r.original_sources, r.depth_limited) for r in summary.collect()}
    assert got["a5"] == (6, ["a8"], False) and got["x"] == (1, ["y"], False) and got["a0"][0] == 10 and got["a0"][2]
    assert chain.where("start = 'a0'").count() == 15  # each node once, whatever the number of walks


def walks(edges, start, depth):
    """Every walk without a repeated node, by brute force."""
    out, todo = [], [[start]]
    while todo:
        path = todo.pop()
        for s, t, k in edges:
            if s == path[-1] and t not in path and len(path) <= depth:
                out.append(([*path, t], k))
                todo.append([*path, t])
    return out


@pytest.mark.parametrize("seed, nodes, n, depth", [(1, 7, 12, 10), (2, 6, 14, 4), (3, 9, 15, 6), (4, 5, 5, 10)])
def test_provenance_on_cycles_matches_all_walks(spark, seed, nodes, n, depth):
    import random

    from engram.operators import graph as G

    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice(["SUPERSEDES", "PROMOTED_FROM", "COMPACTED_FROM"])) for _ in range(n)]
    edges = [*{e for e in edges if e[0] != e[1]}] + ([("A", "B", "SUPERSEDES"), ("A", "C", "SUPERSEDES"), ("B", "D", "SUPERSEDES"), ("C", "D", "SUPERSEDES"), ("D", "B", "SUPERSEDES"), ("B", "E", "SUPERSEDES")] if seed == 4 else [])
    starts = sorted({x for e in edges for x in e[:2]})
    chain, summary = G.provenance(spark.createDataFrame(edges, "source_id string, target_id string, edge_type string"), spark.createDataFrame([(x,) for x in starts], "start string"), depth)
    got = {r.start: (r.depth, r.original_sources or [], r.depth_limited) for r in summary.collect()}
    near = {(r.start, r.node): (r.depth, r.edge_type) for r in chain.collect()}
    want, least = {}, {}
    for x in starts:
        own = walks(edges, x, depth)
        longest = max((len(p) - 1 for p, _ in own), default=0)
        want[x] = (longest, sorted({p[-1] for p, _ in own} - {p[-2] for p, _ in own}), longest >= depth)
        for p, k in own:
            least[x, p[-1]] = min(least.get((x, p[-1]), (99, "")), (len(p) - 1, k))
    assert got == want and near == least
    if seed == 4:
        assert got["A"] == (4, ["E"], False)


def test_strong_components(spark):
    from engram.operators import graph as G

    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (0, 1), (8, 8), (9, 10), (10, 11), (11, 9), (11, 4)]
    got = {r.node: r.component for r in G.strong_components(spark.createDataFrame(edges, "node long, next long")).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5, 9: 11, 10: 11, 11: 11}
    assert G.strong_components(spark.createDataFrame([(1, 2)], "node long, next long")).count() == 0


def test_upsert_and_partial_update(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, extra string")
    assert sorted(map(tuple, S.upsert(old, spark.createDataFrame([(2, "c", None)], old.schema), ["id"]).collect())) == [(1, "a", "x"), (2, "c", None)]
    new = spark.createDataFrame([(2, None), (3, "z")], "id long, name string")
    assert sorted(map(tuple, S.partial_update(old, new, ["id"]).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "z", None)]
    assert S.delete_ids(old, spark.createDataFrame([(1,)], "id long"), "id").count() == 1
    assert [r.id for r in S.keyset_page(old, 1, 5, "id").collect()] == [2]


def test_graph_ingest(spark):
    rows = [([("A", "T"), ("B", "T")], [("A", "B", "works with"), ("A", "Z", "x")])]
    df = spark.createDataFrame(rows, "entities array<struct<name:string,label:string>>, relationships array<struct<source:string,target:string,type:string>>")
    nodes, edges = S.ingest_graph(df)
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("A", "B", "WORKS_WITH")]


def test_reports():
    assert S.report_markdown("T", [{"a": 1, "b": 2}]).splitlines()[2:] == ["| a | b |", "|---|---|", "| 1 | 2 |"]
    assert S.report_json([{"b": 1}]) == '[{"b": 1}]'


METRICS = """# HELP edge_create Edges
# TYPE edge_create_total counter
edge_create_total{status="success",type="A"} 4995
edge_create_total{status="error"} 5
# TYPE link_seconds histogram
link_seconds_bucket{le="0.005"} 30
link_seconds_bucket{le="+Inf"} 100
link_seconds_count 100
link_seconds_sum 1.5
plain 3
"""


def test_metric_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text(METRICS)
    got = RD.metric_samples(spark.read.text(str(tmp_path / "m.txt"))).collect()
    assert {(r.metric, r.suffix, r.value) for r in got} == {("edge_create", "_total", 4995.0), ("edge_create", "_total", 5.0), ("link_seconds", "_bucket", 30.0), ("link_seconds", "_bucket", 100.0), ("link_seconds", "_count", 100.0), ("link_seconds", "_sum", 1.5), ("plain", "", 3.0)}
    assert next(r.labels for r in got if r.value == 4995) == {"status": "success", "type": "A"}


def test_text_files_and_json(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "  \n"), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in RD.text_files(spark, str(tmp_path)).collect()] == [("a.txt", "one")]
    assert RD.json_rows(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert RD.json_rows(spark, f"{tmp_path}/x.json", "a int").count() == 2


def test_settings_text():
    text = "slos:\n  - name: p95\n    limit: 0.5\n  - name: err\n    limit: 1\nwebhook: null\ndeep:\n  on: true\n  word: 'a b'\n"
    got = RD.settings_text(text)
    assert got["slos"] == [{"name": "p95", "limit": 0.5}, {"name": "err", "limit": 1}] and got["webhook"] is None and got["deep"]["word"] == "a b"


def test_embedding_cache(spark):
    model = RD.HashEmbedder(8)
    cache = spark.createDataFrame([], "text_key string, model string, embedding array<float>")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, None)], "memory_id long, text string")
    done, fresh = RD.with_embeddings(rows, cache, model)
    got = {r.memory_id: list(r.embedding) for r in done.collect()}
    assert got[1] == got[2] != got[3] and got[3] == got[4] == [0.0] * 8 and fresh.count() == 3
    assert RD.with_embeddings(rows, fresh, model)[1].count() == 0


EVENTS = "memory_id string, session_id string, event_seq long, event_time string, memory_type string, project string"


@pytest.fixture()
def events(spark, tmp_path):
    rows = [(f"m{i:03d}", f"s{i % 3}", i, f"2024-01-01T00:{i:02d}:00Z", "note", None if i % 2 else "p") for i in range(30)]
    df = spark.createDataFrame(rows, EVENTS)
    for part in range(3):
        df.where(f"floor(event_seq / 10) = {part}").coalesce(1).write.mode("append").json(f"{tmp_path}/in/{part}")
    return df, f"{tmp_path}/in"


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def test_predecessors_of_a_stream_equal_batch(spark, tmp_path):
    """Events come shuffled within the watermark, in six batches; sessions pause, repeat an instant, and end."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows, at = [], 0
    for i in range(240):
        at += int(rng.integers(0, 40)) if i % 60 else 7200  # an hour's pause ends every session
        rows.append((f"m{i:03d}", f"s{int(rng.integers(0, 5))}" if i % 11 else None, i // 2, at + 1_704_067_200))
    rows.append((rows[-1][0], rows[-1][1], 500, rows[-1][3]))  # the same item again
    end = rows[-1][3]
    shuffled = sorted(rows, key=lambda r: r[3] + int(rng.integers(0, 500)))
    kind = "memory_id string, session_id string, event_seq long, event_time long"
    for part in range(6):
        spark.createDataFrame(shuffled[part * 41 : (part + 1) * 41], kind).withColumn("event_time", F.timestamp_seconds("event_time")).coalesce(1).write.json(f"{tmp_path}/in/{part}")
    for i in (6, 7):  # two later events take the watermark past all others
        spark.createDataFrame([(f"z{i}", "end", i, end + 86_400 * i)], kind).withColumn("event_time", F.timestamp_seconds("event_time")).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    columns = "memory_id string, session_id string, event_seq long, event_time timestamp"
    source = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
    with pytest.raises(ValueError):
        ST.session_predecessors(source)
    ST.state_store(spark)
    try:
        q = ST.session_predecessors(source, "10 minutes", "1 hour").writeStream.format("memory").queryName("pred").option("checkpointLocation", f"{tmp_path}/ck1").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(ST.STATE_STORE)
    want = T.predecessors_in_time(spark.read.schema(columns).json(f"{tmp_path}/in/*"), "1 hour")
    want = sorted(tuple(r) for r in want.collect())
    assert sorted(tuple(r) for r in spark.table("pred").select("source_id", "target_id", "session_id").collect()) == want and 150 < len(want) < 215
    assert all(int(p["stateOperators"][0]["numRowsDroppedByWatermark"]) == 0 for p in q.recentProgress)
    states = [int(p["stateOperators"][0]["numRowsTotal"]) for p in q.recentProgress]
    assert max(states) >= 10 and states[-1] <= 3, list(states)  # lists count as one; what is left is of the last event's own session


def test_edges_of_a_stream_merge_once(spark, events, tmp_path):
    _, path = events
    table = S.Versioned(spark, f"{tmp_path}/edges")
    now = F.lit("2024-01-01").cast("timestamp")
    link = lambda b: edge_rows(T.predecessors(b), "MEMORY_FOLLOWS", "stream", "run", now)
    sink = ST.merge_edges(link, table)
    stream(spark, path).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination()
    before = sorted(map(str, table.read().collect()))
    sink(spark.read.schema(EVENTS).json(f"{path}/1"), 99)
    assert sorted(map(str, table.read().collect())) == before and len(before) == 3 * (10 - 3)


def test_numbers_of_a_stream_have_no_holes(spark, events, tmp_path):
    _, path = events
    table = S.Versioned(spark, f"{tmp_path}/seq")
    sink = ST.number(table)
    rows = stream(spark, path).drop("event_seq")
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck3").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_seq for r in table.read().collect()) == list(range(1, 31))
    sink(rows.sparkSession.read.schema(EVENTS).json(f"{path}/0").drop("event_seq"), 0)
    assert table.read().count() == 30


def test_scopes_of_a_stream(spark, events, tmp_path):
    df, path = events
    q = ST.timeline(stream(spark, path)).writeStream.format("memory").queryName("tl").option("checkpointLocation", f"{tmp_path}/ck4").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tl").count() == T.scoped(df).count() == 45


def test_windowed_counts(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    df = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    q = ST.windowed_counts(df).writeStream.format("memory").queryName("wc").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck5").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wc").agg(F.sum("n")).first()[0] == batch.count()


def test_sessions_and_checkpoints(spark):
    sessions = spark.createDataFrame([("s1", 5, "p", None), ("s2", 9, "p", None), ("s3", None, "p", None)], "session_id string, last_event_seq long, project string, thread_id string")
    assert T.latest_session(sessions, "p").first().session_id == "s2" and T.latest_session(sessions, "p", exclude="s2").first().session_id == "s1"
    assert [tuple(r) for r in T.follows(sessions).collect()] == [("s2", "s1")]
    events = spark.createDataFrame([("a", 1), ("b", 12)], "memory_id string, event_seq long")
    made = T.make_checkpoint(events, sessions, "s2", "done", "p")
    assert made["memory"].first().last_event_seq == 12 and made["follows"].first().prev_session_id == "s1" and made["timeline"].count() == 2
    new, links = T.link_sessions(sessions, spark.createDataFrame([("s9", "a"), ("s9", "a"), ("s1", "zz")], "session_id string, memory_id string"), events)
    assert new.count() == 4 and [tuple(r) for r in links.collect()] == [("s9", "a")]


def test_cascade(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source_id string, target_id string")
    assert E.without_nodes(edges, spark.createDataFrame([("b",)], "memory_id string")).count() == 1
    assert E.with_endpoints(edges, spark.createDataFrame([("a",), ("b",), ("c",)], "memory_id string")).count() == 2
