"""The nearest-neighbor index against exact search: recall at the similarity threshold, copies, upkeep."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.operators import vectors as V
from engram.operators.index import VectorIndex, block_scores, scaled

THRESHOLD = 0.82


def planted(spark, n, dim=64, seed=0, project="p", first=0):
    """n random vectors in pairs: the second of a pair at a cosine of 0.82 to 0.95 to the first."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n // 2, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = rng.standard_normal(a.shape)
    away -= (away * a).sum(1, keepdims=True) * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(0.82, 0.95, (n // 2, 1))
    rows = np.concatenate([a, c * a + np.sqrt(1 - c**2) * away])
    table = pa.table({"memory_id": pa.array(np.arange(first, first + len(rows))), "project": pa.array([project] * len(rows)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), dim).cast(pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def links(df):
    return {(r.source_id, r.target_id): r.score for r in df.collect()}


def test_recall_at_the_threshold(spark):
    rows = planted(spark, 8000)
    index = VectorIndex.build(rows)
    exact, found = links(V.neighbors(rows)), links(index.search(rows))
    assert len(exact) >= 7000 and len(set(exact) & set(found)) >= 0.9 * len(exact)
    assert set(found) <= set(exact) and all(abs(found[k] - exact[k]) < 1e-9 for k in found)
    assert index.probes < len(index.centroids) / 2
    asked = rows.where("memory_id % 50 = 0")
    assert set(links(index.search(asked))) == {k for k in found if k[0] % 50 == 0}


def test_copies_are_one_entry(spark):
    """A third of all rows are one vector: each row still has its first copies as neighbors, exactly."""
    rows = planted(spark, 400, 16)
    copy = rows.where("memory_id = 7").select("embedding").first().embedding
    hot = spark.range(1000, 1200).select(F.col("id").alias("memory_id"), F.lit("p").alias("project"), F.array(*map(F.lit, copy)).alias("embedding"))
    other = spark.createDataFrame([(5000, "q", copy), (5001, None, copy), (5002, "p", [0.0] * 16), (5003, "p", None)], rows.schema)
    both = rows.unionByName(hot).unionByName(other)
    index = VectorIndex.build(both)
    assert index.entries.count() == 403
    exact, found = links(V.neighbors(both.where("project is not null"))), links(index.search(both))
    assert {k: v for k, v in exact.items() if k[0] >= 1000} == pytest.approx({k: v for k, v in found.items() if k[0] >= 1000})
    assert len(set(exact) & set(found)) >= 0.97 * len(exact) and (5000, 7) not in found


def test_a_saved_index_takes_new_vectors(spark, tmp_path):
    rows, more = planted(spark, 600, 16), planted(spark, 40, 16, seed=1, first=10_000)
    path = f"{tmp_path}/index"
    VectorIndex.build(rows).save(path)
    index = VectorIndex.load(spark, path)
    before = set(links(index.search(rows)))
    grown = index.add(path, more)
    found = set(links(grown.search(more)))
    assert grown.entries.count() == 640 and before == set(links(grown.search(rows)))
    assert len(found & set(links(V.neighbors(rows.unionByName(more), asked=more)))) >= 36


def test_no_vectors(spark):
    none = planted(spark, 4).limit(0)
    assert VectorIndex.build(none) is None and V.neighbors(none).count() == 0 and V.duplicates(none, none).count() == 0


def test_blocks_keep_the_best_of_each_source(spark, monkeypatch):
    """Many small blocks give what one matrix gives, ties by id."""
    from engram.operators import index as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (60, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, "p", v.tolist()) for i, v in enumerate(x)], "memory_id long, project string, embedding array<double>")
    rows = scaled(df, ["memory_id", "project"]).withColumn("cell", F.lit(0))
    got = block_scores(rows.withColumnRenamed("memory_id", "source_id"), rows.withColumnRenamed("memory_id", "target_id"), 0.5, 4)
    assert got.count() > 60
    u = np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), 0)
    near = (u @ u.T).round(9)
    want = {i: [j for _, j in sorted((-near[i, j], j) for j in range(60) if j != i and near[i, j] >= 0.5)[:3]] for i in range(60)}
    rank = {}
    for r in V.neighbors(df.withColumn("embedding", F.col("embedding")), 0.5, 3, 3).collect():
        rank.setdefault(r.source_id, []).append((-round(r.score, 9), r.target_id))
    assert {i: [j for _, j in sorted(v)] for i, v in rank.items()} == {i: v for i, v in want.items() if v}
