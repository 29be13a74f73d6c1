"""The products of blocks: exact with ties, copies and near copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import index
from engram.operators import vectors as V


def naive(x, y, threshold, top):
    nx, ny, out = index.lengths(x), index.lengths(y), []
    for i in range(len(x)):
        blank = (nx[i] < 1e-10) | (ny < 1e-10)
        s = np.where(blank, 0, (x[i] * y).cumsum(axis=1)[:, -1] / np.where(blank, 1, nx[i] * ny))
        out += [(i, int(j), float(s[j])) for j in np.lexsort((np.arange(len(y)), -s))[:top] if s[j] >= threshold]
    return out


@pytest.mark.parametrize("top", [1, 3, 50])
@pytest.mark.parametrize("noise", [None, 0.0, 1e-6])
def test_best_pairs_are_exact(monkeypatch, top, noise):
    monkeypatch.setattr(index, "SLICES", (16, 900))
    rng = np.random.default_rng(top)
    x, y = rng.standard_normal((60, 24)), rng.standard_normal((3000, 24))
    if noise is not None:  # half of them are copies, or nearer to each other than single precision tells
        y[1::2] = y[1] + noise * rng.standard_normal(y[1::2].shape)
        x[::4], x[1::5], y[::90] = y[1], 0, 0
    for threshold in (float("-inf"), 0.3):
        rows, cols, score = index.best_pairs(x, y, threshold, top)
        assert list(zip(rows.tolist(), cols.tolist(), score.tolist(), strict=True)) == naive(x, y, threshold, top)


def test_no_rows_and_no_hits():
    x = np.eye(3)
    assert all(len(a) == 0 for a in index.best_pairs(x, x[:0], 0.5, 3)) and all(len(a) == 0 for a in index.best_pairs(x, -x, 0.5, 3))


def test_a_row_goes_to_few_blocks(spark):
    """Blocks were of 2048 rows: 300 of 615,000 rows, so each row was shuffled 300 times."""
    sizes = [(0, 64), (1, 64), (2048, 64), (10_000, 64), (100_000, 64), (615_000, 64), (615_000, 1536), (20_000, 2)]
    got = spark.createDataFrame(sizes, "n long, width int").select(index.blocks(F.col("n"), F.col("width")).alias("b")).collect()
    assert [r.b for r in got] == [1, 1, 1, 5, 8, 19, 451, 8]


def test_blocks_give_the_nearest(spark):
    rows = spark.range(20_000).select(F.col("id").alias("memory_id"), F.array(F.cos(F.col("id")), F.sin(F.col("id"))).cast("array<float>").alias("embedding"))
    xy = np.stack([np.cos(np.arange(20_000)), np.sin(np.arange(20_000))], axis=1).astype(np.float32).astype(float)
    by = {}
    for r in V.probe(rows.where("memory_id % 4000 = 0"), rows, 3).collect():
        by.setdefault(r.new_id, []).append((r.rank, r.memory_id))
    assert len(by) == 5 and all([m for _, m in sorted(by[i])] == [j for _, j, _ in naive(xy[i : i + 1], xy, float("-inf"), 3)] for i in by)
