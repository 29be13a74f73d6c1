"""A cache that expires and is bounded; metrics measured while a job runs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engram.operators import metrics as M
from engram.operators import ops as O
from engram.operators.cache import VectorCache
from engram.sources import readers as RD

START = datetime(2024, 1, 1)


class Counted(RD.HashEmbedder):
    """Names the texts that it is asked for in a file each, since workers do not share memory with the test."""

    def __init__(self, folder):
        super().__init__(8)
        self.folder = str(folder)

    def __call__(self, texts):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return super().__call__(texts)


def test_cache_expires_and_evicts(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    cache = VectorCache(spark, str(tmp_path / "cache"), Counted(seen), size=3, ttl="2 hours")

    def ask(texts, minutes):
        """The texts that the model saw."""
        for f in seen.iterdir():
            f.unlink()
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
        got = cache.embedded(rows, F.lit((START + timedelta(minutes=minutes)).isoformat(sep=" "))).collect()
        plain = RD.HashEmbedder(8)(texts)
        assert len(got) == len(texts) and all(r.embedding == pytest.approx(plain[r.id], abs=1e-6) for r in got)
        return sorted(t for f in seen.iterdir() for t in f.read_text().split("\n"))

    held = lambda: cache.entries().count()
    assert ask(["a", "b", "b", " ", None], 0) == ["a", "b"] and held() == 2  # blank texts are not kept
    assert ask(["a"], 10) == [] and ask(["c"], 20) == ["c"] and held() == 3
    assert ask(["d"], 30) == ["d"] and held() == 3  # b, used the longest ago, went
    assert ask(["a", "c"], 40) == [] and ask(["b"], 50) == ["b"] and held() == 3  # now d went
    assert ask(["a"], 119) == [] and ask(["a"], 120) == ["a"]  # two hours after it was made, whenever it was used
    assert len(ask([f"t{i}" for i in range(9)], 130)) == 9 and held() == 3
    assert ask(["zz"], 1000) == ["zz"] and held() == 1


def test_metrics_of_a_run(spark, tmp_path):
    run = M.RunMetrics()
    parts = [spark.range(0, 100).withColumn("v", F.col("id") / 100), spark.range(0, 50).withColumn("v", F.when(F.col("id") % 2 == 0, 5.0))]
    for i, df in enumerate(parts):
        df = run.histogram(df, "seconds", F.col("v"), [0.5, 0.05, 1])
        df = run.counter(df, "rows", stage=f"s{i}")
        run.gauge(df, "most", F.max("v")).write.format("noop").mode("overwrite").save()
    got = {(m, s, ls.get("le") or ls.get("stage")): v for m, _, s, ls, v in run.values()}
    assert got == {("seconds", "_bucket", "0.05"): 6, ("seconds", "_bucket", "0.5"): 51, ("seconds", "_bucket", "1"): 100, ("seconds", "_bucket", "+Inf"): 125, ("seconds", "_count", None): 125, ("seconds", "_sum", None): 49.5 + 125, ("rows", "_total", "s0"): 100, ("rows", "_total", "s1"): 50, ("most", "", None): 5.0}
    (tmp_path / "m.txt").write_text(run.text())
    read = RD.metric_samples(spark.read.text(str(tmp_path / "m.txt")))
    plain = lambda df: sorted((r.metric, r.suffix, sorted(r.labels.items()), r.value) for r in df.collect())
    assert plain(read) == plain(run.samples(spark))
    assert O.histogram_quantile(M.buckets(run.samples(spark)), 0.4).first().quantile == pytest.approx(0.05 + (50 - 6) / 45 * 0.45)


def test_metrics_refusals(spark):
    run = M.RunMetrics()
    run.counter(spark.range(3), "never")
    with pytest.raises(TimeoutError):
        run.values(0.5)
    with pytest.raises(ValueError):
        run.gauge(spark.range(3), "never", F.max("id"))
    none = M.RunMetrics()
    none.histogram(spark.range(0), "empty", F.col("id"), [1.0]).write.format("noop").mode("overwrite").save()
    assert [v for *_, v in none.values()] == [0.0, 0.0, 0.0, 0.0]
