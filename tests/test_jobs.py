"""Backfills in parts: one that is broken off goes on where it was, with the edges of one that was not."""

import pytest
from pyspark.sql import functions as F

from engram.api import MemoryStore
from engram.sources.readers import HashEmbedder


def NOW():
    return F.lit("2024-02-01T00:00:00Z").cast("timestamp")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = MemoryStore(spark, str(tmp_path_factory.mktemp("jobs")), HashEmbedder(32))
    words = ["python", "spark", "kafka", "redis"]
    items = [
        {"content": f"notes on {words[i % 4]} and {words[(i + 1 + i // 12) % 4]} for part {i}", "id": f"m{i:02d}", "metadata": {"project": f"p{i % 2}", "session_id": f"s{i % 5}", "entities": [words[i % 4], words[(i + 1 + i // 12) % 4]], "event_time": f"2024-01-{i + 1:02d}T00:00:00Z"}}
        for i in range(24)
    ]
    s.bulk_upsert(items, NOW())
    return s


def edges(store, run):
    return sorted((r.edge_type, r.source_id, r.target_id, round(r.weight, 4)) for r in store.table("edges").where(F.col("run_id") == run).collect())


def test_a_broken_backfill_goes_on(store, monkeypatch):
    store.backfill("entities", "names", NOW())
    for kind, parts in (("similarity", 3), ("cooccurrence", 4), ("temporal", 3)):
        whole = store.backfill(kind, "whole", NOW())
        want = edges(store, "backfill-whole")
        assert want and whole["parts_run"] == 1
        store.rollback("backfill-whole")
        step, ran = store._backfill_part, []

        def part(kind, tag, when, i, n, dry):
            if ran:
                raise RuntimeError("lost")
            ran.append(i)
            return step(kind, tag, when, i, n, dry)

        with monkeypatch.context() as m:
            m.setattr(store, "_backfill_part", part)
            with pytest.raises(RuntimeError):
                store.backfill(kind, "broken", NOW(), parts=parts)
        assert len(edges(store, "backfill-broken")) < len(want)
        with pytest.raises(ValueError):
            store.backfill(kind, "broken", NOW(), parts=parts + 1)
        out = store.backfill(kind, "broken", NOW(), parts=parts)
        assert out["parts_run"] == parts - 1 and out["found"] == whole["found"] and out["by_project"] == whole["by_project"]
        assert edges(store, "backfill-broken") == want
        again = store.backfill(kind, "broken", NOW(), parts=parts)
        assert again["parts_run"] == 0 and again["found"] == whole["found"]
        store.rollback("backfill-broken")
        assert store.table("jobs").isEmpty() and not edges(store, "backfill-broken")
