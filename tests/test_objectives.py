"""Objectives: statuses, the rolling state, alerts and notes."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from engram.operators import objectives as B
from engram.sources.readers import settings_text

SETTINGS = """
slos:
  - name: p95_fast
    metric: latency_seconds
    aggregation: p95
    threshold_seconds: 0.5
    direction: less_than
  - name: p95_slow
    metric: latency_seconds
    aggregation: p95
    threshold_seconds: 0.1
  - name: p95_none
    metric: never_seen
    aggregation: p95
    threshold_seconds: 1
  - name: errors
    metric: made_total
    aggregation: error_rate
    threshold: 0.01
  - name: change
    metric: edges
    aggregation: deviation_vs_median_7d
    threshold_multiplier: 10.0
    direction: bounded
  - name: unknown
    metric: edges
    aggregation: other
"""


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("latency_seconds", "_bucket", {"le": le, "t": t}, v) for t in "ab" for le, v in (("0.1", 10.0), ("0.25", 45.0), ("+Inf", 50.0), ("junk", 3.0))]
    rows += [("latency_seconds", "_count", {"t": t}, 50.0) for t in "ab"]
    rows += [("made_total", "_total", {"outcome": "error"}, 2.0), ("made_total", "_total", {"outcome": "ok"}, 98.0), ("made_total", "_total", None, 0.0), ("made_total", "_created", {}, 1e9)]
    return spark.createDataFrame(rows, "metric string, suffix string, labels map<string,string>, value double")


def by_name(rows):
    return {r["name"]: r for r in rows}


def counts(spark, by):
    return spark.createDataFrame(list(by.items()), "type string, n long")


def test_statuses(spark, samples, tmp_path):
    wanted = B.objectives_of(settings_text(SETTINGS))
    assert [o.kind for o in wanted] == ["p95", "p95", "p95", "error_rate", "daily_change"]
    got = by_name(r.asDict() for r in B.evaluate(samples, wanted).collect())
    # 95 of 100 lie above the last finite bound, which is given
    assert got["p95_fast"]["status"] == "ok" and got["p95_fast"]["actual"] == 0.25
    assert got["p95_slow"]["status"] == "violation" and got["p95_none"]["status"] == "no_data"
    assert got["errors"]["status"] == "violation" and got["errors"]["actual"] == pytest.approx(0.02)
    assert got["change"]["status"] == "no_data" and got["change"]["actual"] is None


def test_days(spark, samples, tmp_path):
    """The state day by day against the same kept in a list."""
    watch = B.Watch(spark, str(tmp_path / "w"), notes_path=str(tmp_path / "notes"))
    change = [B.Objective("../change/x", "edges", "daily_change", 10.0, "bounded")]
    kept, totals = [], [100, 110, 121, 130, 145, 150, 900, 905, 905, 911]
    for i, n in enumerate(totals):
        day = f"2024-01-{i + 1:02d}"
        got = watch.check(samples, change, counts(spark, {"a": n - 7, "b": 7}), day)[0]
        deltas = [b - a for a, b in zip(kept, kept[1:])]
        if len(deltas) < 3:
            assert got["status"] == "no_data" and got["actual"] is None
        else:
            m, d = median(deltas), n - kept[-1]
            bad = d > m * 10 or d < m / 10
            assert (got["status"], got["actual"]) == ("violation" if bad else "ok", d)
        kept = [*kept, n][-7:]
    assert [r.total for r in watch.daily().orderBy("date").collect()] == kept
    alerts = [(r.date, r.actual) for r in watch.alerts().orderBy("date").collect()]
    assert ("2024-01-07", 750.0) in alerts and all(d > "2024-01-04" for d, _ in alerts)
    notes = sorted(p.name for p in (tmp_path / "notes").iterdir() if p.suffix == ".md")
    assert notes == [f"slo-alert-change-x-{d}.md" for d, _ in alerts] and not (tmp_path / "change").exists()
    # the last day again, now without the fault: its total and its alert are replaced
    watch.check(samples, change, counts(spark, {"a": 912}), "2024-01-10")
    last = watch.daily().where("date = '2024-01-10'").first()
    assert (last.total, last.by_type) == (912, {"a": 912}) and watch.daily().count() == 7
    # a day before all that are kept does not enter
    watch.record(spark.createDataFrame([("2023-01-01", "a", 5)], "date string, type string, n long"))
    assert watch.daily().count() == 7 and watch.daily().where("date < '2024'").isEmpty()
    before = sorted(map(str, watch.daily().collect()))
    watch.check(samples, change, counts(spark, {"a": 5000}), "2024-01-11", dry_run=True)
    assert sorted(map(str, watch.daily().collect())) == before
    assert watch.check(samples, change, counts(spark, {"a": 1}).limit(0), "2024-01-11")[0]["status"] == "no_data"
    assert sorted(map(str, watch.daily().collect())) == before


def test_notes_of_people_stay(spark, tmp_path):
    watch = B.Watch(spark, str(tmp_path / "w"), notes_path=str(tmp_path))
    result = {"name": "errors", "metric": "m", "status": "violation", "actual": None, "threshold": 0.5, "direction": "less_than"}
    assert watch.write_note(result, "2024-01-01") and watch.write_note(result, "2024-01-01")
    file = tmp_path / "slo-alert-errors-2024-01-01.md"
    assert B.is_note(file.read_text()) and "n/a" in file.read_text()
    for other in ("my words\n---\ntype: slo-alert\n---\n", "---\ntitle: x\n---\ntype: slo-alert\n", ""):
        file.unlink()
        file.write_text(other)
        (tmp_path / f".{file.name}.crc").unlink(missing_ok=True)
        assert not watch.write_note(result, "2024-01-01") and file.read_text() == other


def test_empty(spark, samples):
    wanted = B.objectives_of(settings_text(SETTINGS))
    got = B.evaluate(samples.limit(0), wanted, spark.createDataFrame([], B.DAILY), "2024-01-01").collect()
    assert len(got) == 5 and {r.status for r in got} == {"no_data"}
    assert B.objectives_of({}) == []
