"""Service objectives over metric samples and daily totals, with what a run of them leaves behind: a rolling state, rows of alerts, notes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import ops as O
from engram.operators.snapshots import Change, SnapshotStore

RESULT = "name string, metric string, kind string, status string, actual double, threshold double, direction string"
DAILY = "date string, total long, by_type map<string,long>"
KINDS = ("p95", "error_rate", "daily_change")
NOTE_TYPE = "slo-alert"


@dataclass(frozen=True)
class Objective:
    """kind p95: the 0.95 quantile of a histogram. error_rate: samples with outcome error over all. daily_change: a multiple of the median change."""

    name: str
    metric: str
    kind: str
    threshold: float
    direction: str = "less_than"


def objectives_of(settings: dict) -> list[Objective]:
    """The objectives of a settings mapping {slos: [{name, metric, aggregation, threshold..., direction}]}; those of an unknown kind are left out."""
    kinds = {"p95": "p95", "error_rate": "error_rate", "deviation_vs_median_7d": "daily_change"}
    out = []
    for row in settings.get("slos") or []:
        kind = kinds.get(row.get("aggregation"))
        if kind:
            bound = next((row[k] for k in ("threshold_seconds", "threshold", "threshold_multiplier") if row.get(k) is not None), 10.0)
            out.append(Objective(row["name"], row["metric"], kind, float(bound), row.get("direction") or ("bounded" if kind == "daily_change" else "less_than")))
    return out


def evaluate(samples: DataFrame, objectives: Sequence[Objective], daily: DataFrame | None = None, date: str | None = None) -> DataFrame:
    """RESULT rows, one an objective: status ok, violation or no_data.

    samples(metric, suffix, labels, value) are those of metric text or of a run's metrics; they are summed by metric before
    they meet the objectives. daily(date, total) is the state with the row of `date`. A metric without samples, and a day
    without enough days before it, have no data.
    """
    spark = samples.sparkSession
    asked = spark.createDataFrame([astuple(o) for o in objectives], "name string, metric string, kind string, threshold double, direction string")
    named = F.col("metric").isin(*{o.metric for o in objectives})
    bound = F.expr("try_cast(labels['le'] as double)")
    buckets = samples.where(named & (F.col("suffix") == "_bucket")).select("metric", bound.alias("le"), "value").where("le is not null")
    p95 = O.histogram_quantile(buckets, 0.95, "metric").select("metric", F.lit("p95").alias("kind"), F.col("quantile").alias("actual"))
    counts = samples.where(named & F.col("suffix").isin("", "_total")).withColumn("status", F.coalesce(F.col("labels")["outcome"], F.lit("")))
    rates = O.error_rate(counts, ["metric"]).select("metric", F.lit("error_rate").alias("kind"), F.col("error_rate").alias("actual"))
    # a row a metric and kind: as many as there are objectives at most
    out = asked.join(p95.unionByName(rates), ["metric", "kind"], "left")
    met = F.when(F.col("direction") == "less_than", F.col("actual") < F.col("threshold")).otherwise(F.col("actual") > F.col("threshold"))
    out = out.withColumn("status", F.when(F.col("actual").isNull(), "no_data").when(met, "ok").otherwise("violation"))
    changes = [o for o in objectives if o.kind == "daily_change"]
    if changes and daily is not None and date is not None:
        days = daily.where(F.col("date") <= date).select(F.col("date").alias("day"), F.col("total").alias("n"))
        for o in changes:
            one = O.daily_deviation(days, o.threshold).where(F.col("day") == date).select(F.lit(o.name).alias("name"), F.col("status").alias("__status"), F.col("delta").cast("double").alias("__delta"))
            out = out.join(one, "name", "left").withColumn("status", F.coalesce("__status", "status"))
            out = out.withColumn("actual", F.when(F.col("__status") != "no_data", F.col("__delta")).otherwise(F.col("actual"))).drop("__status", "__delta")
    return out.select(*(c.split()[0] for c in RESULT.split(", ")))


def note(result: dict, date: str) -> str:
    """The text of an alert: a head that says what it is, and the figures."""
    show = lambda v: "n/a" if v is None else f"{v:.6g}"
    head = {"type": NOTE_TYPE, "slo": result["name"], "status": result["status"], "actual": show(result["actual"]), "threshold": show(result["threshold"]), "created": date}
    body = {"Metric": result["metric"], "Direction": result["direction"], "Observed": show(result["actual"]), "Threshold": show(result["threshold"])}
    lines = ["---", *(f"{k}: {v}" for k, v in head.items()), "---", "", f"# Objective missed: {result['name']}", "", *(f"- {k}: {v}" for k, v in body.items())]
    return "\n".join(lines) + "\n"


def is_note(text: str) -> bool:
    """Whether a text has the head of an alert; the words elsewhere in it do not count."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "---":
        return False
    for line in lines[1:]:
        if line.strip() == "---":
            return False
        if re.fullmatch(rf"type:\s*[\"']?{re.escape(NOTE_TYPE)}[\"']?\s*", line):
            return True
    return False


class Watch:
    """The state of objectives in a folder: totals of the last days and the alerts, each run one commit.

    A second run of a day replaces what the first one left. Notes go where notes_path names a folder: one file an
    alert, whose name holds letters, digits, - and _ only, so none lies outside of it; a file that is no alert is never written over.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 7, notes_path: str | None = None):
        self.spark, self.keep, self.notes_path = spark, keep, notes_path
        self._store = SnapshotStore(spark, path, {"daily": (DAILY, ["date"]), "alerts": (f"date string, {RESULT}", ["date", "name"])})

    def daily(self) -> DataFrame:
        return self._store.snapshot().table("daily")

    def alerts(self) -> DataFrame:
        return self._store.snapshot().table("alerts")

    def _days(self, stored: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The state with counts(date, type, n) in it before old days go, and its days that stay."""
        new = counts.groupBy("date", "type").agg(F.sum("n").cast("long").alias("n")).groupBy(F.col("date").cast("string").alias("date"))
        new = new.agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
        every = stored.join(new.select("date"), "date", "left_anti").unionByName(new)
        return every, every.select("date").orderBy(F.desc("date")).limit(self.keep)

    def record(self, counts: DataFrame) -> None:
        """Put the totals of counts(date, type, n) in place of those of the same dates; only the last `keep` dates stay."""
        before = self._store.snapshot()
        every, last = self._days(before.table("daily"), counts)
        self._settle(before, every, last, {})

    def _settle(self, before, every: DataFrame, last: DataFrame, more: dict[str, Change]) -> None:
        kept = every.join(last, "date", "left_semi")
        gone = before.table("daily").join(last, "date", "left_anti").select("date")
        self._store.commit({"daily": Change(kept, gone)} | more, before)
        self._store.compact()

    def check(self, samples: DataFrame, objectives: Sequence[Objective], counts: DataFrame, date: str, dry_run: bool = False) -> list[dict]:
        """Results of a day as RESULT dicts in the order of the objectives; unless dry_run the day's total, the alerts and their notes are written.

        counts(type, n) are the day's totals by type. Without any the day has no data and leaves the state as it is. The change of a day
        is judged against the days before it in the state, the last `keep` of them.
        """
        before = self._store.snapshot()
        stored = before.table("daily")
        today = counts.select(F.lit(date).alias("date"), "type", "n")
        past = stored.where(F.col("date") != date).orderBy(F.desc("date")).limit(self.keep)
        whole, _ = self._days(past, today)
        found = {r.name: r.asDict() for r in evaluate(samples, objectives, whole, date).collect()}  # a row an objective
        results = [found[o.name] for o in objectives]
        if dry_run:
            return results
        bad = [r for r in results if r["status"] == "violation"]
        old = before.table("alerts").where(F.col("date") == date).select("date", "name")
        rows = self.spark.createDataFrame([(date, *(r[c.split()[0]] for c in RESULT.split(", "))) for r in bad], f"date string, {RESULT}")
        every, last = self._days(stored, today)
        self._settle(before, every, last, {"alerts": Change(rows, old)})
        if self.notes_path is not None:
            for r in bad:
                self.write_note(r, date)
        return results

    def write_note(self, result: dict, date: str) -> bool:
        """Write an alert's note; False where a file of that name is no alert."""
        clean = lambda s: re.sub(r"[^A-Za-z0-9_-]+", "-", s).strip("-") or "unnamed"
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.notes_path.rstrip('/')}/slo-alert-{clean(result['name'])}-{clean(date)}.md")
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(target):
            stream = fs.open(target)
            try:
                if not is_note(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")):
                    return False
            finally:
                stream.close()
        stream = fs.create(target, True)
        try:
            stream.write(bytearray(note(result, date).encode()))
        finally:
            stream.close()
        return True
