"""Metrics of a run, measured while its jobs run: counters, gauges and histograms from observed aggregates.

Nothing is computed twice: each watch adds one aggregation to the plan that it is given, and its few
values come to the driver with the job's end. An observation counts the rows that pass its place in
the plan; a plan that is run again, or a stage that is computed again after its files were lost, is
counted as Spark counts it, so watch a DataFrame that is written once.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SAMPLES = "metric string, type string, suffix string, labels map<string,string>, value double"


@dataclass(frozen=True)
class Watch:
    name: str
    kind: str
    labels: tuple[tuple[str, str], ...]
    bounds: tuple[float, ...]
    seen: Observation


class RunMetrics:
    """Watches put on the DataFrames of a run. A metric keeps its kind and, as a histogram, its bounds."""

    def __init__(self):
        self._watches: list[Watch] = []

    def _watch(self, df: DataFrame, name: str, kind: str, labels: dict, bounds: tuple, *values: Column) -> DataFrame:
        for w in self._watches:
            if w.name == name and (w.kind, w.bounds) != (kind, bounds):
                raise ValueError(f"{name} is a {w.kind} with bounds {w.bounds}")
        seen = Observation()
        out = df.observe(seen, *values)
        self._watches.append(Watch(name, kind, tuple(sorted((k, str(v)) for k, v in labels.items())), bounds, seen))
        return out

    def counter(self, df: DataFrame, name: str, condition: Column | None = None, **labels) -> DataFrame:
        """df, whose rows (those that the condition holds for) are counted."""
        return self._watch(df, name, "counter", labels, (), F.count_if(F.lit(True) if condition is None else condition).cast("double").alias("n"))

    def gauge(self, df: DataFrame, name: str, value: Column, **labels) -> DataFrame:
        """df, of which an aggregate is taken; of several of a name and labels the last one put counts."""
        return self._watch(df, name, "gauge", labels, (), value.cast("double").alias("n"))

    def histogram(self, df: DataFrame, name: str, value: Column, bounds: list[float], **labels) -> DataFrame:
        """df, whose values are counted up to each bound; nulls are no samples."""
        bounds = tuple(sorted(float(b) for b in bounds))
        cells = [F.count_if(value <= b).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)]
        return self._watch(df, name, "histogram", labels, bounds, *cells, F.count(value).cast("double").alias("n"), F.coalesce(F.sum(value.cast("double")), F.lit(0.0)).alias("sum"))

    def values(self, timeout: float = 60.0) -> list[tuple]:
        """(metric, type, suffix, labels, value), in order of name and labels. TimeoutError if a watched job has not run."""
        totals: dict[tuple, dict[str, float]] = {}
        for w in self._watches:
            got = _result(w.seen, timeout)
            if got is None:
                raise TimeoutError(f"the job that {w.name} watches has not run")
            own = totals.setdefault((w.name, w.kind, w.labels, w.bounds), {})
            for k, v in got.items():
                own[k] = v if w.kind == "gauge" else own.get(k, 0.0) + v
        out = []
        for (name, kind, labels, bounds), own in sorted(totals.items()):
            if kind == "histogram":
                cells = [(_number(b), own[f"b{i}"]) for i, b in enumerate(bounds)] + [("+Inf", own["n"])]
                out += [(name, kind, "_bucket", {**dict(labels), "le": le}, v) for le, v in cells]
                out += [(name, kind, "_count", dict(labels), own["n"]), (name, kind, "_sum", dict(labels), own["sum"])]
            else:
                out.append((name, kind, "_total" if kind == "counter" else "", dict(labels), own["n"]))
        return out

    def samples(self, spark: SparkSession, timeout: float = 60.0) -> DataFrame:
        """The values as rows of the form that sources.readers.metric_samples gives."""
        return spark.createDataFrame(self.values(timeout), SAMPLES)

    def text(self, timeout: float = 60.0) -> str:
        """The values in the usual exposition format."""
        lines, last = [], None
        for name, kind, suffix, labels, value in self.values(timeout):
            if name != last:
                lines.append(f"# TYPE {name}{'_total' if kind == 'counter' else ''} {kind}")
                last = name
            quoted = ",".join(f'{k}="{_escaped(v)}"' for k, v in labels.items())
            lines.append(f"{name}{suffix}{'{' + quoted + '}' if quoted else ''} {'NaN' if value is None else _number(value)}")
        return "\n".join(lines) + "\n"


def buckets(samples: DataFrame) -> DataFrame:
    """(metric, le, value) of histogram samples, as ops.histogram_quantile takes them."""
    le = F.col("labels")["le"]
    return samples.where("suffix = '_bucket'").select("metric", F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.cast("double")).alias("le"), "value")


def _result(seen: Observation, timeout: float) -> dict | None:
    """What was observed, or None if no job has ended in time: an observation by itself waits for ever."""
    got: list[dict] = []
    waiter = threading.Thread(target=lambda: got.append(seen.get), daemon=True)
    waiter.start()
    waiter.join(timeout)
    return got[0] if got else None


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def _escaped(v: str) -> str:
    return v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
