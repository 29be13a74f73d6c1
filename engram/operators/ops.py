"""Operational analytics: coverage, histogram quantiles, error rates, drift, audits, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.settings import DEFAULTS


def percent(part: Column, whole: Column) -> Column:
    """To 2 places, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 2))


def session_coverage(memories: DataFrame, since: Column, gate: float = DEFAULTS.coverage_gate) -> DataFrame:
    """One row: items with a session, of all and of those since an instant, and whether both reach the gate."""
    recent = F.col("event_time") >= since
    one = memories.agg(
        F.count("*").alias("total"), F.count("session_id").alias("covered"),
        F.count_if(recent).alias("recent_total"), F.count_if(recent & F.col("session_id").isNotNull()).alias("recent_covered"),
    )
    one = one.withColumn("pct", percent(F.col("covered"), F.col("total"))).withColumn("recent_pct", percent(F.col("recent_covered"), F.col("recent_total")))
    return one.withColumn("passed", (F.col("pct") >= gate) & (F.col("recent_pct") >= gate))


def to_buckets(samples: DataFrame, value: str, bounds: list[float], group: list[str] | None = None) -> DataFrame:
    """(group, le, value): cumulative bucket counts, the last one without bound (infinity)."""
    counts = samples.groupBy(*(group or [])).agg(*(F.count_if(F.col(value) <= b).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).cast("double").alias("all"))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("value")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("value")))
    return counts.select(*(group or []), F.explode(cells).alias("c")).select(*(group or []), "c.le", "c.value")


def histogram_quantile(buckets: DataFrame, q: float = 0.95, group: str = "metric") -> DataFrame:
    """(group, quantile) of cumulative buckets(group, le, value); equal le of different labels are added first.

    Linear inside the bucket where the count is reached; the last finite bound for the unbounded
    bucket; null without samples.
    """
    merged = buckets.groupBy(group, "le").agg(F.sum("value").alias("cum"))
    w = W.partitionBy(group).orderBy("le")  # a row a bound
    rows = merged.select(group, "le", "cum", F.lag("le", 1, 0.0).over(w).alias("below"), F.lag("cum", 1, 0.0).over(w).alias("before"), F.max("cum").over(W.partitionBy(group)).alias("total"))
    rows = rows.withColumn("target", F.col("total") * q)
    span = F.col("cum") - F.col("before")
    value = F.when(F.col("le") == float("inf"), F.col("below")).when(span <= 0, F.col("le")).otherwise(F.col("below") + (F.col("target") - F.col("before")) / span * (F.col("le") - F.col("below")))
    hit = (F.col("total") > 0) & (F.col("cum") >= F.col("target"))
    return rows.groupBy(group).agg(F.min_by(F.when(hit, value), F.when(hit, F.col("le"))).alias("quantile"))


def error_rate(samples: DataFrame, group: list[str] | None = None, status: str = "status", value: str = "value") -> DataFrame:
    """Errors over everything; null without samples."""
    bad, every = F.sum(F.when(F.col(status) == "error", F.col(value)).otherwise(0.0)), F.sum(value)
    return samples.groupBy(*(group or [])).agg(bad.alias("errors"), every.alias("total"), F.when(every > 0, bad / every).alias("error_rate"))


def daily_deviation(daily: DataFrame, multiplier: float = 10.0, history: int = 3) -> DataFrame:
    """(day, n, delta, median_delta, status) of daily(day, n): each day's change against the median of all changes before it.

    At least `history` earlier changes are needed; bounds turn with the median's sign; around a
    median of 0 a change of the multiplier's size counts.
    """
    w = W.orderBy("day")  # a row a day
    rows = daily.withColumn("delta", F.col("n") - F.lag("n").over(w))
    before = F.collect_list("delta").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("past", before).withColumn("median_delta", F.when(F.size("past") >= history, _median(F.col("past"))))
    m, d = F.col("median_delta"), F.col("delta")
    out = F.when(m > 0, (d > m * multiplier) | (d < m / multiplier)).when(m < 0, (d > m / multiplier) | (d < m * multiplier)).otherwise(F.abs(d) >= multiplier)
    status = F.when(m.isNull() | d.isNull(), "no_data").when(out, "violation").otherwise("ok")
    return rows.select("day", "n", "delta", m.cast("double").alias("median_delta"), status.alias("status"))


def _median(values: Column) -> Column:
    """The median of an array that is not empty."""
    s = F.array_sort(values)
    low, high = F.floor((F.size(s) - 1) / 2).cast("int"), F.floor(F.size(s) / 2).cast("int")
    return (F.get(s, low) + F.get(s, high)) / 2


def compaction_audit(edges: DataFrame, since: Column) -> DataFrame:
    """One row on COMPACTED_FROM edges: new ones, all, some run ids, and a status."""
    rows = edges.where(F.col("edge_type") == "COMPACTED_FROM")
    new = F.col("created_at") >= since
    one = rows.agg(F.count_if(new).alias("recent"), F.count("*").alias("total"), F.slice(F.array_sort(F.collect_set(F.when(new, F.col("run_id")))), 1, 5).alias("sample_run_ids"))
    return one.withColumn("status", F.when(F.col("recent") > 0, "ok").when(F.col("total") > 0, "alert_regression").otherwise("alert_dead_letter"))


def latency_summary(samples: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """n, p50, p95, p99 (linear), mean, sample deviation, least and greatest."""
    p = lambda q: F.percentile(value, F.lit(q))
    return samples.groupBy(*(group or [])).agg(
        F.count(value).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def size_class(n: Column) -> Column:
    """1, 2, 3, 4, 5-9, 10-19, 20-49, 50-99, 100+."""
    out = F.when(n < 5, n.cast("string"))
    for low, high in ((5, 9), (10, 19), (20, 49), (50, 99)):
        out = out.when(n.between(low, high), f"{low}-{high}")
    return out.otherwise("100+")


def session_sizes(memories: DataFrame) -> DataFrame:
    """(size_class, sessions)."""
    sizes = memories.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count("*").alias("n"))
    return sizes.groupBy(size_class(F.col("n")).alias("size_class")).agg(F.count("*").alias("sessions"))


def validate_items(items: DataFrame) -> DataFrame:
    """items(item_index, content, ...) with error (null if good)."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    return items.withColumn("error", F.when(F.col("content").isNull(), "missing content").when(blank, "empty content"))


def bulk_summary(validated: DataFrame) -> DataFrame:
    """total, succeeded, failed and a status."""
    one = validated.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count("error").alias("failed"))
    return one.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("succeeded") > 0, "partial_success").otherwise("error"))


def catalog(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(table_name, n_columns, n, duplicate_keys): rows and repeated keys of each table, one pass a table."""
    out = None
    for name, df in tables.items():
        groups = df.groupBy(*keys[name]).agg(F.count("*").alias("c"))
        one = groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 1).alias("duplicate_keys"))
        one = one.select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), "n", "duplicate_keys")
        out = one if out is None else out.unionByName(one)
    return out


def audit(tables: dict[str, DataFrame], keys: dict[str, list[str]], kinds: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """(section, table_name, item, n) of what the tables hold, two passes a table.

    rows: the table's rows. columns: the values of each column that are not null. properties: the rows that hold each key of each map column.
    missing_keys: rows with a null in the key. repeated_keys: keys of more than one row. kinds: rows of each value of a table's kind
    column, (column, expected values); a value that is expected and not there has 0 rows, a null one is (null).
    """
    out = []

    def put(section: str, name: str, rows: DataFrame, item: Column, n: Column) -> None:
        out.append(rows.select(F.lit(section).alias("section"), F.lit(name).alias("table_name"), item.alias("item"), F.coalesce(n, F.lit(0)).cast("long").alias("n")))

    for name, df in tables.items():
        key = keys[name]
        no_key = F.lit(False)
        for k in key:
            no_key = no_key | F.col(k).isNull()
        one = df.agg(F.count("*").alias("__rows"), F.count_if(no_key).alias("__missing"), *(F.count(c).alias(f"c_{i}") for i, c in enumerate(df.columns)))
        cells = [("rows", F.lit(""), F.col("__rows")), ("missing_keys", F.lit(",".join(key)), F.col("__missing")), *(("columns", F.lit(c), F.col(f"c_{i}")) for i, c in enumerate(df.columns))]
        flat = one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("section"), i.alias("item"), v.alias("n")) for s, i, v in cells))).alias("e"))
        out.append(flat.select("e.section", F.lit(name).alias("table_name"), "e.item", "e.n"))
        groups = df.where(~no_key).groupBy(*key).agg(F.count("*").alias("c"))
        put("repeated_keys", name, groups.agg(F.count_if(F.col("c") > 1).alias("n")), F.lit(",".join(key)), F.col("n"))
        for c, t in df.dtypes:
            if t.startswith("map<string"):
                held = df.select(F.explode(F.map_keys(F.col(c))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
                put("properties", name, held, F.concat(F.lit(f"{c}."), "k"), F.col("n"))
        if kinds and name in kinds:
            column, expected = kinds[name]
            found = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(null)")).alias("k")).agg(F.count("*").alias("n"))
            wanted = df.sparkSession.createDataFrame([(v,) for v in expected], "k string")
            put("kinds", name, found.join(wanted, "k", "full"), F.col("k"), F.col("n"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows
