"""Dense numbers stay dense when many rows are written out with further columns."""

import pytest
from pyspark.sql import functions as F

from engram.operators import timeline as T


@pytest.mark.parametrize("rows,adaptive", [(500_000, True), (499_721, False), (4_000_000, True)])
def test_numbers_are_dense_when_written(spark, tmp_path, rows, adaptive):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    try:
        events = spark.range(rows).select((F.xxhash64("id") % 100_000).alias("event_time"), F.col("id").alias("memory_id"), F.concat(F.lit("text "), "id").alias("text"))
        T.sequenced(events, "event_time", "memory_id", start=7).write.parquet(f"{tmp_path}/out")
        out = spark.read.parquet(f"{tmp_path}/out")
        r = out.agg(F.count("*"), F.count_distinct("event_seq"), F.min("event_seq"), F.max("event_seq")).first()
        assert tuple(r) == (rows, rows, 8, rows + 7)
        # ten thousand neighbors are in order
        near = [tuple(x) for x in out.where("event_seq <= 10007").orderBy("event_seq").select("event_time", "memory_id").collect()]
        assert near == sorted(near)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
