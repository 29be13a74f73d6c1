"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's checkpoint folder.

    Only where a local session names none one of this machine is set.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not (sc.getConf().get("spark.checkpoint.dir") or sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("a cluster's session needs spark.checkpoint.dir, a folder that all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="engram-"))
    return sc.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder: later plans start from its files, which all executors share.

    What was shuffled on the way is removed at once, not when the driver happens to collect garbage: nothing reads it again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        # a frame takes the setting when it is made
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
