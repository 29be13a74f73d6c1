"""A cache of vectors by text whose entries expire and whose size is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.lineage import settle
from engram.operators.snapshots import Change, Conflict, SnapshotStore
from engram.operators.timeline import micros, sequenced
from engram.operators.vectors import non_zero
from engram.sources.readers import Embedder, embed

CACHE = "model string, text_key string, embedding array<float>, made_at timestamp, used_at timestamp"


class VectorCache:
    """Vectors of texts under a name of their model, in a store of its own that all sessions may share.

    An entry is good for `ttl` from when it was made, however often it is used. Once there are more than
    `size` entries of a model, those go whose last use is the longest ago; of entries used at the same time
    the greater key goes first. Texts that the model gave no vector for are not kept.
    """

    def __init__(self, spark: SparkSession, path: str, model: Embedder, name: str = "default", size: int = 1000, ttl: str = "24 hours"):
        self.spark, self.model, self.name, self.size, self.ttl = spark, model, name, size, ttl
        self.store = SnapshotStore(spark, path, {"vectors": (CACHE, ["model", "text_key"])})

    def entries(self) -> DataFrame:
        return self.store.snapshot().table("vectors").where(F.col("model") == self.name)

    def embedded(self, rows: DataFrame, now: Column | None = None) -> DataFrame:
        """rows(text, ...) with embedding: the model sees each text that has no good entry once.

        What is used and made is written in one commit. Where another writer was first it is not written at all: the
        rows are the same, and the texts are seen again next time.
        """
        now = F.current_timestamp() if now is None else now.cast("timestamp")
        snapshot = self.store.snapshot()
        stored = snapshot.table("vectors").where(F.col("model") == self.name)
        age = F.unix_micros(now) - F.unix_micros("made_at")
        good = stored.where(age < micros(self.ttl))
        rows = rows.drop("embedding")
        key = F.sha2(F.coalesce("text", F.lit("")), 256)
        asked = rows.select(key.alias("text_key"), "text").dropDuplicates(["text_key"])
        hits = good.join(asked.select("text_key"), "text_key", "left_semi").withColumn("used_at", now)
        missing = asked.join(good.select("text_key"), "text_key", "left_anti").repartition("text_key")
        fresh = missing.select(F.lit(self.name).alias("model"), "text_key", embed(F.col("text"), self.model).alias("embedding"), now.alias("made_at"), now.alias("used_at"))
        columns = stored.columns
        used = settle(hits.select(*columns).unionByName(fresh.select(*columns)))
        kept = used.where(non_zero(F.col("embedding")))
        over = self._over(good, kept)
        gone = stored.where(age >= micros(self.ttl)).select("model", "text_key").unionByName(over)
        try:
            self.store.commit({"vectors": Change(kept.join(over, ["model", "text_key"], "left_anti").select(*columns), gone)}, snapshot)
            self.store.compact()
        except Conflict:
            pass
        return rows.withColumn("text_key", key).join(used.select("text_key", "embedding"), "text_key", "left").drop("text_key")

    def _over(self, good: DataFrame, kept: DataFrame) -> DataFrame:
        """(model, text_key) of the entries beyond the size, after kept ones were written."""
        after = good.join(kept.select("text_key"), "text_key", "left_anti").unionByName(kept).select("model", "text_key", (-F.unix_micros("used_at")).alias("idle"))
        if after.count() <= self.size:
            return after.limit(0).select("model", "text_key")
        # numbered by range partitions, so no task and no driver holds the order of all
        return sequenced(after, "idle", "text_key").where(F.col("event_seq") > self.size).select("model", "text_key")
