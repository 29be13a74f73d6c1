"""Keyed tables without a table format: upserts, partial updates, deletions, versioned folders."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key; new rows come after stored ones, and by `order` among themselves."""
    both = stored.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    rank = [F.desc("__batch")] + ([F.desc(order)] if order else [])
    return both.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*rank))).where("__n = 1").drop("__n", "__batch")


def overlay(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """stored with rows, one a key, in place of those of the same keys: the small side of the join is rows, stored is not shuffled for it."""
    return stored.join(rows.select(*key), key, "left_anti").select(*stored.columns).unionByName(rows.select(*stored.columns))


def partial_update(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored with the columns that new gives; nulls and absent columns keep the old value."""
    given = [c for c in new.columns if c not in key]
    change = new.select(*key, *(F.col(c).alias(f"__new_{c}") for c in given))
    joined = stored.join(change, key, "full")
    return joined.select(*key, *(F.coalesce(f"__new_{c}", c).alias(c) if c in given else F.col(c) for c in stored.columns if c not in key))


def delete_ids(rows: DataFrame, gone: DataFrame, key: str = "memory_id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def lookup(rows: DataFrame, ids: list, key: str = "memory_id") -> DataFrame:
    """Rows of the given ids; missing ids give none."""
    return rows.where(F.col(key).isin(*ids))


def keyset_page(rows: DataFrame, after, size: int, key: str = "memory_id") -> DataFrame:
    """The next `size` rows after a key, in key order."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)


class Versioned:
    """A table as a folder of versions v=1, v=2, ...: readers see the greatest one whole, writers never touch it.

    Files are written by Spark, and all else goes through its own file system layer, so the folder
    may lie in any store that Spark writes to. A version is written under a draft name; its number,
    the one after that which the writer has read, is claimed by a file that only one writer can create, and the
    draft is renamed. A writer whose table was changed since it read it, or is being changed, is
    refused. A claim of a writer that was lost stays until release() takes it, by its age.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seen = spark, path.rstrip("/"), None

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        jvm, fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self) -> DataFrame | None:
        v = self.versions()
        self.seen = v[-1] if v else 0
        return self.spark.read.parquet(f"{self.path}/v={v[-1]}") if v else None

    def draft(self, df: DataFrame) -> str:
        """Write df where no reader looks; the folder's name."""
        name = f"{self.path}/.draft-{uuid.uuid4().hex}"
        df.write.parquet(name)
        return name

    def publish(self, draft: str) -> int:
        """Make a draft the next version; its number."""
        jvm, fs, _ = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        last = (self.versions() or [0])[-1]
        version = (last if self.seen is None else self.seen) + 1
        if last >= version or not fs.createNewFile(path(f"{self.path}/.claim-{version}")):
            raise OSError(f"version {version} of {self.path} is written by another")
        if not fs.rename(path(draft), path(f"{self.path}/v={version}")):
            raise OSError(f"version {version} of {self.path} could not be published")
        self.seen = version
        return version

    def release(self, older_than: float = 3600.0) -> list[int]:
        """Take away claims without a version that are older (seconds): their writers were lost. The numbers."""
        jvm, fs, p = self._fs()
        done, limit, out = set(self.versions()), (time.time() - older_than) * 1000, []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            if name.startswith(".claim-") and int(name[7:]) not in done and s.getModificationTime() <= limit and fs.delete(s.getPath(), False):
                out.append(int(name[7:]))
        return sorted(out)

    def write(self, df: DataFrame) -> int:
        """Write df as the next version: under a name of its own, then by one rename."""
        return self.publish(self.draft(df))


def latest_days(snapshots: DataFrame, keep: int = 7) -> DataFrame:
    """The last row of each date, of the last `keep` dates."""
    one = snapshots.withColumn("__n", F.row_number().over(W.partitionBy("date").orderBy(F.desc("taken_at")))).where("__n = 1")
    return one.withColumn("__d", F.row_number().over(W.orderBy(F.desc("date")))).where(F.col("__d") <= keep).drop("__n", "__d")


def report_json(rows: list[dict]) -> str:
    return json.dumps(rows, sort_keys=True, default=str)


def report_markdown(title: str, rows: list[dict]) -> str:
    """A small report table."""
    head = list(rows[0]) if rows else []
    lines = [f"# {title}", ""] + (["| " + " | ".join(head) + " |", "|" + "---|" * len(head)] if head else ["No rows."])
    return "\n".join(lines + ["| " + " | ".join(str(r[h]) for h in head) + " |" for r in rows]) + "\n"


def ingest_graph(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows with entities array<struct<name, label>> and relationships array<struct<source, target, type>>.

    Edges need both ends among the row's nodes; types become upper case with underscores.
    """
    rows = extracted.withColumn("row_id", F.monotonically_increasing_id())
    own = rows.select("row_id", F.explode("entities").alias("e")).select("row_id", F.col("e.name").alias("name"), F.col("e.label").alias("label"))
    nodes = own.groupBy("name").agg(F.min("label").alias("label"))
    edges = rows.select("row_id", F.explode("relationships").alias("r")).select("row_id", "r.source", "r.target", F.upper(F.replace("r.type", F.lit(" "), F.lit("_"))).alias("edge_type"))
    for end in ("source", "target"):
        edges = edges.join(own.select("row_id", F.col("name").alias(end)), ["row_id", end], "left_semi")
    return nodes, edges.select("source", "target", "edge_type").distinct()
