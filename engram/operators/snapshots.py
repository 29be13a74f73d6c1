"""A store of several keyed tables whose versions are one: a commit log over immutable folders.

Layout: `_log/<number>.json` names, for each table, a base folder and the delta folders after it;
`data/<table>/<name>` are Parquet folders that are written once and never changed. A snapshot is one
log entry, so readers see all tables of one version or of another, never a mixture.

A commit writes its deltas first, each in a folder of its own, then the entry under a draft name, and
renames it to the number after that of the snapshot it was computed from. The rename fails where
that number is there: of two writers that read the same snapshot one is refused (Conflict) and
reads again. Whatever a writer leaves that is lost before the rename is seen by nobody; vacuum
removes it. The rename without overwriting is that of the store's file system layer (atomic in
HDFS and its like).

A delta holds the changed rows and the keys of deleted ones, so that what a commit writes grows with the
change and not with the table. Tables are merged when they are read: the last change of each key,
and the rows of the base whose key no delta has. The deltas' keys are the small side of an anti-join, which
Spark broadcasts by size; the base is read as it lies. compact() merges deltas of like size once there are
`fan` of them, and everything into a new base once `fan` deltas, or large ones, are `ratio` of it: each
row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GONE = "__gone"


class Conflict(OSError):
    """The store was written by another since the snapshot was read."""


@dataclass(frozen=True)
class Change:
    """Rows to write, one a key, and keys to delete; a key in both is written."""

    upserts: DataFrame | None = None
    deletes: DataFrame | None = None


@dataclass(frozen=True)
class TableFiles:
    """The folders of a table: a base, if any, and (folder, bytes) of its deltas, oldest first."""

    base: str | None = None
    base_bytes: int = 0
    deltas: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Snapshot:
    """All tables at one version. Version 0 has no rows."""

    store: SnapshotStore = field(repr=False)
    version: int
    files: dict[str, TableFiles]
    note: dict

    def table(self, name: str) -> DataFrame:
        """The rows of a table, merged."""
        own, key = self.files.get(name, TableFiles()), self.store.keys[name]
        base = self.store.read(name, own.base) if own.base else None
        if not own.deltas:
            return self.store.empty(name) if base is None else base
        last = self.store.merged(name, [d for d, _ in own.deltas])
        new = last.where(~F.col(GONE)).drop(GONE)
        if base is None:
            return new
        return base.join(last.select(*key), _same(base, last, key), "left_anti").unionByName(new)


def _same(a: DataFrame, b: DataFrame, key: list[str]):
    out = F.lit(True)
    for k in key:
        out = out & a[k].eqNullSafe(b[k])
    return out


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]], fan: int = 8, ratio: float = 0.5, large: int = 32 << 20):
        """tables: the schema and the key columns by name; large: bytes of deltas that are merged into a base whatever their number."""
        self.spark, self.path, self.fan, self.ratio, self.large = spark, path.rstrip("/"), fan, ratio, large
        self.schemas = {n: s for n, (s, _) in tables.items()}
        self.keys = {n: list(k) for n, (_, k) in tables.items()}

    # ------------------------------------------------------------ the file system layer

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("_log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _read_text(self, name: str) -> str:
        jvm, stream = self.spark.sparkContext._jvm, self._fs().open(self._path(name))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        stream = self._fs().create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _rename_new(self, old: str, new: str) -> bool:
        """Rename a file; False if the new name is there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        target = self._path(new)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), conf)
        try:
            files.rename(self._path(old), target, how)
        except Exception:
            if self._fs().exists(target):
                return False
            raise
        return True

    # ------------------------------------------------------------ reading

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_log") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The latest snapshot, or an older one that is still there."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return Snapshot(self, 0, {}, {})
        entry = json.loads(self._read_text(f"_log/{version:020d}.json"))
        files = {n: TableFiles(t["base"], t["base_bytes"], tuple((f, b) for f, b in t["deltas"])) for n, t in entry["tables"].items()}
        return Snapshot(self, version, files, entry["note"])

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[name])

    def read(self, name: str, folder: str, marks: bool = False) -> DataFrame:
        return self.spark.read.schema(self.schemas[name] + (f", {GONE} boolean" if marks else "")).parquet(f"{self.path}/{folder}")

    def merged(self, name: str, deltas: list[str]) -> DataFrame:
        """The last change of each key of some deltas, oldest first, with GONE for deletions."""
        if len(deltas) == 1:
            return self.read(name, deltas[0], True)
        rows = None
        for i, folder in enumerate(deltas):
            part = self.read(name, folder, True).withColumn("__age", F.lit(i))
            rows = part if rows is None else rows.unionByName(part)
        key = self.keys[name]
        rest = [c for c in rows.columns if c not in (*key, "__age")]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "__age").alias("__last"))
        return last.select(*(F.col(c) if c in key else F.col(f"__last.{c}").alias(c) for c in rows.columns if c != "__age"))

    # ------------------------------------------------------------ writing

    def _put(self, name: str, rows: DataFrame) -> tuple[str, int]:
        """Write rows to a new folder; its name and bytes."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder, int(self._fs().getContentSummary(self._path(folder)).getLength())

    def delta(self, name: str, change: Change) -> tuple[str, int] | None:
        """Write a change to a folder; None if it changes nothing."""
        key, columns = self.keys[name], self.empty(name).columns
        up = gone = None
        if change.upserts is not None:
            up = change.upserts.select(*columns).withColumn(GONE, F.lit(False))
        if change.deletes is not None:
            kinds = dict(self.empty(name).dtypes)
            gone = change.deletes.select(*key).distinct()
            if up is not None:
                gone = gone.join(up.select(*key), _same(gone, up, key), "left_anti")
            gone = gone.select(*(F.col(c) if c in key else F.lit(None).cast(kinds[c]).alias(c) for c in columns), F.lit(True).alias(GONE))
        rows = up if gone is None else gone if up is None else up.unionByName(gone)
        if rows is None:
            return None
        # by key, so that a key's rows lie in one file of each delta; adaptive execution makes few files of a small change
        put = self._put(name, rows.repartition(*key).sortWithinPartitions(*key))
        return None if self.read(name, put[0], True).isEmpty() else put

    def commit(self, changes: dict[str, Change], parent: Snapshot, note: dict | None = None) -> Snapshot:
        """The snapshot after parent with the changes, all or none; Conflict if another has followed on parent already."""
        files = dict(parent.files)
        for name, change in changes.items():
            put = self.delta(name, change)
            if put is not None:
                own = files.get(name, TableFiles())
                files[name] = TableFiles(own.base, own.base_bytes, (*own.deltas, put))
        return self._publish(files, parent, note or {})

    def _publish(self, files: dict[str, TableFiles], parent: Snapshot, note: dict) -> Snapshot:
        version, draft = parent.version + 1, f"_log/.draft-{uuid.uuid4().hex}"
        tables = {n: {"base": t.base, "base_bytes": t.base_bytes, "deltas": [list(d) for d in t.deltas]} for n, t in files.items()}
        self._write_text(draft, json.dumps({"tables": tables, "note": note}))
        if not self._rename_new(draft, f"_log/{version:020d}.json"):
            self._fs().delete(self._path(draft), False)
            raise Conflict(f"{self.path}: version {version} was written by another since version {parent.version} was read")
        return Snapshot(self, version, files, note)

    # ------------------------------------------------------------ upkeep

    def compacted(self, parent: Snapshot, name: str) -> TableFiles | None:
        """The files of a table after compaction, written; None if none is due."""
        own = parent.files.get(name, TableFiles())
        total = sum(b for _, b in own.deltas)
        key = self.keys[name]
        if total >= self.ratio * own.base_bytes and (len(own.deltas) >= self.fan or total >= self.large):
            # by ranges of the key, so that a search for keys skips files by their statistics
            base = self._put(name, parent.table(name).repartitionByRange(*key).sortWithinPartitions(*key))
            return TableFiles(base[0], base[1])
        # the latest deltas of like size: each no larger than fan times the smallest of them
        first = len(own.deltas)
        least = None
        while first:
            least = own.deltas[first - 1][1] if least is None else min(least, own.deltas[first - 1][1])
            if own.deltas[first - 1][1] > self.fan * least:
                break
            first -= 1
        some = own.deltas[first:]
        if len(some) < self.fan:
            return None
        one = self._put(name, self.merged(name, [d for d, _ in some]).repartition(*key).sortWithinPartitions(*key))
        return TableFiles(own.base, own.base_bytes, (*own.deltas[:first], one))

    def compact(self) -> Snapshot:
        """Compact the tables that need it; the latest snapshot. Rows stay the same; a racing writer wins."""
        parent = self.snapshot()
        files = {n: f for n in parent.files if (f := self.compacted(parent, n)) is not None}
        if not files:
            return parent
        try:
            return self._publish(parent.files | files, parent, parent.note)
        except Conflict:
            return self.snapshot()

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> int:
        """Remove log entries but for the last `keep`, and folders and drafts that none of these names and that are older (seconds); how many.

        The age keeps what running writers have written and not yet committed.
        """
        fs, limit, removed = self._fs(), (time.time() - older_than) * 1000, 0
        versions = self.versions()
        kept = [self.snapshot(v) for v in versions[-max(keep, 1) :]]
        named = {f for s in kept for t in s.files.values() for f in (t.base, *(d for d, _ in t.deltas)) if f}
        gone = [f"_log/{v:020d}.json" for v in versions[: -max(keep, 1)]] + [f"_log/{n}" for n in self._names("_log") if n.startswith(".draft-")]
        gone += [f"data/{t}/{n}" for t in self._names("data") for n in self._names(f"data/{t}") if f"data/{t}/{n}" not in named]
        for name in gone:
            p = self._path(name)
            if fs.exists(p) and fs.getFileStatus(p).getModificationTime() <= limit:
                removed += bool(fs.delete(p, True))
        return removed
