"""What the corpus operators share: reading tables, the shared folder, byte-level word arrays.

Texts reach Python as Arrow batches. They are handled as one byte array with an offset for
each document, in pieces of a few MB, so that memory stays bounded whatever the batch size;
only a single document longer than a piece makes a longer piece.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time; its arrays take some 60 bytes for each.
PIECE_BYTES = 500_000

U64 = np.uint64


#: Bytes of an Arrow batch between the JVM and Python.
ARROW_BYTES = "4m"


def lean(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: by rows alone, long texts make batches of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where a local session has none (tests) a folder of this machine is set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("a cluster's session needs spark.checkpoint.dir, a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="engram-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, name: str, light: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends at durable files.

    light: rows of a few numbers, whose last step is cheap: a task for each core of the cluster writes them, and no more.
    """
    lean(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(spark.sparkContext.defaultParallelism) if light else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves the given remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def tidy() -> None:
    """Give memory that this Python worker no longer uses back to the system; the worker may wait for long."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no GNU C library here
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: tuple = (None, None)


def kept_by_worker(name: str, make):
    """What make() gave for a name: a worker keeps it between tasks, until it is asked for another or runs a scan that keeps nothing."""
    global _kept
    if _kept[0] != name:
        release()
        _kept = name, make()
    return _kept[1]


def release() -> None:
    """Drop what this worker keeps."""
    global _kept
    if _kept[0] is not None:
        _kept = None, None
        tidy()


def tidied(scan, keeps: bool = False):
    """scan, a function from batches to batches, with tidy() at its end; unless it keeps something between tasks, what others kept is dropped."""

    @functools.wraps(scan)
    def run(batches):
        if not keeps:
            release()
        try:
            yield from scan(batches)
        finally:
            tidy()

    return run


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: further columns cannot clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns k and k2, 96 bits of hash of a row's id and text: the same for equal rows only."""
    return [F.xxhash64(doc_id, text).alias("k"), F.hash(text, doc_id).alias("k2")]


# ---------------------------------------------------------------- bytes and words


def byte_class(pattern: str) -> np.ndarray:
    """A table of 256 flags from ranges written as pairs of hex bytes, e.g. "20-20 09-0D"."""
    out = np.zeros(256, bool)
    for part in pattern.split():
        low, high = part.split("-")
        out[int(low, 16) : int(high, 16) + 1] = True
    return out


#: Bytes of words [^\x20\x09-\x0D]+; all bytes of longer UTF-8 characters belong to words.
PLAIN_WORD = ~byte_class("20-20 09-0D")
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z.
ALNUM_WORD = ~byte_class("00-2F 3A-60 7B-7F")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes (bijective)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 256), _BASE, U64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=U64)
    return _powers[:n]


_BACK = U64(pow(int(_BASE), -1, 1 << 64))
_LOW_BITS = 16


def _ladder(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers base ** i for i below 2 ** _LOW_BITS, and base ** (i << _LOW_BITS) for as many i."""
    out = []
    for b in (int(base), pow(int(base), 1 << _LOW_BITS, 1 << 64)):
        p = np.full(1 << _LOW_BITS, b, U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


_UP, _DOWN = _ladder(_BASE), _ladder(_BACK)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span that span_hashes gives, for any spans of data, from prefix sums."""
    low, high = _UP
    total = np.zeros(len(data) + 1, U64)
    for at in range(0, len(data), 1 << _LOW_BITS):
        part = _BYTE_VALUES[data[at : at + (1 << _LOW_BITS)]]
        part *= low[: len(part)]
        part *= high[at >> _LOW_BITS]
        np.cumsum(part, out=total[at + 1 : at + 1 + len(part)])
        total[at + 1 : at + 1 + len(part)] += total[at]
    low, high = _DOWN
    h = (total[ends] - total[starts]) * low[starts & (1 << _LOW_BITS) - 1] * high[starts >> _LOW_BITS]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; the spans follow each other and make up all of data."""
    if not len(starts):
        return np.zeros(0, U64)
    step = np.arange(len(data)) - np.repeat(starts, lens)
    h = np.add.reduceat(_BYTE_VALUES[data] * powers(int(lens.max()) + 1)[step], starts)
    return mix(h + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


class Piece:
    """Some whole documents of a batch: row numbers from..to, their bytes, and offsets into these."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def words(self, flags: np.ndarray = PLAIN_WORD, data: np.ndarray | None = None) -> "Words":
        return Words(self.data if data is None else data, self.offsets, flags)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value per byte over each document."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words:
    """The words of some documents: starts and ends in the bytes, and first[i]: the first word of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray):
        self.data = data
        inside = flags[data] if len(data) else np.zeros(0, bool)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word ends with its document
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.inside = inside
        self.n = len(self.starts)
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.counts = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def place(self) -> np.ndarray:
        """The number of each word in its document."""
        return np.arange(self.n) - np.repeat(self.first[:-1], self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not self.n:
            return np.zeros(0, U64)
        return prefix_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of a document, and the number of the first word of each."""
        if self.n < k:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        h = np.zeros(self.n - k + 1, U64)
        for i in range(k):
            h *= _BASE
            h += hashes[i : self.n - k + 1 + i]
        left = np.repeat(self.first[1:], self.counts)[: self.n - k + 1] - np.arange(self.n - k + 1)
        at = np.flatnonzero(left >= k)
        return mix(h[at] + U64(k)), at


def binary_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a binary column without nulls."""
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if offsets is not None and len(col) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def string_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    return binary_bytes(col.cast(pa.large_string()).cast(pa.large_binary()))


def pieces(col: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """A string column in runs of whole documents of at most limit bytes, or one longer document."""
    data, offs = string_bytes(col)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield Piece(first, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of keys by distinct value, in the order of their first places, and these places."""
    import pandas as pd  # some 40 MB of a worker's memory, which few of them need

    codes, values = pd.factorize(keys)
    first = np.zeros(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return codes.astype(np.int64, copy=False), first


class HashMemo:
    """Numbers 0, 1, 2, ... of hashes, in the order they were added: a long sorted array, and a short
    one of the latest that is merged into it now and then."""

    SHORT = 1 << 17

    def __init__(self):
        self.n = 0
        self.levels = [(np.zeros(0, U64), np.zeros(0, np.int64))] * 2

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        h, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(h, kind="stable")  # a merge: both parts ascend
        return h[order], n[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for known, numbers in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = numbers[at[hit]]
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of new hashes, which ascend."""
        numbers = np.arange(self.n, self.n + len(hashes))
        self.n += len(hashes)
        long, short = self.levels
        short = self._merge(short, (hashes, numbers))
        if len(short[0]) > self.SHORT:
            long, short = self._merge(long, short), (np.zeros(0, U64), np.zeros(0, np.int64))
        self.levels = [long, short]
        return numbers


def room(a: np.ndarray, n: int) -> np.ndarray:
    """a, longer if it has less than n places."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)])


def strings(texts: list[str | None]) -> pa.Array:
    return pa.array(texts, pa.large_string())
