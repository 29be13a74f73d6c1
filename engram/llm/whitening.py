"""Embedding whitening: exact integer sums, a second pass of centred outer products, eigenvectors.

Every entry c of a vector becomes the integer x = floor(64 * c) + 1000000. The first pass sums x by
dimension in integers: each task sums the high and the low 32 bits apart in 64 bits, and the sums of
tasks are added as Python integers, so the mean S / n is exact at any number of rows. The second
pass centres each x (integer part of the mean first, which is exact, then its fraction) and sums
outer products by matrix multiplication of blocks of rows. Both passes give one small row a task,
merged by treeAggregate: dim numbers, then dim * dim, whatever the number of rows. The covariance
is decomposed on the driver by LAPACK (dim * dim numbers), and the projection of dim * components
numbers is broadcast. A third pass measures the covariance of the whitened rows themselves, the
last one gives them.

No row is shuffled, so no key can be hot, and a lost executor costs its unfinished tasks only.

Edge cases. A null vector, one with a null or non-finite entry, an empty one, and one with an entry
whose x does not fit 62 bits is dropped. All vectors of a table lie in one space: of vectors of
several lengths those of the most frequent length stay (the greater of two equally frequent ones),
the others are dropped. A direction without variance (e within rounding of 0: fewer vectors than
dimensions, equal vectors) is no component, so there may be fewer than asked for; where all vectors
are equal there is none, and no row. Repeated rows count as often as they are there; a null id is
carried; an empty table gives no rows; other columns are ignored. deviation is null where the exact
sum does not fit a long (the operator gives it as text in deviation_text). A vector is one row of
some 30 * dim bytes in a worker, a block of BLOCK_ROWS of them is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import table, tidied

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows of one matrix multiplication.
BLOCK_ROWS = 2048
#: Entries beyond this magnitude (as x) are no numbers of a vector.
MOST = 1 << 62


def dense(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a list column that hold finite vectors (of length dim), and their entries as doubles, end to end."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < MOST / SCALE / 2))])
    good = (lens > 0) & (bad[ends] == bad[ends - lens])
    if dim is not None:
        good &= lens == dim
    return np.flatnonzero(good), values[np.repeat(good, lens)]


def integers(values: np.ndarray) -> np.ndarray:
    """x of each entry; 64 * c is exact in a double."""
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def blocks(batches: Iterator[pa.RecordBatch], dim: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows, x as a matrix) of at most BLOCK_ROWS rows at a time."""
    for batch in batches:
        for low in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(low, BLOCK_ROWS)
            rows, values = dense(part.column(column), dim)
            yield part, rows, integers(values).reshape(len(rows), dim)


def summed(vectors: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], add: Callable, load: Callable):
    """The sum over all tasks of what scan gives for each, as bytes; None if there is none."""

    def run(batches):
        for raw in scan(batches):
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])

    def join(a, b):
        return b if a is None else a if b is None else add(a, b)

    return vectors.mapInArrow(tidied(run), "raw binary").rdd.map(lambda r: load(bytes(r[0]))).treeAggregate(None, join, join)


@dataclass
class Whitening:
    """n rows of dim dimensions with exact sums; columns of vectors: unit components; variances and their total."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def base(self) -> np.ndarray:
        """The integer part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The mean's fraction, 0 <= rest < 1."""
        return np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.variances)


def length_of(vectors: DataFrame) -> int | None:
    """The most frequent length of finite vectors, the greater of two alike; None if there is no vector."""

    def scan(batches):
        counts: dict[int, int] = {}
        for batch in batches:
            lens = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            rows, _ = dense(batch.column(0))
            for d, k in zip(*np.unique(lens[rows], return_counts=True), strict=True):
                counts[int(d)] = counts.get(int(d), 0) + int(k)
        if counts:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    counted = vectors.mapInArrow(tidied(scan), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    first = counted.orderBy(F.desc("n"), F.desc("dim")).first()
    return None if first is None else first.dim


def exact_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the sums of x by dimension."""

    def scan(batches):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for _, rows, x in blocks(batches, dim):
            n += len(rows)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield np.concatenate([[n], high, low]).tobytes()

    def load(raw):
        v = [int(k) for k in np.frombuffer(raw, np.int64)]
        return [v[0], *((h << 32) + k for h, k in zip(v[1 : dim + 1], v[dim + 1 :], strict=True))]

    got = summed(vectors, scan, lambda a, b: [x + y for x, y in zip(a, b, strict=True)], load)
    return (0, [0] * dim) if got is None else (got[0], got[1:])


def outer_sums(vectors: DataFrame, dim: int, base: np.ndarray, rest: np.ndarray, projection: np.ndarray | None = None) -> np.ndarray:
    """The sum of outer products of the centred (and, with a projection, whitened) rows."""
    size = dim if projection is None else projection.shape[1]
    held = vectors.sparkSession.sparkContext.broadcast((base, rest, projection))

    def scan(batches):
        base, rest, projection = held.value
        total = np.zeros((size, size))
        for _, _, x in blocks(batches, dim):
            y = (x - base) - rest
            if projection is not None:
                y = y @ projection
            total += y.T @ y
        yield total.tobytes()

    got = summed(vectors, scan, lambda a, b: a + b, lambda raw: np.frombuffer(raw))
    return np.zeros((size, size)) if got is None else got.reshape(size, size)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of one array column; None if it holds no vector."""
    dim = length_of(vectors)
    if dim is None:
        return None
    n, sums = exact_sums(vectors, dim)
    model = Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    v = outer_sums(vectors, dim, model.base, model.rest) / n
    v = (v + v.T) / 2
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    some = np.flatnonzero(e > max(e[0], 0.0) * dim * np.finfo(float).eps)[:components]
    u = u[:, some]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(some))] < 0, -1.0, 1.0)  # one sign, whatever LAPACK gives
    return Whitening(n, sums, u, e[some], float(np.trace(v)))


def deviations(x: np.ndarray, n: int, base: np.ndarray, remainder: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S) ** 2 of each row, exact: n * x - S = n * (x - base) - S mod n."""
    y = x - base
    most = int(np.abs(y).max(initial=0))
    if (n * (most + 1)) ** 2 * x.shape[1] < 1 << 63:
        d = n * y - np.array(remainder, np.int64)
        return (d * d).sum(1).tolist()
    return [sum((n * a - r) ** 2 for a, r in zip(row, remainder, strict=True)) for row in y.tolist()]


def transform(table: DataFrame, model: Whitening, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, deviation, deviation_text, whitened: array of doubles) of each row that holds a vector of the model."""
    dim = len(model.sums)
    kept = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    held = table.sparkSession.sparkContext.broadcast((model.n, model.base, model.rest, [s % model.n for s in model.sums], model.projection))

    def run(batches):
        n, base, rest, remainder, projection = held.value
        for part, rows, x in blocks(batches, dim, 1):
            y = ((x - base) - rest) @ projection
            exact = deviations(x, n, base, remainder)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()), pa.array([str(d) for d in exact], pa.string()), values],
                ["vec_id", "deviation", "deviation_text", "whitened"],
            )

    return kept.mapInArrow(tidied(run), "vec_id long, deviation long, deviation_text string, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' measured covariance minus the identity; 0 without components."""
    k = len(model.variances)
    if not k:
        return 0.0
    got = outer_sums(vectors, len(model.sums), model.base, model.rest, model.projection) / model.n
    return float(np.abs(got - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = table.select(F.col(f"`{embedding}`").alias("embedding"))
    model = fit(vectors, components)
    if model is None or not len(model.variances):
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    shares = F.array(*(F.lit(float(e / model.total)) for e in model.variances))
    rows = transform(table, model, vec_id, embedding).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
