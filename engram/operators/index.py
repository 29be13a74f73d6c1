"""A stored nearest-neighbor index: inverted lists over trained centroids, probed several at a time, checked exactly.

Vectors are compared at unit length. Centroids come from spherical k-means over a sample of at most SAMPLE
vectors (fitting only: every vector is indexed). A list holds the vectors next to its centroid. A search
looks into the lists of the `probes` centroids next to the query; `probes` is measured when the index is built: for
sampled vectors and random directions at exactly the cosine that matters, it is the rank that
the vector's own list has from there in all but 1 - recall of the trials. Scores are exact inner products,
so what is found is right; only a neighbor in a list that is not probed is missed.

Searches join queries and list entries on (project, list) in blocks of some BLOCK_VALUES components on either side,
multiplied slice by slice; the blocks of a list are counted, so a list that holds a third of all rows is
spread over tasks. Equal vectors are one entry with the first ids of their class, so a group of copies
costs one entry, not the square of its rows.

A query is sent to each list that it probes, so what is shuffled grows with rows times probes, and what is multiplied
with rows times probes times rows a list. Few long lists need fewer probes: there are a quarter of the square root of the rows of them, up
to MOST_LISTS; beyond 16 * MOST_LISTS ** 2 rows lists grow with the table, and a second level of centroids would be due.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.operators.lineage import settle
from engram.settings import DEFAULTS

SAMPLE = 1 << 16
MOST_LISTS = 4096
#: Components of the vectors of one block, so a block's memory is the same whatever their width; every row goes to as many tasks as the other side has blocks.
BLOCK_VALUES = 1 << 21
#: Tables of fewer rows have blocks of these, up to FEW_BLOCKS, for the sake of more tasks.
BLOCK_ROWS = 2048
FEW_BLOCKS = 8
#: Rows of the left and of the right of one matrix product, and pairs scored exactly at a time.
SLICES = (256, 2048)
EXACT_PAIRS = 1 << 14
ROUNDS = 8


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows; nulls within are 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.nan_to_num(flat).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; rows of norm below 1e-10 are 0."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1e-10, 0.0, x / np.maximum(n, 1e-10))


def trained(sample: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Unit centroids by spherical k-means; a centroid without vectors starts anew at one."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(sample, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        empty = np.linalg.norm(total, axis=1) < 1e-10
        total[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        c = units(total)
    return c


def nearest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k centroids next to each row, the nearest first."""
    out = []
    for low in range(0, len(x), 4096):
        near = -(x[low : low + 4096] @ centroids.T)
        best = np.argpartition(near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(near, best, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(best, order, 1))
    return np.concatenate(out) if out else np.zeros((0, min(k, len(centroids))), np.int64)


def probes_for(sample: np.ndarray, centroids: np.ndarray, cosine: float, recall: float, seed: int = 12) -> int:
    """How many lists a search has to probe for vectors at a cosine to be found with a probability of recall."""
    rng = np.random.default_rng(seed)
    b = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
    own = nearest(b, centroids, 1)[:, 0]
    away = rng.standard_normal(b.shape)
    away = units(away - (away * b).sum(1, keepdims=True) * b)
    near = units(cosine * b + np.sqrt(1 - cosine**2) * away) @ centroids.T
    rank = (near > near[np.arange(len(b)), own][:, None]).sum(1)
    return int(np.quantile(rank, recall, method="higher")) + 1


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms, summed in the order of the components."""
    return np.sqrt((x * x).cumsum(axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x))


def copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and each row's number among these."""
    flat = np.ascontiguousarray(x)
    _, first, own = np.unique(flat.view(np.dtype((np.void, max(1, flat.itemsize * flat.shape[1])))).ravel(), return_index=True, return_inverse=True)
    return first, own.ravel()


def first_copies(x: np.ndarray, most: int) -> np.ndarray:
    """Places of rows, of equal ones the first `most`: of those a list of `most` can hold no more."""
    _, own = copies(x)
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], own[order])
    return np.sort(order[np.arange(len(x)) - starts < most])


def places(near: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is at or above its row's least."""
    return np.divmod(np.flatnonzero(near >= least[:, None]), near.shape[1])


def best_pairs(x: np.ndarray, y: np.ndarray, threshold: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine): of each row of x the `top` best of y at or above the threshold, ties by place in y.

    Exact: products in single precision only leave out what cannot be among the best, by a bound on their
    error; what they leave is scored in double precision, one sum a pair, so that equal pairs have equal scores. Memory is
    that of a few SLICES, whatever the lengths of x and y are. Copies on the left are asked once.
    """
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    asked, own = copies(x)
    kept = first_copies(y, top)
    x, y = x[asked], y[kept]
    nx, ny = lengths(x), lengths(y)
    ux, uy = units(x), units(y)
    sx, sy = ux.astype(np.float32), uy.astype(np.float32)
    rough, fine = (x.shape[1] + 8) * 1.2e-7, (x.shape[1] + 8) * 2.3e-16

    def scored(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for low in range(0, len(rows), EXACT_PAIRS):
            r, c = rows[low : low + EXACT_PAIRS], cols[low : low + EXACT_PAIRS]
            blank = (nx[r] < 1e-10) | (ny[c] < 1e-10)
            out[low : low + EXACT_PAIRS] = np.where(blank, 0.0, (x[r] * y[c]).cumsum(axis=1)[:, -1] / np.where(blank, 1.0, nx[r] * ny[c]))
        return out

    def likely(near: np.ndarray, least: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Places at or above least and not surely below the top best of their row."""
        if near.shape[1] > top:
            least = np.maximum(least, np.partition(near, near.shape[1] - top, axis=1)[:, near.shape[1] - top] - 2 * slack)
        return places(near, least)

    found = []
    for a in range(0, len(x), SLICES[0]):
        n = min(SLICES[0], len(x) - a)
        least = np.full(n, threshold)  # what a score must have to matter
        full = np.zeros(n, bool)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # row, column, score: by row, the best first
        ends = [*range(SLICES[1], len(y), SLICES[1]), len(y)]
        ends = [max(512, 4 * top), *ends] if len(y) > SLICES[1] > max(512, 4 * top) else ends  # a short one first, to have a bound
        for low, high in zip([0, *ends], ends, strict=False):
            near = sx[a : a + n] @ sy[low:high].T
            hit = np.flatnonzero(near.max(axis=1) >= least - rough)
            if not len(hit):
                continue
            near = near[hit]
            some = places(near, least[hit] - rough) if full[hit].all() else likely(near, least[hit] - rough, rough)
            if len(some[0]) > 4 * (top + 16) * len(hit):  # near copies, too close for single precision
                parts = []
                for i in range(0, len(hit), 256):
                    r, c = likely(ux[a + hit[i : i + 256]] @ uy[low:high].T, least[hit[i : i + 256]] - fine, fine)
                    parts.append((r + i, c))
                some = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
            rows, cols = hit[some[0]], some[1] + low
            score = scored(rows + a, cols)
            good = score >= threshold
            rows, cols, score = (np.concatenate(p) for p in zip(held, (rows[good], cols[good], score[good]), strict=True))
            by = np.lexsort((cols, -score, rows))
            rows, cols, score = rows[by], cols[by], score[by]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            last = place == top - 1
            least[rows[last]], full[rows[last]] = score[last], True
            held = rows[place < top], cols[place < top], score[place < top]
        found.append((held[0] + a, held[1], held[2]))
    rows, cols, score = (np.concatenate(p) for p in zip(*found, strict=True))
    # each copy on the left has the same list
    starts = np.searchsorted(rows, np.arange(len(x) + 1))
    size = np.diff(starts)[own]
    take = np.repeat(starts[:-1][own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return np.repeat(np.arange(len(own)), size), kept[cols[take]], score[take]


def blocks(n: Column, width: Column) -> Column:
    """In how many blocks n rows lie: of BLOCK_VALUES components each, or, where those are few, of BLOCK_ROWS rows up to FEW_BLOCKS."""
    return F.greatest(F.ceil(n * F.greatest(width, F.lit(1)) / BLOCK_VALUES), F.least(F.lit(FEW_BLOCKS), F.ceil(n / BLOCK_ROWS)), F.lit(1)).cast("long")


def block_scores(left: DataFrame, right: DataFrame, threshold: float, top: int, one_cell: bool = False) -> DataFrame:
    """(project, source_id, target_id, score) of left(project, cell, source_id, u) and right(project, cell, target_id, u) in equal cells.

    Scores at or above the threshold, of each source the `top` best of each block (ties by target_id).
    one_cell: all rows are of one project and cell, so their numbers are two counts and no join.
    """
    counts = F.count("*"), F.coalesce(F.max(F.size("u")), F.lit(1))

    if one_cell:
        n = [blocks(*map(F.lit, rows.agg(*counts).first())) for rows in (left, right)]
        sized = lambda rows: rows.withColumns({"lefts": n[0], "rights": n[1]})
    else:
        of_cells = lambda rows, name: rows.groupBy("project", "cell").agg(blocks(*counts).alias(name))
        sizes = settle(of_cells(left, "lefts").join(of_cells(right, "rights"), ["project", "cell"]))
        sized = lambda rows: rows.join(sizes, ["project", "cell"])
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = sized(left).withColumn("lb", place("source_id", "lefts")).withColumn("rb", every("rights"))
    b = sized(right).withColumn("rb", place("target_id", "rights")).withColumn("lb", every("lefts"))
    key = ["project", "cell", "lb", "rb"]
    kinds = dict(left.dtypes) | dict(right.dtypes)

    def score(one: pa.Table, two: pa.Table) -> pa.Table:
        if len(two):  # by id, so that ties are in order of ids
            two = two.take(pc.sort_indices(two, [("target_id", "ascending")]))
        rows, cols, near = best_pairs(matrix(one["u"]), matrix(two["v"]), threshold, top)
        return pa.table({"project": one["project"].take(pa.array(rows)), "source_id": one["source_id"].take(pa.array(rows)), "target_id": two["target_id"].take(pa.array(cols)), "score": pa.array(near)})

    schema = f"project {kinds['project']}, source_id {kinds['source_id']}, target_id {kinds['target_id']}, score double"
    # new names on the right: both sides may come from one table
    b = b.select(*(F.col(c).alias(f"{c}_") for c in key), F.col("target_id").alias("target_id"), F.col("u").alias("v"))
    return a.select(*key, "source_id", "u").groupBy(*key).cogroup(b.groupBy(*(f"{c}_" for c in key))).applyInArrow(score, schema)


def scaled(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and u, the embedding as it is stored: tasks scale it, so that no wider type is shuffled."""
    return rows.where("embedding is not null").select(*keep, F.col("embedding").alias("u"))


@dataclass
class VectorIndex:
    """Lists over centroids. entries: (project, cell, memory_id, ids, u), an entry a distinct vector u of a project; ids: the first of its rows."""

    centroids: np.ndarray
    probes: int
    cosine: float
    entries: DataFrame
    ids_kept: int

    @staticmethod
    def build(vectors: DataFrame, cosine: float = DEFAULTS.similar_threshold, recall: float = 0.97, lists: int | None = None, ids_kept: int = DEFAULTS.similar_pool + 1, sample: int = SAMPLE) -> VectorIndex | None:
        """The index of vectors(memory_id, project, embedding) for searches of neighbors at a cosine or more; None without vectors."""
        n = vectors.where("embedding is not null").count()
        if not n:
            return None
        lists = lists or max(1, min(MOST_LISTS, round(n**0.5 / 4)))
        # a bounded number of rows for fitting, by hash
        some = vectors.where("embedding is not null").select("embedding").where(F.pmod(F.xxhash64("memory_id", F.lit(5)), F.lit(max(1, n // sample))) == 0).limit(sample)
        x = units(matrix(some.toArrow()["embedding"]))
        if not len(x):
            x = units(matrix(vectors.where("embedding is not null").select("embedding").limit(1).toArrow()["embedding"]))
        centroids = trained(x, lists)
        index = VectorIndex(centroids, probes_for(x, centroids, cosine, recall), cosine, vectors, ids_kept)
        index.entries = index.filed(vectors)
        return index

    def celled(self, rows: DataFrame, keep: list[str], probes: int) -> DataFrame:
        """rows(*keep, u) with cell, a row for each of the probed lists."""
        kinds, held = dict(rows.dtypes), rows.sparkSession.sparkContext.broadcast(self.centroids)  # at most MOST_LISTS vectors

        def run(batches):
            for batch in batches:
                cells = nearest(units(matrix(batch.column(0))), held.value, probes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], batch.column(0), lists], [*keep, "u", "cells"])

        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"u {kinds['u']}", "cells array<int>"])
        return rows.select("u", *keep).mapInArrow(run, schema).withColumn("cell", F.explode("cells")).drop("cells")

    def filed(self, vectors: DataFrame) -> DataFrame:
        """The entries of vectors: equal vectors of a project are one, under its least id, with its first ids_kept ids."""
        nth = F.row_number().over(W.partitionBy("project", "embedding").orderBy("memory_id"))
        firsts = vectors.where("embedding is not null").select("project", "embedding", "memory_id").withColumn("nth", nth).where(F.col("nth") <= self.ids_kept)
        one = firsts.groupBy("project", "embedding").agg(F.array_sort(F.collect_list("memory_id")).alias("ids"), F.min("memory_id").alias("memory_id"))
        return settle(self.celled(scaled(one, ["project", "memory_id", "ids"]), ["project", "memory_id", "ids"], 1))

    def save(self, path: str) -> None:
        """Write the index to a folder; lists lie in ranges, so a search for some of them skips files."""
        spark = self.entries.sparkSession
        rows = [(i, c.tolist(), self.probes, self.cosine, self.ids_kept) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, probes int, cosine double, ids_kept int").coalesce(1).write.parquet(f"{path}/centroids")
        self.entries.repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{path}/entries")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most MOST_LISTS
        return VectorIndex(np.array([r.centroid for r in rows]), rows[0].probes, rows[0].cosine, spark.read.parquet(f"{path}/entries"), rows[0].ids_kept)

    def add(self, path: str, vectors: DataFrame) -> VectorIndex:
        """File new vectors in a saved index; what is written grows with them alone. Copies of stored vectors become entries of their own."""
        self.filed(vectors).repartitionByRange("cell").sortWithinPartitions("cell").write.mode("append").parquet(f"{path}/entries")
        return VectorIndex.load(vectors.sparkSession, path)

    def search(self, asked: DataFrame, threshold: float | None = None, top: int = DEFAULTS.similar_top) -> DataFrame:
        """(project, source_id, target_id, score, rank): of each row of asked(memory_id, project, embedding) its nearest others in its project."""
        threshold = self.cosine if threshold is None else threshold
        nth = F.min("memory_id").over(W.partitionBy("project", "embedding"))
        rows = settle(asked.where("embedding is not null").select("project", "memory_id", "embedding").withColumn("class", nth))
        classes = rows.where("memory_id = class").select("project", F.col("class").alias("source_id"), "embedding")
        left = self.celled(scaled(classes, ["project", "source_id"]), ["project", "source_id"], min(self.probes, len(self.centroids)))
        right = self.entries.select("project", "cell", F.col("memory_id").alias("target_id"), "u")
        met = block_scores(left, right, threshold, top + 1).join(self.entries.select("project", F.col("memory_id").alias("target_id"), "ids"), ["project", "target_id"])
        order = (F.desc("score"), F.col("target_id"))
        each = met.select("project", "source_id", "score", F.explode("ids").alias("target_id")).distinct()
        best = each.withColumn("n", F.row_number().over(W.partitionBy("project", "source_id").orderBy(*order))).where(F.col("n") <= top + 1)
        found = best.groupBy("project", "source_id").agg(F.array_sort(F.collect_list(F.struct("n", "score", "target_id"))).alias("best"))
        out = rows.select("project", F.col("class").alias("source_id"), "memory_id").join(found, ["project", "source_id"])
        own = F.filter("best", lambda b: b["target_id"] != F.col("memory_id"))
        out = out.select("project", F.col("memory_id").alias("source_id"), F.posexplode(F.slice(own, 1, top)).alias("at", "b"))
        return out.select("project", "source_id", F.col("b.target_id").alias("target_id"), F.col("b.score").alias("score"), (F.col("at") + 1).alias("rank"))
