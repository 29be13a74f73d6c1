"""Compression classifier: text quality from the sizes two dictionaries compress it to.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled
bad. A text that a dictionary's corpus resembles compresses smaller with it, so the normalised
difference (c_bad - c_good) / (c_bad + c_good) of the compressed sizes tells them apart. Sizes are
taken without dictionary ids, checksums and content sizes, and without the fixed header.

Calibration is a logistic curve over the difference (Platt 1999). Its training figures are out of
fold: the sample is cut in FOLDS parts by a hash of the id, and each part is compressed with
dictionaries of the others, since a text in a dictionary's corpus compresses too well with it.
Evidence adds up over a text, so the curve has two terms: the difference, and the difference
times the logarithm of the text's size.

The training sample is bounded: at most SAMPLE labelled documents of each label, those with the
least seeded hash of the id among those that have a text of 1 to MAX_TRAIN_CHARS characters
(documented bounds of the fit alone; scoring reads every text whole). The curve's intercept is
moved by the logarithms of each label's share outside the sample, so that a score means the same
whether the bound is met or not. Labels, lang, source and doc_id are never inputs of a score.

Edge cases: a null or empty text has difference 0 and so the score of the curve there; a null
label or id trains nothing; where an id has several labels the least counts, where it has several
texts the least; with one label or none the score is that label's share, or 0.5; repeated rows are
each scored; a very long text is compressed whole, in memory of some three times its size; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import held_out, materialize, mix, table

SAMPLE = 3000
MAX_TRAIN_CHARS = 60_000
DICT_BYTES = 112_640
LEVEL = 3
FOLDS = 4
THRESHOLD = 0.7
SEED = 17


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICT_BYTES:]


class Compressor:
    def __init__(self, data: bytes):
        self.dict = zstandard.ZstdCompressionDict(data) if data else None
        if self.dict:
            self.dict.precompute_compress(level=LEVEL)
        self.c = zstandard.ZstdCompressor(level=LEVEL, dict_data=self.dict, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: bytes) -> int:
        return len(self.c.compress(text))


def differences(good: Compressor, bad: Compressor, texts: list[bytes]) -> np.ndarray:
    """Rows of (normalised difference, difference * log size), 0 for empty texts."""
    out = np.zeros((len(texts), 2))
    for i, x in enumerate(texts):
        if x:
            a, b = good.size(x), bad.size(x)
            d = (b - a) / (a + b)
            out[i] = d, d * np.log1p(len(x))
    return out


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression, by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(x)) if w is None else w
    beta = np.zeros(x1.shape[1])
    pen = np.full(x1.shape[1], ridge)
    pen[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        grad = x1.T @ (w * (y - p)) - pen * beta
        h = (x1 * (w * p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(pen)
        step = np.linalg.solve(h, grad)
        beta += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    scale: np.ndarray
    curve: np.ndarray
    constant: float | None = None
    _made: list = field(default_factory=list, repr=False)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not self._made:
            self._made += [Compressor(self.good), Compressor(self.bad)]
        x = differences(*self._made, texts) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "scale": self.scale, "curve": self.curve, "constant": self.constant, "_made": []}


def train(texts: list[bytes], labels: np.ndarray, folds: np.ndarray) -> QualityModel:
    """Dictionaries of all texts, and the curve from out-of-fold differences. labels: 1 good, 0 bad."""
    labels = np.asarray(labels)
    nothing = QualityModel(b"", b"", np.ones(2), np.zeros(3))
    if not len(labels) or len(set(labels.tolist())) < 2:
        nothing.constant = float(labels.mean()) if len(labels) else 0.5
        return nothing

    def pick(mask, label):
        return [t for t, m, y in zip(texts, mask, labels, strict=True) if m and y == label and t]

    x = np.zeros((len(texts), 2))
    for f in range(FOLDS):
        own = np.flatnonzero(folds == f)
        if len(own):
            pair = [Compressor(dictionary(pick(folds != f, y))) for y in (1, 0)]
            x[own] = differences(*pair, [texts[i] for i in own])
    scale = np.maximum(np.abs(x).std(axis=0), 1e-9)
    everything = np.ones(len(texts), bool)
    return QualityModel(dictionary(pick(everything, 1)), dictionary(pick(everything, 0)), scale, logistic(x / scale, labels))


class Training(NamedTuple):
    doc_id: int
    text: str
    label: int


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, max_chars: int) -> tuple[list[Training], dict[int, int]]:
    """At most `sample` rows (doc_id, text, label) of each value of label, by a seeded hash of the id; and how many there are of each."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    fitting = docs.where(F.length("text").between(1, max_chars))
    usable = materialize(docs.sparkSession, known.join(fitting.select("doc_id"), "doc_id", "left_semi"), "labelled")
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    rank = F.xxhash64(F.lit(SEED), "doc_id")
    # at most `sample` rows each, so the broadcast side has a proven bound
    picked = [usable.where(F.col("label") == y).orderBy(rank, "doc_id").limit(sample) for y in (0, 1)]
    rows = fitting.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    got = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).toArrow()
    return sorted(map(Training._make, zip(*(got.column(c).to_pylist() for c in Training._fields), strict=True))), counts


def prior_shift(counts: dict[int, int], labels: np.ndarray) -> float:
    """What a logistic model's intercept lacks where the labels' shares in the sample are not those of counts."""
    n1, n0 = int(np.sum(labels)), int(len(labels) - np.sum(labels))
    if not (n1 and n0 and counts.get(1) and counts.get(0)):
        return 0.0
    return float(np.log(counts[1] / n1) - np.log(counts[0] / n0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, max_chars: int = MAX_TRAIN_CHARS) -> QualityModel:
    """The model of labels(doc_id, <label>) and docs(doc_id, text)."""
    rows, counts = training_rows(docs, labels, label, sample, max_chars)
    folds = mix(np.array([r.doc_id for r in rows], np.int64).astype(np.uint64)) % np.uint64(FOLDS) if rows else np.zeros(0)
    y = np.array([r.label for r in rows])
    model = train([r.text.encode() for r in rows], y, folds.astype(int))
    model.curve[-1] += prior_shift(counts, y)
    return model


def score(spark: SparkSession, model: QualityModel):
    """Column function of (text): the calibrated score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(texts), 512):
            out.append(shared.value.scores([x or b"" for x in texts.slice(i, 512).cast(pa.binary()).to_pylist()]))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return scored


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out_of_reach = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs, labels.where(~out_of_reach))
    scored = docs.select("doc_id", out_of_reach.alias("held_out"), score(spark, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
