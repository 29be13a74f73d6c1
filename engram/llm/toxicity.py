"""Toxicity: a classifier chain over categories, each link a linear model that sees the links before it.

Categories are predicted in a fixed order. A link's inputs are the text's words (chosen by the
log-likelihood ratio of their documents in and outside the category, Dunning 1993) and the probabilities of all earlier categories. Later links are trained on out-of-fold
probabilities of the earlier ones: the sample is cut in FOLDS parts by a hash of the text, and each
part's probabilities come from links trained on the other parts, words chosen there as well
(Read et al. 2011, Senge et al. 2013). Scoring uses links trained on the whole sample.

Labels give one category, toxic. The categories before it are learned from the sample: the words
that tell toxic documents best (at most GROUP_WORDS) are cut into GROUPS groups by the toxic
documents that they share (spectral clustering), and a toxic document is of a category if it has
a word of its group. The groups only label the training sample; scoring knows each link's weights
alone. The chain's last link, toxic, is the score.

The training sample is bounded: at most SAMPLE labelled documents of each label, those with the
least seeded hash of the id among those that have a text of 1 to MAX_TRAIN_CHARS characters; equal
texts count once. The intercepts are corrected for the labels' shares outside the sample. Scoring
reads every text whole.

Edge cases: a null or empty text has no words and gets the intercepts' probabilities; labels that
are null or not 0/1, and labels without an id, train nothing; where an id has several labels the
least counts, where it has several texts the least; a category that the sample lacks has
probability 0 (or 1 if it has nothing else, 0.0 without any labels); repeated rows are each scored;
a text longer than a piece takes some 60 bytes of a worker's memory a byte; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import ALNUM_WORD, LOWER, U64, pieces, table
from engram.llm.compression_quality import logistic, prior_shift, training_rows
from engram.llm.license_scan import word_hashes

#: Categories learned before the last.
GROUPS = 2
GROUP_WORDS = 64
CHAIN = [*(f"group_{i + 1}" for i in range(GROUPS)), "toxic"]

SAMPLE = 2000
MAX_TRAIN_CHARS = 60_000
FOLDS = 4
MAX_WORDS = 600
#: Least log-likelihood ratio of a word, and least number of the category's documents that have it.
MIN_G = 15.0
MIN_DOCS = 4
RIDGE = 0.03
#: A document is toxic from this probability on: at sf0.1 it flags 2 of 870 held-out documents that are not.
THRESHOLD = 0.3


@dataclass
class Link:
    """Words (sorted hashes) and weights: words, earlier categories, intercept."""

    words: np.ndarray
    beta: np.ndarray

    def logits(self, counts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.column_stack([counts, earlier]) @ self.beta[:-1] + self.beta[-1]


class Bags:
    """Distinct words of documents: two parallel arrays, by document."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, n_docs: int):
        order = np.lexsort((word, doc))
        doc, word = doc[order], word[order]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
        self.doc, self.word, self.n_docs = doc[head], word[head], n_docs

    def matrix(self, words: np.ndarray) -> np.ndarray:
        """1 for each given word (sorted hashes) that a document has."""
        out = np.zeros((self.n_docs, len(words)), np.float32)
        if len(words):
            col = np.minimum(np.searchsorted(words, self.word), len(words) - 1)
            hit = words[col] == self.word
            out[self.doc[hit], col[hit]] = 1
        return out


def pick_words(bags: Bags, y: np.ndarray, rows: np.ndarray, most: int = MAX_WORDS) -> np.ndarray:
    """Hashes of the words that documents of a category have markedly more often."""
    use = rows[bags.doc]
    words, at = np.unique(bags.word[use], return_inverse=True)
    yes = np.bincount(at, y[bags.doc[use]], len(words))
    no = np.bincount(at, minlength=len(words)) - yes
    n1, n0 = y[rows].sum(), (1 - y[rows]).sum()
    out = np.zeros(len(words))
    for part, whole in ((yes, n1), (no, n0)):
        expected = (yes + no) * whole / max(n1 + n0, 1)
        for seen, e in ((part, expected), (whole - part, whole - expected)):
            out += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(e, 1e-12))
    good = np.flatnonzero((out >= MIN_G) & (yes >= MIN_DOCS) & (yes * n0 > no * n1))
    return np.sort(words[good[np.argsort(-out[good], kind="stable")][:most]])


def word_groups(bags: Bags, toxic: np.ndarray) -> list[np.ndarray]:
    """GROUPS groups of the words (hashes) that tell toxic documents best, by the toxic documents that they share."""
    words = pick_words(bags, toxic.astype(float), np.ones(bags.n_docs, bool), GROUP_WORDS)
    if not GROUPS:  # a single model, for comparison
        return []
    if len(words) < GROUPS:
        return [words[i : i + 1] for i in range(GROUPS)]
    there = bags.matrix(words)[toxic == 1].astype(float)
    both = there.T @ there
    scale = 1 / np.sqrt(np.maximum(both.diagonal(), 1))
    _, vectors = np.linalg.eigh(both * scale[:, None] * scale[None, :])
    # the second eigenvector orders the words; its sign is that of its first part, and groups are of equal size
    line = vectors[:, -2] * (1 if vectors[0, -2] >= 0 else -1) if len(words) > 1 else np.zeros(1)
    return [np.sort(words[part]) for part in np.array_split(np.argsort(line, kind="stable"), GROUPS)]


def fit_link(bags: Bags, y: np.ndarray, earlier: np.ndarray, rows: np.ndarray) -> Link:
    share = y[rows].mean() if rows.any() else 0.0
    if share in (0.0, 1.0):
        return Link(np.zeros(0, U64), np.append(np.zeros(earlier.shape[1]), 40.0 if share else -40.0))
    words = pick_words(bags, y, rows)
    return Link(words, logistic(np.column_stack([bags.matrix(words), earlier])[rows], y[rows], ridge=RIDGE))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Chain:
    names: list[str]
    links: list[Link]
    #: What is added to a category's logit where it is reported; later links get the probability without it, as in training.
    shift: float = 0.0

    @staticmethod
    def fit(bags: Bags, labels: np.ndarray, folds: np.ndarray, names: list[str]) -> "Chain":
        """labels: one 0/1 column a category, in the chain's order."""
        earlier, links = np.zeros((bags.n_docs, 0)), []
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            links.append(fit_link(bags, y, earlier, np.ones(bags.n_docs, bool)))
            if k + 1 < labels.shape[1]:
                p = np.zeros(bags.n_docs)
                for f in range(FOLDS):
                    link = fit_link(bags, y, earlier, folds != f)
                    own = folds == f
                    p[own] = sigmoid(link.logits(bags.matrix(link.words), earlier))[own]
                earlier = np.column_stack([earlier, p])
        return Chain(names, links)

    def predict(self, bags: Bags) -> np.ndarray:
        earlier, out = np.zeros((bags.n_docs, 0)), []
        for link in self.links:
            logits = link.logits(bags.matrix(link.words), earlier)
            out.append(sigmoid(logits + self.shift))
            earlier = np.column_stack([earlier, sigmoid(logits)])
        return np.column_stack(out)


def bags_of(texts: pa.Array, words: np.ndarray | None = None):
    """Bags of each piece of the texts; of the given words (sorted hashes) only, if any are given."""
    for p in pieces(texts):
        w = p.words(ALNUM_WORD, LOWER[p.data])
        h, doc = w.hashes(), w.doc()
        if words is not None:
            hit = words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h if len(words) else np.zeros(len(h), bool)
            h, doc = h[hit], doc[hit]
        yield p, h, doc


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, max_chars: int = MAX_TRAIN_CHARS) -> Chain:
    """The chain from docs(doc_id, text) and labels(doc_id, <label>)."""
    texts: dict[str, int] = {}
    rows, counts = training_rows(docs, labels, label, sample, max_chars)
    for r in rows:
        texts.setdefault(r.text, r.label)
    if not texts:
        return Chain(CHAIN, [Link(np.zeros(0, U64), np.append(np.zeros(i), -40.0)) for i in range(len(CHAIN))])
    toxic = np.array(list(texts.values()))
    doc, word = [], []
    for p, h, d in bags_of(pa.array(list(texts), pa.large_string())):
        part = Bags(d + p.first, h, len(texts))
        doc.append(part.doc.astype(np.int32))
        word.append(part.word)
    doc, word = np.concatenate(doc), np.concatenate(word)
    # words of fewer documents can be picked by no fold
    order = np.argsort(word, kind="stable")
    doc, word = doc[order], word[order]
    head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    size = np.diff(np.append(head, len(word)))
    many = np.repeat(size >= MIN_DOCS, size)
    bags = Bags(doc[many], word[many], len(texts))
    y = np.zeros((len(texts), len(CHAIN)), int)
    for k, group in enumerate(word_groups(bags, toxic)):
        y[np.unique(bags.doc[np.isin(bags.word, group)]), k] = 1
        y[:, k] &= toxic
    y[:, -1] = toxic
    folds = (word_hashes(list(texts)) % U64(FOLDS)).astype(int)
    chain = Chain.fit(bags, y, folds, CHAIN)
    chain.shift = prior_shift(counts, toxic)
    return chain


def score(spark: SparkSession, chain: Chain):
    """Column function of (text): a struct of each category's probability."""
    shared = spark.sparkContext.broadcast(chain)
    fields = [f"p_{n}" for n in chain.names]

    @F.arrow_udf(", ".join(f"{n} double" for n in fields))
    def scored(texts: pa.Array) -> pa.Array:
        model = shared.value
        words = np.unique(np.concatenate([x.words for x in model.links]))
        parts = [model.predict(Bags(d, h, p.n)) for p, h, d in bags_of(texts, words)]
        out = np.concatenate(parts) if parts else np.zeros((0, len(fields)))
        return pa.StructArray.from_arrays([pa.array(c) for c in out.T], fields)

    return scored


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", score(spark, chain)("text").alias("s")).select("doc_id", "s.*")
    return out.withColumn("score", F.col("p_toxic")).withColumn("toxic", (F.col("score") >= THRESHOLD).cast("int"))
