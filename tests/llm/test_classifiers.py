"""The compression classifier and the classifier chain against models that are fitted naively, with and without a bound on the sample."""

import math
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from engram.llm import common, compression_quality, license_scan, toxicity

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def logistic(x, y, ridge):
    """Weights (last: intercept) where the gradient of the penalised loss is 0, row by row."""
    n = len(x[0]) + 1
    beta = [0.0] * n
    for _ in range(200):
        grad, h = [-(ridge if j < n - 1 else 1e-9) * beta[j] for j in range(n)], np.diag([ridge] * (n - 1) + [1e-9])
        for row, label in zip(x, y, strict=True):
            r = [*row, 1.0]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(r, beta, strict=True))))
            grad = [g + (label - p) * v for g, v in zip(grad, r, strict=True)]
            h = h + p * (1 - p) * np.outer(r, r)
        step = np.linalg.solve(h, grad)
        beta = [b + float(np.clip(s, -2, 2)) for b, s in zip(beta, step, strict=True)]
        if max(map(abs, grad)) < 1e-9:
            return beta
    raise AssertionError("no optimum")


def probability(x, beta, shift=0.0):
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip([*x, 1.0], beta, strict=True)) + shift)))


def sampled(spark, labels, sample):
    """Ids of the training rows: the least seeded hashes of each label."""
    df = spark.createDataFrame([(i,) for i in labels], "doc_id long")
    rank = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()}
    out = []
    for y in (0, 1):
        out += sorted((i for i in labels if labels[i] == y), key=lambda i: (rank[i], i))[:sample]
    return sorted(out)


def shift_of(labels, ids):
    n = [sum(labels[i] == y for i in ids) for y in (0, 1)]
    every = [sum(v == y for v in labels.values()) for y in (0, 1)]
    return math.log(every[1] / n[1]) - math.log(every[0] / n[0])


@pytest.mark.parametrize("sample", [3000, 25])
def test_compression_scores_match_a_naive_model(spark, sample):
    rng = random.Random(4)
    good = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(150)]
    bad = ["".join(rng.choice("xzqwk0123#$") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    texts, labels = {}, {}
    for i in range(90):
        y = int(i % 3 > 0)
        share = rng.random() * 0.5
        texts[i], labels[i] = " ".join(rng.choice(good if (rng.random() > share) == bool(y) else bad) for _ in range(rng.randint(40, 120))), y
    ids = sampled(spark, labels, sample)

    def build(chosen, y):
        try:
            return zstandard.train_dictionary(compression_quality.DICT_BYTES, [texts[i].encode() for i in chosen if labels[i] == y]).as_bytes()
        except zstandard.ZstdError:
            return b"".join(texts[i].encode() for i in chosen if labels[i] == y)[-compression_quality.DICT_BYTES :]

    def size(data, text):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=3)
        return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text))

    def inputs(pair, text):
        if not text:
            return [0.0, 0.0]
        a, b = size(pair[0], text), size(pair[1], text)
        d = (b - a) / (a + b)
        return [d, d * math.log(1 + len(text))]

    fold = {i: int(common.mix(np.array([i], np.uint64))[0]) % 4 for i in ids}
    x = []
    for i in ids:  # dictionaries of the documents of the other folds
        rest = [j for j in ids if fold[j] != fold[i]]
        x.append(inputs((build(rest, 1), build(rest, 0)), texts[i].encode()))
    # inputs are measured in deviations of their sizes, which only the ridge sees
    size_of = [[abs(r[k]) for r in x] for k in range(2)]
    scale = [math.sqrt(sum((v - sum(c) / len(c)) ** 2 for v in c) / len(c)) for c in size_of]
    beta = logistic([[r[0] / scale[0], r[1] / scale[1]] for r in x], [labels[i] for i in ids], 1e-3)
    whole = (build(ids, 1), build(ids, 0))
    texts |= {900: "", 901: "unlike x9# all", 902: " ".join(good * 20)}
    want = {i: probability([v / s for v, s in zip(inputs(whole, t.encode()), scale, strict=True)], beta, shift_of(labels, ids)) for i, t in texts.items()}
    docs = spark.createDataFrame([*texts.items(), (903, None)], "doc_id long, text string").repartition(3)
    model = compression_quality.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), sample=sample)
    got = {r.doc_id: r.s for r in docs.select("doc_id", compression_quality.score(spark, model)("text").alias("s")).collect()}
    want[903] = want[900]
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)
    assert max(want.values()) > 0.9 and min(want.values()) < 0.1


@pytest.mark.parametrize("sample", [2000, 50])
def test_chain_matches_a_naive_chain(spark, sample):
    rng = random.Random(9)
    plain = ["".join(rng.choice("mnprst") + rng.choice("aeo") for _ in range(2)) for _ in range(60)]
    rude = [[f"rude{g}{k}" for k in "abcd"] for g in range(2)]
    texts, labels = {}, {}
    for i in range(200):
        y = int(i % 3 == 0)
        w = [rng.choice(plain) for _ in range(rng.randint(10, 30))]
        if y:
            w += rng.sample(rude[i % 2], 3) + ([rng.choice(rude[1 - i % 2])] if rng.random() < 0.2 else [])
        elif rng.random() < 0.1:
            w.append(rng.choice(rude[i % 2]))
        rng.shuffle(w)
        texts[i], labels[i] = " ".join(w).capitalize(), y
    texts[200], labels[200] = texts[7], labels[7]  # an equal text counts once
    ids = sampled(spark, labels, sample)
    train = {}
    for i in ids:
        train.setdefault(texts[i], labels[i])
    order, toxic = list(train), list(train.values())
    number = lambda t: int(license_scan.word_hashes([t])[0])
    sets = [set(TOKEN.findall(lower(t))) for t in order]
    fold = [number(t) % 4 for t in order]

    def pick(rows, y, most):
        n1 = sum(y[r] for r in rows)
        n0, found = len(rows) - n1, []
        for w in set().union(*(sets[r] for r in rows)):
            a = sum(y[r] for r in rows if w in sets[r])
            b = sum(1 - y[r] for r in rows if w in sets[r])
            cells = [(a, (a + b) * n1 / len(rows)), (n1 - a, n1 - (a + b) * n1 / len(rows)), (b, (a + b) * n0 / len(rows)), (n0 - b, n0 - (a + b) * n0 / len(rows))]
            g = sum(2 * seen * math.log(max(seen, 1e-12) / max(e, 1e-12)) for seen, e in cells)
            if g >= toxicity.MIN_G and a >= toxicity.MIN_DOCS and a * n0 > b * n1:
                found.append((-g, number(w), w))
        return [w for _, _, w in sorted(sorted(found)[:most], key=lambda f: f[1])]

    # categories: the telling words, ordered along the second eigenvector of what they share, in two halves
    telling = pick(range(len(order)), toxic, toxicity.GROUP_WORDS)
    both = np.array([[sum(t and a in s and b in s for s, t in zip(sets, toxic, strict=True)) for b in telling] for a in telling], float)
    scaled = both / np.sqrt(np.maximum(np.diag(both), 1))[:, None] / np.sqrt(np.maximum(np.diag(both), 1))[None, :]
    line = np.linalg.eigh(scaled)[1][:, -2]
    line = line if line[0] >= 0 else -line
    ranked = [telling[i] for i in np.argsort(line, kind="stable")]
    half = (len(ranked) + 1) // 2
    groups = [set(ranked[:half]), set(ranked[half:])]
    assert {frozenset(g & set(telling)) for g in map(set, rude)} == {frozenset(g) for g in groups}
    columns = [[int(t and bool(s & g)) for s, t in zip(sets, toxic, strict=True)] for g in groups] + [toxic]

    def link(rows, y, earlier):
        w = pick(rows, y, toxicity.MAX_WORDS)
        x = [[float(v in sets[r]) for v in w] + earlier[r] for r in rows]
        return w, logistic(x, [y[r] for r in rows], toxicity.RIDGE)

    earlier, links = [[] for _ in order], []
    for y in columns:
        links.append(link(list(range(len(order))), y, earlier))
        p = {}
        for f in range(4):
            w, beta = link([r for r in range(len(order)) if fold[r] != f], y, earlier)
            p |= {r: probability([float(v in sets[r]) for v in w] + earlier[r], beta) for r in range(len(order)) if fold[r] == f}
        earlier = [[*e, p[r]] for r, e in enumerate(earlier)]

    def chain(text, shift):
        own, before, out = set(TOKEN.findall(lower(text))), [], []
        for w, beta in links:
            x = [float(v in own) for v in w] + before
            out.append(probability(x, beta, shift))
            before = [*before, probability(x, beta)]
        return out

    n = [toxic.count(y) for y in (0, 1)]
    every = [sum(v == y for v in labels.values()) for y in (0, 1)]
    shift = math.log(every[1] / n[1]) - math.log(every[0] / n[0])
    assert sample > 200 or abs(shift) > 0.3
    texts |= {900: "", 901: "RUDE0A rude1b! rude0c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), sample=sample)
    got = {r.doc_id: list(r.s) for r in docs.select("doc_id", toxicity.score(spark, model)("text").alias("s")).collect()}
    for i, t in texts.items():
        assert got[i] == pytest.approx(chain(t, shift), abs=1e-5)
    assert got[901][2] > 0.9 and got[900][2] < 0.1
