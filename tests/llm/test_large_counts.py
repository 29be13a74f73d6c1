"""Counts beyond 32 bits, and chains whose training rows are a cut sample."""

import numpy as np
import pyarrow as pa

from engram.llm import context_mixing, toxicity
from engram.llm.compression_quality import training_rows


def counts_of(spark, rows, code=None):
    states = spark.createDataFrame(rows, "n long, state int, word binary").repartition(3)
    code = code or (*context_mixing.huffman(context_mixing.count_symbols(states)), context_mixing.table_bits(1000))
    return code, np.concatenate(context_mixing.count_decisions(spark, states, code))


def test_a_word_of_five_billion_places_counts_as_such(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "Slots", lambda zeros, ones: (zeros.copy(), ones.copy()))
    words = [(b"the", 3), (b"then", 0), (b"house", 5), (b"x", 1)]
    times = [5, 3, 2, 1]
    code, small = counts_of(spark, [(n, s, bytearray(w)) for n, (w, s) in zip(times, words, strict=True)])
    scale = 10**9
    _, large = counts_of(spark, [(n * scale, s, bytearray(w)) for n, (w, s) in zip(times, words, strict=True)], code)
    assert small.sum() > 0 and np.allclose(large, small.astype(float) * scale, rtol=1e-6)
    # many rows whose sum alone passes 32 bits, in one task and over tasks
    _, parts = counts_of(spark, [(n * scale // 4, s, bytearray(w)) for n, (w, s) in zip(times, words, strict=True) for _ in range(4)], code)
    assert np.allclose(parts, large, rtol=1e-6)


def test_later_links_see_what_they_were_trained_on(spark):
    """With most rows sampled away the reported probabilities move, what links hand on does not."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels, sample=50)
    assert abs(chain.shift) > 0.3
    texts = [r.text for r in docs.where("doc_id < 60").select("text").collect()]
    words = np.unique(np.concatenate([link.words for link in chain.links]))
    (piece, h, d), *rest = list(toxicity.bags_of(pa.array(texts, pa.large_string()), words))
    assert not rest or sum(p.n for p, _, _ in [(piece, h, d), *rest]) == len(texts)
    bags = toxicity.Bags(d, h, piece.n)
    got = chain.predict(bags)
    for i in range(piece.n):  # by hand, one document at a time
        own, fed = set(bags.word[bags.doc == i].tolist()), []
        for k, link in enumerate(chain.links):
            x = sum(b for w, b in zip(link.words.tolist(), link.beta, strict=False) if w in own)
            x += sum(b * p for b, p in zip(link.beta[len(link.words) : -1], fed, strict=True)) + link.beta[-1]
            assert abs(got[i, k] - 1 / (1 + np.exp(-np.clip(x + chain.shift, -40, 40)))) < 1e-6
            fed.append(1 / (1 + np.exp(-np.clip(x, -40, 40))))
    rows, counts = training_rows(docs, labels, "toxic", 50, 10**6)
    assert len(rows) == 100 or min(counts.values()) < 50
