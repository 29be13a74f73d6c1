"""Whitening, collocations and packing against brute force, with odd rows and empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from engram.llm import collocations, packing, whitening

# ---------------------------------------------------------------- whitening

ODD = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 0.0, 1.0]), (903, [0.0, float("inf"), 1.0]), (904, []), (905, [1.0, 2.0]), (906, [3e38, 0.0, 0.0]), (907, [-3e38, 1.0, 1.0])]
VECTORS = "vec_id long, embedding array<float>, n long, component string"


def vectors_table(spark, vectors, more=()):
    rows = [(i, [float(x) for x in v], 7, "x") for i, v in enumerate(vectors)] + [(i, v, 7, None) for i, v in more]
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(object).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return ((n * x - s) ** 2).sum(1), y @ u[:, ::-1][:, :k] / np.sqrt(e[::-1][:k]), e[::-1][:k] / np.trace(v)


@pytest.mark.parametrize("dim, k", [(3, 2), (3, 32)])
def test_whitening_matches_brute_force(spark, dim, k):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, dim)) * [5, 2, 0.7][:dim] + [40, -9, 0][:dim]
    vectors[50:90] = vectors[50]  # repeated vectors
    got = whitening.whiten(vectors_table(spark, vectors, ODD), k).collect()
    dev, white, share = brute_whitening(vectors, min(k, dim))
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c + 1) for i in range(300) for c in range(min(k, dim)))
    assert {r.n for r in got} == {300}
    assert all(r.deviation == dev[r.vec_id] for r in got)
    for c in range(min(k, dim)):
        mine = np.array([r.whitened for r in sorted((r for r in got if r.component == c + 1), key=lambda r: r.vec_id)])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(mine - sign * white[:, c]).max() < 1e-9
        assert all(math.isclose(r.explained, share[c], rel_tol=1e-9) for r in got if r.component == c + 1)
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_without_variance(spark):
    """Fewer vectors than dimensions have fewer components; equal ones and empty tables none."""
    flat = whitening.whiten(vectors_table(spark, [[1.0, 2.0, 3.0], [2.0, 2.0, 3.0], [4.0, 4.0, 3.0]])).collect()
    assert {r.component for r in flat} == {1, 2} and len(flat) == 6 and flat[0].identity_error < 1e-9
    assert whitening.whiten(vectors_table(spark, [[1.0, 2.0]] * 9)).count() == 0
    assert whitening.whiten(vectors_table(spark, [], ODD[:5])).count() == 0
    assert whitening.whiten(vectors_table(spark, [])).count() == 0
    assert whitening.whiten(vectors_table(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_sums_beyond_64_bits_are_exact(spark):
    big = [[2.0**49 * (i + 1), float(i)] for i in range(40)]
    table = vectors_table(spark, big)
    model = whitening.fit(table.select("embedding"))
    x = [[int(64 * a) + 1_000_000, int(64 * b) + 1_000_000] for a, b in big]
    assert model.sums == [sum(r[0] for r in x), sum(r[1] for r in x)] and model.sums[0] > 1 << 64
    want = {i: sum((40 * a - s) ** 2 for a, s in zip(r, model.sums, strict=True)) for i, r in enumerate(x)}
    got = whitening.transform(table, model).collect()
    assert {r.vec_id: int(r.deviation_text) for r in got} == want
    assert all(r.deviation is None for r in got if want[r.vec_id] >= 1 << 63)


# ---------------------------------------------------------------- collocations


def brute_collocations(rows, least, most_words, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for q, c in candidates.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i : i + k]] = max(inside[q[i : i + k]], c)
        for p, a in candidates.items():
            if 100 * inside[p] >= 50 * a:
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return out


ORDER = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, most_words, top, options", [(10, 3, 2000, {}), (3, 4, 7, {"shard_words": 300, "run_entries": 20}), (4, 3, 50, {"shard_words": 64, "run_entries": 1, "weak_bits": 7}), (2, 2, 10**6, {"bits": 8})])
def test_collocations_match_brute_force(spark, docs, rows, least, most_words, top, options):
    more = [(1000 + i, t, lang, None) for i, (t, lang) in enumerate([("Big, big. big big big BIG\tbig", "en"), ("a a a a a a a a a a a a a a", "en"), ("x y.z x y;z x y z! x y z " * 9, None), ("x y z x y z " * 4, "und"), ("é ñ " * 30, "xx"), (" q  q \x00q " * 12, "xx"), ("w" * 70000 + " " + "v w " * 50, "xx"), ("", ""), ("empty lang " * 11, "")])]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = collocations.collocations(spark, both, least=least, most_words=most_words, top=top, **options)
    assert got.columns == ORDER
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_collocations([*rows, *more], least, most_words, top))


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.collocations(spark, no_docs).count() == 0


def test_clashing_words_get_their_second_hash(spark, docs):
    words = collocations.count_words(docs, weak_bits=5)
    out, clash = collocations.renumbered(words)
    assert len(clash) == 32
    assert out.select("id").distinct().count() == out.count() == words.count()


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 1, 5 * 10**12 + 7, 9 * 10**12 + 3
    one = spark.createDataFrame([(1, left), (2, right)], "w0 long, n long")
    two = spark.createDataFrame([(1, 2, a)], "w0 long, w1 long, n long")
    got = collocations._scored([one, two], 2, 50).first()
    assert (got.a, got.l, got.r, got.score) == (a, left, right, 10**6 * a * a // (left * right))


# ---------------------------------------------------------------- packing


def check_pieces(got, texts, most):
    """Every id once, sequences without gaps, padding only where lengths are no power of two: nowhere."""
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, len(ids)] += len(ids)
        for r in by_doc[d, len(ids)]:
            mine = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert len(mine) == 4 * r.length and zlib.crc32(mine) == r.ids_crc32
            assert r.ids is None or bytes(r.ids) == mine
    covered = Counter()
    for key, own in by_doc.items():
        covered[key] = sum(r.length for r in own)
        places = Counter(i for r in own for i in range(r.start, r.start + r.length))
        assert set(places) == set(range(key[1])) and len(set(places.values())) == 1
    assert covered == want
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= most and at == own[0].sequence_length and not at & (at - 1)


@pytest.mark.parametrize("most, shard_tokens, shard_docs", [(2048, 1 << 21, 1 << 15), (64, 500, 1 << 15), (16, 1 << 20, 3), (1, 100, 100)])
def test_packing_round_trip(spark, docs, rows, most, shard_tokens, shard_docs):
    texts = [(r[0], r[1]) for r in rows if r[0] != 5 or r[1]]
    got = packing.packed(docs, packing.default_tokenizer(), most=most, shard_tokens=shard_tokens, shard_docs=shard_docs).collect()
    check_pieces(got, texts, most)


def test_sequences_are_filled_and_balanced():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 900, 3000), rng.geometric(0.002, 2000), np.ones(5000, int), np.array([5000, 2048, 1, 4096, 2047]), np.array([3]), np.zeros(0, int)):
        rows = packing.pack(lengths)
        filled = np.bincount(rows[:, 3], rows[:, 2]).astype(int) if len(rows) else np.zeros(0, int)
        total = int(lengths.sum())
        assert filled.sum() == total and len(filled) == total // 2048 + (total % 2048).bit_count()
        assert not (filled & (filled - 1)).any() and (filled == 2048).sum() == total // 2048
        assert (np.bincount(rows[:, 0], rows[:, 2], len(lengths)) == lengths).all()
    # against first fit of the same descending documents
    lengths = rng.integers(1, 900, 3000)
    rows = packing.pack(lengths)
    mine = np.bincount(rows[:, 3], packing.cost(rows[:, 2]))[: lengths.sum() // 2048]
    room, spent = [], []
    for n in sorted(lengths.tolist(), reverse=True):
        s = next((i for i, x in enumerate(room) if x >= n), None)
        if s is None:
            room.append(2048)
            spent.append(0.0)
            s = len(room) - 1
        room[s] -= n
        spent[s] += packing.cost(n)
    assert mine.std() / mine.mean() < 0.5 * np.std(spent) / np.mean(spent)


def greedy(lengths, most):
    """The rule, one piece at a time."""
    total = sum(n % most for n in lengths)
    room = [most] * (total // most) + [2**i for i in range(most.bit_length(), -1, -1) if total % most >> i & 1]
    spent, out = [0.0] * len(room), []
    for d in sorted(range(len(lengths)), key=lambda d: -(lengths[d] % most)):
        left = lengths[d] % most
        while left:
            fit = [s for s in range(len(room)) if room[s] >= left] or [s for s in range(len(room)) if room[s]]
            s = min(fit, key=lambda s: spent[s])
            n = min(left, room[s])
            out.append((d, n, s))
            room[s] -= n
            spent[s] += n + n * n / packing.ATTENTION
            left -= n
    return out


@pytest.mark.parametrize("most", [8, 256])
def test_assignment_follows_the_rule(most):
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 2 * most, 200)
    rows = packing.pack(lengths, most)
    full = int((lengths // most).sum())
    assert [(d, n, s - full) for d, _, n, s, _ in rows[full:].tolist()] == greedy(lengths.tolist(), most)


def test_word_parts_encode_as_whole_texts():
    import random

    from engram.llm.common import pieces, strings

    rng = random.Random(3)
    alphabet = [*"aB c'sStTdD  \t\n.,!?09é´ΣσΑİıſß́日本🙂|<>&\x85\x1c", "<|endoftext|>", "'re", "'ll", " 'S"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["long word " * 60000]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.WordEncoder(packing.default_tokenizer(), 1)
    got = [ids for p in pieces(strings(texts), 2000) for ids in enc.encode(p)]
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_packing_of_nothing(spark, no_docs):
    assert packing.packed(no_docs, packing.default_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.packed(no_docs, packing.default_tokenizer(), most=1000)
