"""Each corpus operator against brute force, on documents with every odd case, and on an empty table."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import common, compression_quality, context_mixing, decontamination, license_scan, mixture, near_duplicates, quality_rules, substring_dedup, token_output, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda t: WORD.findall(t or "")
lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# ---------------------------------------------------------------- shared arrays


def test_words_match_the_pattern(rows):
    texts = [r[1] for r in rows]
    got = []
    for p in common.pieces(common.strings(texts), 500):
        w = p.words()
        raw = p.data.tobytes()
        for i in range(p.n):
            got.append([raw[a:b].decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)])
    assert got == [words(t) for t in texts]


def test_equal_words_have_equal_hashes_and_others_differ(rows):
    seen = {}
    for p in common.pieces(common.strings([r[1] for r in rows]), 700):
        w, raw = p.words(), p.data.tobytes()
        for a, b, h in zip(w.starts, w.ends, w.hashes().tolist(), strict=True):
            assert seen.setdefault(h, raw[a:b]) == raw[a:b]
    assert len(set(seen.values())) == len(seen)


def test_memo_numbers():
    memo = common.HashMemo()
    memo.SHORT = 10
    rng, known = np.random.default_rng(0), {}
    for _ in range(20):
        h = np.unique(rng.integers(0, 200, 15).astype(np.uint64))
        n = memo.find(h)
        for x, i in zip(h.tolist(), n.tolist(), strict=True):
            assert known.get(x, -1) == i
        new = h[n < 0]
        known.update(zip(new.tolist(), memo.add(new).tolist(), strict=True))


# ---------------------------------------------------------------- quality rules


def rules(t):
    w = words(t)
    n = len(w)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {j for i in range(n - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark, docs, rows):
    out = quality_rules.quality_rules(spark, docs)
    assert bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((r[0], *rules(r[1])) for r in rows)
    assert out.where("kept and base_failed").count() == 0
    kept = bag(out.where("kept"), "doc_id")
    stayed = quality_rules.keep_good(spark, docs)
    assert stayed.columns == docs.columns
    assert bag(stayed, "doc_id") == kept


def brute_kneser_ney(texts):
    """Log2 probabilities by dictionaries: interpolated modified Kneser-Ney of order 3 over bytes."""
    tri = Counter()
    for t in texts:
        b = b"\0\0" + (t or "").encode()
        tri.update(b[i : i + 3] for i in range(len(b) - 2))
    pair = Counter(x[1:] for x in tri)
    last = Counter(x[1:] for x in pair)
    uni = {bytes([c]): (last[bytes([c])] + 0.5) / (sum(last.values()) + 128) for c in range(256)}

    def discounts(counts):
        n = [max(1, sum(c == i for c in counts.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), top) for i, top in enumerate((0.95, 1.9, 2.9))]

    def smooth(counts, lower):
        d, total, left = discounts(counts), Counter(), Counter()
        for x, c in counts.items():
            total[x[:-1]] += c
            left[x[:-1]] += d[min(c, 3)]
        return lambda x: (counts[x] - d[min(counts[x], 3)]) / total[x[:-1]] + left[x[:-1]] / total[x[:-1]] * lower(x[1:]) if x[:-1] in total else lower(x[1:])

    bi = smooth(pair, lambda x: uni[x])
    full = smooth(tri, bi)
    return lambda t: -sum(np.log2(full((b"\0\0" + t)[i : i + 3])) for i in range(len(t))) / len(t)


def brute_kept(rows, reach=2.5):
    """kept of (lang, bits, n_bytes, n_words, base_failed): quantiles of the stepped figures."""
    out = [not r[4] for r in rows]
    for step, value, size in ((1 / 128, lambda r: r[1], lambda r: r[2]), (1 / 16, lambda r: r[1] * r[2] / r[3], lambda r: r[3])):
        for lang in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == lang and r[1] is not None and r[3]]
            if not own:
                continue
            quantile = lambda x, q: sorted(x)[max(int(np.ceil(q * len(x))) - 1, 0)]
            mid = [(np.floor(value(r) / step) + 0.5) * step for r in own]
            centre = quantile(mid, 0.5)
            z = [(m - centre) * 2 ** (np.floor(4 * np.log2(size(r)) + 0.5) / 8) for m, r in zip(mid, own, strict=True)]
            q1, q3 = quantile(z, 0.25), quantile(z, 0.75)
            wide = reach * max(q3 - q1, 2.0)
            for i, r in enumerate(rows):
                if r[0] == lang and r[1] is not None and r[3]:
                    out[i] &= q1 - wide <= (value(r) - centre) * size(r) ** 0.5 <= q3 + wide
    return out


def test_perplexity_and_kept_match_brute_force(spark, docs, rows):
    got = quality_rules.quality_rules(spark, docs).select("doc_id", "lang", "bits", "n_bytes", "n_words", "base_failed", "kept").collect()
    bits = brute_kneser_ney([r[1] for r in rows])
    want = Counter((r[0], round(bits(r[1].encode()), 2)) if r[1] else (r[0], None) for r in rows)
    assert Counter((r.doc_id, None if r.bits is None else round(r.bits, 2)) for r in got) == want
    assert [r.kept for r in got] == brute_kept([(r.lang, r.bits, r.n_bytes, r.n_words, r.base_failed) for r in got])
    odd = [("en", 2.5 + 0.01 * (i % 7), 400 + i, 70) for i in range(200)] + [("en", 4.0, 500, 70), ("en", 2.5, 400, 140), ("de", 3.0, 100, 20), (None, 2.0, 50, 9), ("de", None, 0, 0)]
    scored = spark.createDataFrame(odd, "lang string, bits double, n_bytes long, n_words long").withColumn("n_repeat_words", F.lit(0))
    out = quality_rules.verdicts(scored, quality_rules.bands(scored)).collect()
    flat = [(r.lang, r.bits, r.n_bytes, r.n_words, r.n_words < 50) for r in out]
    assert [r.kept for r in out] == brute_kept(flat)
    assert sorted(r.bits for r in out if r.lang == "en" and not r.kept) == [2.5, 4.0]  # too few bits a word, too many a byte


def test_kneser_ney_sums_to_one(spark):
    texts = ["abracadabra banana", "banana band", "", "abc"]
    model = quality_rules.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    counts = Counter()
    for t in texts:
        b = b"\0\0" + t.encode()
        counts.update(tuple(b[i : i + 3]) for i in range(len(t)))
    for a, b in {(x[0], x[1]) for x in counts}:
        codes = np.array([a << 16 | b << 8 | c for c in range(256)])
        assert abs((2.0 ** model.log2(codes)).sum() - 1) < 1e-4


# ---------------------------------------------------------------- substring dedup


def test_substring_dedup(spark, docs, rows):
    tokens = [words(r[1]) for r in rows]
    starts = Counter(tuple(w[i : i + 35]) for w in tokens for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, tokens, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert bag(substring_dedup.substring_dedup(spark, docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("window,gram", [(6, 3), (10, 10)])
def test_substring_dedup_of_periodic_text(spark, window, gram):
    texts = ["a b " * 30, "a b a b a c " * 10, "b a c a b " * 5 + "x y z", "q r s t u v w", " ".join("abcdefghij") + " " + " ".join("abcdefghij")]
    starts = Counter(tuple(words(t)[i : i + window]) for t in texts for i in range(len(words(t)) - window + 1))
    want = {}
    for d, t in enumerate(texts):
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        want[d] = len(gone)
    out = substring_dedup.substring_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window, gram)
    assert {r.doc_id: r.n_removed for r in out.collect()} == want


# ---------------------------------------------------------------- near duplicates


def brute_classes(rows):
    by_text = defaultdict(list)
    for d, t in rows:
        by_text[t].append(d)
    texts = list(by_text)
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent, linked = list(range(len(texts))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                linked[i] += 1
                linked[j] += 1
                parent[find(i)] = find(j)
    least = lambda ds: min((x for x in ds if x is not None), default=None)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[find(i)] += by_text[t]
    return Counter((d, least(groups[find(i)]), least(by_text[t]), len(by_text[t]), linked[i]) for i, t in enumerate(texts) for d in by_text[t])


def test_near_duplicates(spark, docs, rows):
    keyed = docs.select("doc_id", *near_duplicates.text_key())
    out = keyed.join(near_duplicates.class_rows(spark, docs), ["t1", "t2"])
    assert bag(out, "doc_id", "class_id", "text_id", "n_copies", "n_links") == brute_classes([(r[0], r[1]) for r in rows])


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group of near copies far above the block size loses no link."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[i * 3 % 120] = f"x{i % 5}"
        w[(i * 7 + 1) % 120] = f"y{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = df.select("doc_id", *near_duplicates.text_key()).join(near_duplicates.class_rows(spark, df), ["t1", "t2"])
    assert bag(out, "doc_id", "class_id", "text_id", "n_copies", "n_links") == brute_classes(rows)


def test_one_row_of_each_class_stays(spark, docs, rows):
    classes = {c for _, c, *_ in brute_classes([(r[0], r[1]) for r in rows])}
    out = near_duplicates.one_of_each(spark, docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(x for x in kept if x is not None) == sorted(c for c in classes if c is not None)
    assert len(kept) == len(set(kept))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(30)]
    from engram.llm.components import components

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark, docs, rows):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    shingles = lambda t: {tuple(split(t)[i : i + 5]) for i in range(len(split(t)) - 4)}
    passage = words(rows[60][1])
    items = [(1, " ".join(passage[20:65])), (2, " ".join(passage[20:40]) + " and something else of its own here"), (3, "too short"), (4, None), (None, " ".join(words(rows[0][1])[:30])), (5, " ".join(passage[20:65]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in rows:
        own = shingles(r[1])
        for i, t in items:
            s = shingles(t)
            if s and 5 * len(s & own) >= 4 * len(s):
                want[(r[0], i, len(s & own), len(s))] += 1
    assert bag(decontamination.contained(spark, docs, bench), "doc_id", "item_id", "n_shared", "n_shingles") == want and want
    clean = decontamination.clean_rows(spark, docs, bench)
    assert clean.columns == docs.columns
    bad = {d for d, *_ in want}
    assert bag(clean, "doc_id") == Counter((r[0],) for r in rows if r[0] not in bad)


# ---------------------------------------------------------------- mixing


def water(sizes, share=1.5, cap=2.0):
    """Targets by rounds: what is above a cap is dealt again among the others."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    budget, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: cap * sizes[s] for s in full}
        open_ -= full
    return target


def test_mixing(spark, docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    out = mixture.mix_documents(spark, docs)
    got = out.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    want = water(dict(sizes))
    taken = Counter()
    where = {}
    for r in docs.select("doc_id", "source").collect():
        where[r.doc_id] = r.source
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
    by_size = defaultdict(set)
    for r in got:
        by_size[(r.source_size, round(r.target, 6))].add(r.doc_id)
    for s, t in want.items():
        assert any(size == sizes[s] and abs(target - t) < 1e-6 for size, target in by_size)
    sums = {(r.source_size, round(r.target, 6)): r.t for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()}
    for s, t in want.items():
        passes = int(t // sizes[s]) if sizes[s] else 0
        reached = {0}
        for r in rows:
            if r[3] == s:
                reached |= {x + len(words(r[1])) for x in reached}
        best = min(abs(passes * sizes[s] + x - t) for x in reached)
        assert abs(sums[(sizes[s], round(t, 6))] - t) <= best + 1
    assert bag(mixture.mix_documents(spark, docs.repartition(3)), *out.columns) == bag(out, *out.columns)
    rows_out = mixture.mixed_rows(spark, docs)
    assert rows_out.columns == docs.columns
    per_doc = Counter()
    for r in got:
        per_doc[(r.doc_id, r["size"])] += r.taken // r["size"] if r["size"] else 0
    assert Counter((r.doc_id, len(words(r.text))) for r in rows_out.collect()) == +per_doc


def test_mixing_of_rows_that_are_alike(spark):
    """Of repeated rows, without ids too, a part is taken where the rest of a target asks for it."""
    rows = [(None, "one two three", "a")] * 50 + [(7, "one two three", "a")] * 30 + [(i, f"w{i} x y", "b") for i in range(100, 140)] + [(8, "z " * 9, "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixture.mix_documents(spark, docs)
    got = {(r.source_size, r.target): r.t for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()}
    assert out.count() == len(rows) and all(abs(t - target) <= 3 for (_, target), t in got.items()) and len(got) == 2
    mixed = mixture.mixed_rows(spark, docs)
    assert mixed.agg(F.sum(mixture.n_words(F.col("text")))).first()[0] == sum(got.values())
    assert bag(mixture.mixed_rows(spark, docs.repartition(7)), *docs.columns) == bag(mixed, *docs.columns)


def test_many_equal_rows_share_their_spans(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(1).select(F.explode(F.array_repeat(F.lit(5).cast("long"), 10_000)).alias("doc_id"), F.lit(text).alias("text"))
    keyed = docs.select("text", *common.doc_key())
    spans = substring_dedup.repeats(spark, keyed).collect()
    assert len(spans) == 1 and len(spans[0].spans) < 60
    assert substring_dedup.substring_dedup(spark, docs).where("n_removed = 60").count() == 10_000


def test_a_large_component_of_unlike_texts(spark):
    """Candidates chained to one component far above the block size: all links between near copies, none between others."""
    rng = np.random.default_rng(1)
    common_part = [f"c{i}" for i in range(40)]
    rows = []
    for g in range(30):
        own = [f"g{g}_{i}" for i in range(45)]
        for i in range(40):
            w = common_part + list(own)
            w[int(rng.integers(len(w)))] = f"x{g}_{i}"
            rows.append((g * 100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = df.select("doc_id", *near_duplicates.text_key()).join(near_duplicates.class_rows(spark, df), ["t1", "t2"])
    assert bag(out, "doc_id", "class_id", "text_id", "n_copies", "n_links") == brute_classes(rows)


def test_subset_sums():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.choice(np.arange(1, 40), 6, replace=False)
        counts = rng.integers(1, 6, 6)
        whole = int((lengths * counts).sum())
        rest = int(rng.integers(0, whole))
        take = mixture.quotas(lengths, counts, rest)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * i for s in sums for i in range(c + 1)}
        got = int((take * lengths).sum())
        assert got in sums and abs(got - rest) <= max(int(lengths.min()), min(abs(s - rest) for s in sums) * 3)


# ---------------------------------------------------------------- licence scan


def test_license_scan(spark, docs, rows):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    want = Counter()
    for r in rows:
        w = words_of(r[1])
        places, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want[(r[0], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += 1
    out = docs.select("doc_id", license_scan.scan(spark, license_scan.build_index(docs))("text").alias("s")).select("doc_id", "s.*")
    assert bag(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in out.collect())


def test_license_templates_are_found_in_text_and_need_their_phrase(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    texts = ["some words before " + isc + " and after", isc.replace("without fee", "without pay"), "the of and is in to", None, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = df.select("doc_id", license_scan.scan(spark, license_scan.build_index(df))("text").alias("s")).select("doc_id", "s.*").orderBy("doc_id").collect()
    assert [r.labels for r in out] == ["isc", "", "", "", "bsd"]
    assert [r.n_base for r in out] == [0] * 5


def test_license_templates_do_not_crowd_each_other_out(docs):
    index = license_scan.build_index(docs)
    number = {w: i for i, w in enumerate(index.vocabulary)}
    own = [np.array([number[w] for w in license_scan.words_of(t[1])]) for t in license_scan.TEMPLATES]
    every = {t[0] for t in license_scan.TEMPLATES}
    gap = np.full(5, -1)
    assert index.match(np.concatenate([x for body in own for x in (gap, body)]))[0] == every
    # whatever is not indexed is too light for a match of its own
    assert all(index.idf[b][~index.rare[b]].sum() < license_scan.MIN_SCORE * index.idf[b].sum() for b in own)
    for i in range(len(own)):
        for j in range(i):
            for k in range(j):
                found = index.match(np.concatenate([own[i], gap, own[j], gap, own[k]]))[0]
                assert found >= {license_scan.TEMPLATES[x][0] for x in (i, j, k)}


# ---------------------------------------------------------------- token output


def test_token_output(spark, docs, rows):
    from tokenizers import Tokenizer

    path = token_output.default_tokenizer()
    tok = Tokenizer.from_file(path)
    ids = [(r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    segments = token_output.write_segments(docs, path, 4, segment_ids=700)
    got = token_output.read_back(common.materialize(spark, segments, "segments")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), crc(x)) for d, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))


@pytest.mark.parametrize("n,top", [(1, 1), (5, 3), (100, 100), (1000, 10**12), (700, 50), (3, 1 << 62)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top, n))
    ef = token_output.EliasFano.encode(v)
    assert (ef.select(np.arange(n)) == v).all()
    assert [int(ef.select(i)) for i in range(0, n, 7)] == v[::7].tolist()
    assert 8 * (len(ef.low) + len(ef.high) + len(ef.ranks)) <= n * (3 + 3 / 16 + max(0, np.log2(max(top / n, 1)))) + 112
    assert token_output.EliasFano.encode(np.zeros(0)).select(np.zeros(0)).tolist() == []
    with pytest.raises(IndexError):
        ef.select(n)


def test_encoder_forgets_and_agrees(rows):
    texts = common.strings([r[1] for r in rows])
    a, b = (token_output.Encoder(token_output.default_tokenizer(), n) for n in (10**6, 50))
    for p in common.pieces(texts, 900):
        assert a.encode(p) == b.encode(p)


# ---------------------------------------------------------------- learned operators


def labelled(spark, n=400):
    rng = np.random.default_rng(4)
    good, bad, rude = (["".join(rng.choice(list(a), 4)) for _ in range(60)] for a in ("abcdefg", "#$%xyz!", "klmnop"))
    rows, labels = [], []
    for i in range(n):
        q, t = int(rng.random() < 0.7), int(rng.random() < 0.3)
        w = list(rng.choice(good if q else bad, 60))
        if t:
            w[5:5] = list(rng.choice(["idiot", "trash", *rude[:3]], 3))
        rows.append((i, " ".join(w)))
        labels.append((i, q, t))
    labels += [(None, 1, 0), (5, None, None), (10**6, 1, 1)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels[:n]


def test_compression_classifier_on_held_out_rows(spark):
    df, labels, truth = labelled(spark)
    away = common.held_out(F.col("doc_id"), 4, 2)
    model = compression_quality.fit(df, labels.where(~away))
    got = {r.doc_id: (r.h, r.score) for r in df.select("doc_id", away.alias("h"), compression_quality.score(spark, model)("text").alias("score")).collect()}
    assert all(0 <= s <= 1 for _, s in got.values()) and len(got) == 402
    right = [(got[d][1] >= 0.5) == bool(q) for d, q, _ in truth if got[d][0]]
    assert len(right) > 50 and sum(right) / len(right) > 0.95


def test_compression_classifier_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = compression_quality.fit(docs, none)
    assert {r.s for r in docs.select(compression_quality.score(spark, model)("text").alias("s")).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert compression_quality.fit(docs, one).constant == 1.0


def test_toxicity_chain_on_held_out_rows(spark):
    df, labels, truth = labelled(spark)
    chain = toxicity.fit(df, labels.where("doc_id % 3 != 0 or doc_id is null"))
    got = {r.doc_id: r.s for r in df.select("doc_id", toxicity.score(spark, chain)("text").alias("s")).collect()}
    assert len(got) == 402 and got[400].p_toxic == got[401].p_toxic < 0.5
    test = [(got[d].p_toxic >= 0.5, bool(t)) for d, _, t in truth if d % 3 == 0]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert [len(link.beta) - len(link.words) for link in chain.links] == [1, 2, 3]


def test_toxicity_without_labels(spark, docs):
    chain = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.s.p_toxic for r in docs.select(toxicity.score(spark, chain)("text").alias("s")).collect()) < 1e-6


# ---------------------------------------------------------------- language model


def test_base_scores(spark, docs, rows):
    away = {r.doc_id: r.h for r in docs.select("doc_id", common.held_out(F.col("doc_id"), 7, 2).alias("h")).collect()}
    for d, h in away.items():
        assert h == (d is not None and zlib.crc32(str(d).encode()) % 7 == 2)
    c = Counter(w for r in rows if not away[r[0]] for w in words(lower(r[1])))
    ends = sum(not away[r[0]] for r in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = Counter()
    for r in rows:
        w = words(lower(r[1]))
        base = sum(log10((c[x] + 1) / (n + v + 1)) for x in w) + log10((ends + 1) / (n + v + 1))
        want[(r[0], away[r[0]], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6))] += 1
    out = context_mixing.score_documents(spark, docs.withColumn("held_out", common.held_out(F.col("doc_id"), 7, 2)))
    assert bag(out.withColumn("base_score", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
    assert all(r.score < 0 for r in out.collect())


def test_spellings_are_probabilities():
    """The probabilities of all words of one letter, and of all that go on, add up to one."""
    rng = np.random.default_rng(2)
    code = context_mixing.huffman(rng.integers(1, 50, 257))
    lens, nodes, bits = code
    assert abs((0.5**lens).sum() - 1) < 1e-12
    speller = context_mixing.Speller(*code)
    data = np.arange(256, dtype=np.uint8)
    some = speller(data, np.arange(256), np.ones(256, np.int64), np.zeros(256, np.int64))
    p = 1 / (1 + np.exp(-np.sin(some.slots[2] * 0.001 + nodes[0, 0])))  # any probability fixed by the slot
    logs = np.bincount(some.word, np.bincount(some.at, np.where(some.place == 0, np.log(np.where(some.bit, p, 1 - p)), 0), some.n)[some.step], 256)
    end = speller(data, *np.zeros((3, 1), np.int64))
    q = 1 / (1 + np.exp(-np.sin(end.slots[2] * 0.001 + nodes[0, 0])))
    end_bit = end.bit
    assert abs(np.exp(logs).sum() + np.exp(np.log(np.where(end_bit, q, 1 - q)).sum()) - 1) < 1e-9


def test_frequent_words_are_predicted_by_the_word_before(spark):
    texts = ["north wind", "south tide"] * 60
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(1000, "north wind", True), (1001, "north tide", True)]
    out = context_mixing.score_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    score = {r.doc_id: r.score for r in out.where("held_out").collect()}
    assert score[1000] > score[1001] + 0.5  # all four words are equally frequent


def brute_score(model, text):
    """The log10 probability of a text word by word and bit by bit, with the model's parameters."""
    w = words(lower(text))
    known = {h: c for h, c in zip(model.anchors.words.tolist(), model.anchors.classes.tolist(), strict=True)}
    code = dict(zip(("lens", "nodes", "bits"), model.code, strict=False))
    table = context_mixing.bases(model.code[3])
    total, seen, follow, pairs, hits, tries = 0.0, Counter(), Counter(), Counter(), 0, 0
    classes = [0] * (context_mixing.CLASSES + 1)
    for i, x in enumerate(w):
        state = max(range(len(classes)), key=lambda c: (classes[c], -c)) if any(classes) else 0
        raw = x.encode()
        alone = context_mixing.Speller(*model.code)(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), np.array([state]))
        bit, place, slots = alone.bit, alone.place, alone.slots
        want = [bool(code["bits"][s, d]) for s in [*raw, context_mixing.END] for d in range(code["lens"][s])]
        assert bit.tolist() == want
        spelled = 0.0
        for j in range(len(bit)):
            inputs, seen_often = [], []
            for k in range(len(slots)):
                assert table[k] <= slots[k][j] < table[k + 1]
                n0, n1 = divmod(int(model.slots.counts[slots[k][j]]), 256)
                inputs.append(model.slots.stretched[slots[k][j]] / 9)
                if k in context_mixing.GATE_TABLES:
                    seen_often.append(0 if n0 + n1 < 1 else min(int(1 + np.log2(n0 + n1) // 2), 6))
            gate = (seen_often[1] * 3 + (0, 1, 1, 1, 2, 2, 2)[seen_often[0]]) * 4 + int(place[j])
            z = float(model.mixer.weights[gate, :-1] @ np.array(inputs) + model.mixer.weights[gate, -1])
            at = min(max(z * 2 + 16, 0), 33 - 1.001)
            m = model.mixer.map[gate]
            p = (1 / (1 + np.exp(-z)) + m[int(at)] * (1 - at % 1) + m[int(at) + 1] * (at % 1)) / 2
            p = min(max(p, 1e-6), 1 - 1e-6)
            spelled += np.log10(p if bit[j] else 1 - p)
        before = w[i - 1] if i else None
        f = follow[before]
        recall = 4 * (0 if f == 0 else 1 if f == 1 else 2 if f < 4 else 3) + min(int(4 * (hits + 0.2) / (tries + 2)), 3)
        a = model.averages[recall]
        total += np.log10(a[0] * 10**spelled + a[1] * seen[x] / max(i, 1) + a[2] * (pairs[before, x] / f if f else 0)) + np.log10(1 - model.end)
        tries += f > 0
        hits += f > 0 and pairs[before, x] > 0
        seen[x] += 1
        follow[before] += 1
        pairs[before, x] += 1
        h = int(next(common.pieces(common.strings([x]))).words().hashes()[0])
        if h in known:
            classes[known[h]] += 1
    return total + np.log10(model.end)


def test_scores_match_brute_force(spark, docs, rows):
    train = docs.where("doc_id is not null and doc_id % 7 != 2")
    model, _ = context_mixing.fit(spark, train.select("doc_id", "text"))
    scored = context_mixing.score_rows(spark, docs.select("doc_id", F.lit(False).alias("held_out"), "text"), model)
    some = [r for r in rows if r[0] not in (407, 411)][::4]  # all but the longest: the loops above are slow
    got = defaultdict(set)
    for r in scored.collect():
        got[r.doc_id].add(round(r.score, 2))
    for r in some:
        assert any(abs(brute_score(model, r[1]) - x) < 0.02 + 1e-4 * abs(x) for x in got[r[0]])


def test_counts_of_decisions_match_brute_force(spark):
    texts = ["the sea the land", "the land of the sea", "sea"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = context_mixing.fit(spark, docs)
    speller, want = context_mixing.Speller(*model.code), Counter()
    for t in texts:
        p = next(common.pieces(common.strings([t])))
        w = p.words()
        state = model.anchors.states(w, w.hashes(), np.arange(w.n))
        for i in range(w.n):
            alone = speller(p.data[w.starts[i] : w.ends[i]], np.array([0]), w.ends[i : i + 1] - w.starts[i : i + 1], state[i : i + 1])
            for s in alone.slots:
                want.update(zip(s.tolist(), alone.bit.tolist(), strict=True))
    got = {}
    for at in np.flatnonzero(model.slots.counts).tolist():
        n0, n1 = divmod(int(model.slots.counts[at]), 256)
        got |= {(at, b): n for b, n in ((False, n0), (True, n1)) if n}
    assert got == want


def test_held_out_texts_score_above_the_base_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = context_mixing.score_documents(spark, docs.select("doc_id", "text", common.held_out(F.col("doc_id"), 7, 2).alias("held_out"))).where("held_out")
    r = out.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert r[0] > r[1] + 0.2 * r[2] and r[3] > 0.6  # of 146 documents; at ten times the corpus 0.94


def test_all_documents_fit_the_mixer_and_the_averages(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 25_000)) for _ in range(2)]  # each above 100,000 characters
    model, _ = context_mixing.fit(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert np.abs(model.mixer.weights - context_mixing.Mixer.fresh().weights).max() > 0.01
    assert np.abs(model.mixer.map - context_mixing.Mixer.fresh().map).max() > 0.01
    assert (model.averages[4:, 1:] > 0).any()


def test_scores_do_not_depend_on_the_dictionary(spark, monkeypatch):
    """A word outside the dictionary keeps what the corpus knows of it at each of its places."""
    rows = [(i, "ocean ocean river ocean", i % 4 == 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    scores = []
    for size in (1 << 18, 0):
        monkeypatch.setattr(context_mixing, "DICTIONARY", size)
        scores.append([r.score for r in context_mixing.score_documents(spark, docs).orderBy("doc_id").collect()])
    assert np.allclose(*scores)


def test_earlier_counts():
    for keys, want in (([3, 1, 3, 3, 1, 2], [0, 0, 1, 2, 1, 0]), ([1 << 20, 5, 1 << 20, 4 + (1 << 16), 5], [0, 0, 1, 0, 1]), ([], [])):
        keys = np.array(keys, np.int64)
        assert context_mixing.earlier(context_mixing.stable_order(keys), keys).tolist() == want


def test_scores_mean_the_same_at_every_sample(spark):
    """The share of texts called good hardly moves when the labelled rows are cut to equal numbers."""
    docs = table_of(spark, "documents")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    shares = []
    for sample in (3000, 60):
        model = compression_quality.fit(docs, labels, sample=sample)
        shares.append(docs.select(F.avg((compression_quality.score(spark, model)("text") >= 0.7).cast("int"))).first()[0])
    assert abs(shares[0] - shares[1]) < 0.06


def table_of(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def test_repeated_ids_train_with_their_least_text(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "x" * 100), (2, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    rows, counts = compression_quality.training_rows(docs, labels, "quality", 10, 50)
    assert [tuple(r) for r in rows] == [(1, "a", 0), (2, "c", 1)] and counts == {0: 1, 1: 1}


# ---------------------------------------------------------------- empty tables


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(spark, no_docs).count() == 0
    assert quality_rules.keep_good(spark, no_docs).count() == 0
    assert substring_dedup.substring_dedup(spark, no_docs).count() == 0
    assert near_duplicates.class_rows(spark, no_docs).count() == 0
    assert near_duplicates.one_of_each(spark, no_docs).count() == 0
    assert decontamination.contained(spark, no_docs, bench).count() == 0
    assert decontamination.clean_rows(spark, no_docs, bench.limit(0)).count() == 0
    assert mixture.mix_documents(spark, no_docs).count() == 0
    assert mixture.mixed_rows(spark, no_docs).count() == 0
    assert no_docs.select(license_scan.scan(spark, license_scan.build_index(no_docs))("text")).count() == 0
    assert token_output.read_back(token_output.token_output(spark, no_docs, token_output.default_tokenizer())).count() == 0
    assert no_docs.select(compression_quality.score(spark, compression_quality.fit(no_docs, labels))("text")).count() == 0
    assert no_docs.select(toxicity.score(spark, toxicity.fit(no_docs, labels))("text")).count() == 0
    assert context_mixing.score_documents(spark, no_docs.withColumn("held_out", F.lit(False))).count() == 0
