"""The pipeline's stages, each on what the one before kept."""

import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
from engram.llm import queries, token_output
from engram.llm.common import materialize
from tests.llm.test_operators import brute_classes, brute_kept, brute_kneser_ney, rules, water, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path, docs):
    bench = spark.createDataFrame([(1, " ".join(docs.where("doc_id = 407").first().text.split()[100:140]))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r.doc_id for r in kept.select("doc_id").collect())
        kept = materialize(spark, stage(spark, kept, str(tmp_path)), name)
        after = Counter(r.doc_id for r in kept.select("doc_id").collect())
        assert set(after) <= set(before)
        seen.append((name, len(after), sum(after.values())))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == COLUMNS
        if name in ("quality_rules", "near_duplicates", "decontamination"):
            assert not after - before
        if name == "near_duplicates":
            assert 407 in after and max(after.values()) == 1
        if name == "decontamination":
            assert 407 not in after
    assert [s[0] for s in seen] == ["quality_rules", "near_duplicates", "decontamination", "source_mixing", "token_output"]
    assert seen[3][2] == seen[4][2]  # a document taken twice is written twice
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r) for r in kept.collect())


def naive_good(rows):
    """Rows that the quality rules keep: base rules, and the bands of a model of all texts."""
    bits = brute_kneser_ney([r[1] for r in rows])
    figures = [(r[2], bits(r[1].encode()) if r[1] else None, len((r[1] or "").encode()), len(words(r[1])), rules(r[1])[-1]) for r in rows]
    return [r for r, kept in zip(rows, brute_kept(figures), strict=True) if kept]


def naive_clean(rows, items):
    """Rows that share less than four fifths of each item's shingles."""
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    shingles = lambda t: {tuple(split(t)[i : i + 5]) for i in range(len(split(t)) - 4)}
    asked = [s for s in map(shingles, items) if s]
    return [r for r in rows if not any(5 * len(s & shingles(r[1])) >= 4 * len(s) for s in asked)]


def test_run_matches_a_naive_composition(spark, tmp_path, rows, docs):
    """The first three stages row by row; of the mix the words that each source takes; of its rows all ids."""
    from tokenizers import Tokenizer

    long_words = words(next(r[1] for r in rows if r[0] == 407))
    items = [" ".join(long_words[100:140]), "too short", None, " ".join(words(rows[60][1])[:30])]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    good = naive_good(rows)
    heads = {c for _, c, *_ in brute_classes([(r[0], r[1]) for r in good])}
    one = list({r[0]: r for r in good if r[0] in heads}.values())
    clean = naive_clean(one, items)
    assert len(rows) > len(good) > len(one) > len(clean) > 20
    want = [sorted(r[:2] for r in part) for part in (good, one, clean)]
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        kept = materialize(spark, stage(spark, kept, str(tmp_path)), name)
        if i < 3:
            assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == want[i]
    size, by = {r[0]: len(words(r[1])) for r in clean}, {}
    for r in clean:
        by.setdefault(r[3], []).append(r[0])
    mixed = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert set(mixed) <= set(size) and max(mixed.values()) <= 2
    totals = {s: sum(size[d] for d in ids) for s, ids in by.items()}
    for s, target in water(totals).items():
        passes, reached = int(target // totals[s]), {0}
        for d in by[s]:
            reached |= {x + size[d] for x in reached}
            assert mixed[d] in (passes, min(passes + 1, 2))
        best = min(abs(passes * totals[s] + x - target) for x in reached)
        assert abs(sum(size[d] * mixed[d] for d in by[s]) - target) <= best + 1
    tok, text = Tokenizer.from_file(token_output.default_tokenizer()), {r[0]: r[1] for r in clean}
    ids, places, at = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in text.items()}, [], 0
    for d in sorted(mixed.elements()):
        places.append((d, at, len(ids[d]), zlib.crc32(struct.pack(f"<{len(ids[d])}I", *ids[d]))))
        at += len(ids[d])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == places


def test_empty_tables_and_further_columns(spark, tmp_path, docs, no_docs):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    kept = docs  # with columns whose names the operators use inside
    for name, stage in corpus_pipeline.STAGES:
        kept = materialize(spark, stage(spark, kept, str(tmp_path)), name)
        assert name == corpus_pipeline.STAGES[-1][0] or kept.columns == docs.columns
    assert kept.count() > 0


def test_registry():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
