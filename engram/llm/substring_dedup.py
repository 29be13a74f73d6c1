"""Substring dedup: seed and extend over winnowed anchors; repeated passages are removed.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A window is WINDOW consecutive words of one document. A
word is removed if a window covers it whose word sequence also starts anywhere else in the input.

Seeds. The hashes of all GRAM-word runs are winnowed (Schleimer et al. 2003): each window's anchor
is the least hash among its WINDOW - GRAM + 1 runs, the leftmost of equal ones. Equal windows have
equal anchors at equal distance, so a window repeats only where its anchor does. The windows that
have a place as their anchor start at consecutive words: the anchor owns first..last, and its
reach is the words of all of them, extending up to 19 words to either side of the run.

Extension. Anchor places are joined by hash. Places with the same hash and the same whole reach
(a class, by a hash of its words and the anchor's place in it) agree on all their windows, so if
a class has two places all of its windows repeat and nothing more is compared. Where a hash has
several classes, matches end inside the reach; there one place of each class is extended word by
word: its owned windows are hashed from the text and counted by (anchor, window). This grows with
the number of places, never with pairs: copies by the thousand fall into one class, and all counts
are partial sums before any shuffle. The windows so found are merged to maximal repeats.

Hashes: a window is known by 64 bits of its anchor's words and 64 bits of all its words.

Edge cases: a null or empty text has no words and the hash of the empty string; texts of fewer
than WINDOW words keep everything; overlapping repeats within a document count (each start is a
place); equal rows repeat each other and share one list of spans; null doc_ids are carried; a text
longer than a piece takes some 150 bytes of a worker's memory a byte; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import PLAIN_WORD, U64, Words, doc_key, materialize, mix, pieces, table, tidied

WINDOW = 35
GRAM = 16

_B = U64(0xD1342543DE82EF95)
_B_INV = U64(pow(int(_B), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, U64)
    p[0] = 1
    return np.cumprod(p, dtype=U64)


class Runs:
    """Hashes of any runs of consecutive words, from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        self.prefix = np.zeros(n, U64)
        np.cumsum(hashes * _powers(_B, n)[:-1], dtype=U64, out=self.prefix[1:])
        self.back = _powers(_B_INV, n)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words first..last-1."""
        return mix((self.prefix[last] - self.prefix[first]) * self.back[first] + (last - first).astype(U64) * U64(0x9E3779B97F4A7C15))


def anchors(w: Words, runs: Runs, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Arrays of the anchors of some documents: document, first owned window, number owned, hash, class."""
    at = np.arange(w.n)
    left = np.repeat(w.first[1:], w.counts) - at  # words from here to the document's end
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    span = window - gram + 1
    h = np.full(w.n, np.iinfo(np.uint64).max, U64)
    full = np.flatnonzero(left >= gram)
    h[full] = runs(full, full + gram)
    best, where = h[starts].copy(), starts.copy()
    for i in range(1, span):
        other = h[starts + i]
        less = other < best
        best[less] = other[less]
        where[less] = starts[less] + i
    head = np.ones(len(starts), bool)
    head[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(head)
    n = np.diff(np.append(first, len(starts)))
    s = starts[first]
    cls = runs(s, s + n + window - 1) ^ mix((where[first] - s).astype(U64) + U64(1))
    return w.doc()[s], s, n, best[first], cls


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def find_anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, k2, first, n, a, c) of docs(k, k2, text): key, first owned window, number owned, anchor hash, class."""

    def scan(batches):
        for batch in batches:
            k, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in pieces(batch.column(2)):
                w = p.words(PLAIN_WORD)
                doc, s, n, a, c = anchors(w, Runs(w.hashes()), window, gram)
                row = doc + p.first
                place = s - w.first[doc]
                yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(k2[row]), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), signed(a), signed(c)], ["k", "k2", "first", "n", "a", "c"])

    return docs.select("k", "k2", "text").mapInArrow(tidied(scan), "k long, k2 int, first int, n int, a long, c long")


def windows_of(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k, k2, start, a, w) of rows(k, k2, text, places: list of first, n, a): hashes of the owned windows."""

    def scan(batches):
        for batch in batches:
            k, k2, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for p in pieces(batch.column(2)):
                w = p.words(PLAIN_WORD)
                runs = Runs(w.hashes())
                part = places.slice(p.first, p.n)
                flat = part.flatten()
                doc = np.repeat(np.arange(p.n), part.value_lengths().to_numpy(zero_copy_only=False))
                first, n, a = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                each = np.repeat(np.arange(len(doc)), n)
                step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                start = first[each] + step
                at = w.first[doc[each]] + start
                row = doc[each] + p.first
                yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(k2[row]), pa.array(start.astype(np.int32)), pa.array(a[each]), signed(runs(at, at + window))], ["k", "k2", "start", "a", "w"])

    return rows.select("k", "k2", "text", "places").mapInArrow(tidied(scan), "k long, k2 int, start int, a long, w long")


def repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, k2, spans: list of first, n): the repeated windows of each document of docs(k, k2, text) that has any."""
    found = materialize(spark, find_anchors(docs, window, gram), "anchors")
    again = found.groupBy("a").agg(F.count("*").alias("places")).where("places > 1").select("a")
    seeds = materialize(spark, found.join(again, "a", "left_semi"), "seeds")
    classes = materialize(spark, seeds.groupBy("a", "c").agg(F.count("*").alias("places"), F.min(F.struct("k", "k2", "first", "n")).alias("one")), "classes")
    whole = seeds.join(classes.where("places > 1").select("a", "c"), ["a", "c"], "left_semi").select("k", "k2", "first", "n")
    several = classes.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select("a")
    ends = classes.join(several, "a", "left_semi")
    asked = ends.groupBy(F.col("one.k").alias("k"), F.col("one.k2").alias("k2")).agg(F.collect_list(F.struct("one.first", "one.n", "a")).alias("places"))
    asked = materialize(spark, asked, "extensions")
    # equal rows of docs each give the windows asked of their key: distinct() keeps one
    hashed = materialize(spark, windows_of(docs.join(asked, ["k", "k2"]), window).distinct(), "windows")
    twice = hashed.groupBy("a", "w").agg(F.count("*").alias("m")).where("m > 1").select("a", "w")
    partial = hashed.join(twice, ["a", "w"], "left_semi").select("k", "k2", F.col("start").alias("first"), F.lit(1).alias("n"))
    # equal rows have the same spans: each task hands on one of them
    return whole.union(partial).groupBy("k", "k2").agg(F.collect_set(F.struct("first", "n")).alias("spans"))


def strip(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of rows(doc_id, text, spans)."""

    def scan(batches):
        for batch in batches:
            spans = batch.column(2)
            for p in pieces(batch.column(1)):
                w = p.words(PLAIN_WORD)
                raw = p.data.tobytes()
                gone = np.zeros(w.n + 1, np.int64)
                part = spans.slice(p.first, p.n)
                lens = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.flatten()
                if len(flat):
                    first, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                    begin = w.first[np.repeat(np.arange(p.n), lens)] + first
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + n + window - 1, -1)
                covered = np.cumsum(gone[:-1]) > 0
                starts, ends, first = w.starts.tolist(), w.ends.tolist(), w.first.tolist()
                removed = np.add.reduceat(np.append(covered, False), w.first[:-1]).astype(np.int64) * (w.counts > 0) if p.n else np.zeros(0, np.int64)
                kept, texts = [], []
                for i in range(p.n):
                    text = b" ".join([raw[starts[j] : ends[j]] for j in (np.flatnonzero(~covered[first[i] : first[i + 1]]) + first[i]).tolist()])
                    kept.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, p.n), pa.array(w.counts.astype(np.int64)), pa.array(removed), pa.array(kept), pa.array(texts)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return rows.select("doc_id", "text", "spans").mapInArrow(tidied(scan), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text) without repeated passages: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *doc_key())
    spans = materialize(spark, repeats(spark, keyed, window, gram), "repeats")
    return strip(keyed.join(spans, ["k", "k2"], "left"), window)


ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select rid, i, md5(array_to_string(w[i:i + 34], ' ')) as win from d, unnest(range(1, len(w) - 33)) as t(i) where len(w) >= 35),
c as (select win from p group by win having count(*) > 1),
gone as (select distinct rid, i + k as pos from p join c using (win), unnest(range(0, 35)) as o(k)),
x as (select rid, pos, w[pos] as word from d, unnest(range(1, len(w) + 1)) as t(pos)),
k as (select x.rid, count(gone.pos) as n_removed, string_agg(x.word, ' ' order by x.pos) filter (where gone.pos is null) as kept from x left join gone on gone.rid = x.rid and gone.pos = x.pos group by x.rid)
select d.doc_id, len(d.w)::BIGINT as n_words, coalesce(k.n_removed, 0)::BIGINT as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k using (rid)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, table(spark, sf_dir, "documents")).drop("kept_text")
