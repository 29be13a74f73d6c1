"""Phrase collocations by compressed position bitmaps, in the manner of SPAM (Ayres et al. 2002).

A task numbers the words of its texts in shards of some SHARD_WORDS places; between pieces a number
is left out, so a phrase never crosses a piece or a document. Within a shard each word has a bitmap of
its places, compressed to the bytes that are not zero: entries (word, block of 8 places, byte). A
phrase's bitmap holds the places of its last word. It is extended by shifting it one place and
taking AND with the bitmaps of the words that have entries in the same blocks; popcounts are the
occurrences. Phrases are extended depth-first, by runs of first words, so that a shard holds the
bitmaps of one run a level only. Popcounts are summed over shards by Spark.

Levels are one scan of the texts each, so that no extension is counted whose part is rare over all
shards: words, then phrases of 2 words that occur often enough, and so on. What a scan knows of
the level before is a bit table of 2 ** FILTER_BITS bits, of fixed size whatever the corpus (a set bit: some frequent
phrase has this hash). It only spares work: what it lets through by chance is counted and
dropped after the sum, so results do not depend on it.

Words are known by 64-bit hashes of language and word. Two words of one hash, found by a second,
independent hash where the words' counts are summed, take the second one as their number
(clashes: some n * n / 2 ** 65 of n distinct words).

Counts, cuts and scores are exact: products are decimals of 38 digits, which hold 10 ** 6 * a * a up to
a = 10 ** 16. Rows of a language or of a frequent first word are never gathered: counts are partial sums a
task, joins are by word or phrase, and the ranks of a language are limited in each task before
they meet in one.

Edge cases: a null or empty text has no words; a null lang is `und`; a language without candidates
has no rows; repeated rows count as often as they are there; ties in score and a are ordered by the phrase; an
empty table gives no rows; other columns are ignored. A very long text is one piece, of some
100 bytes of a worker's memory a byte, and its shard is longer than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import LOWER, U64, Piece, Words, byte_class, materialize, mix, pieces, prefix_hashes, table, tidied, tidy

#: A shard ends at the first text that brings it to so many places.
SHARD_WORDS = 1 << 20
#: Bits of the table of what was frequent one level before; a multiple of 64.
FILTER_BITS = 26
#: Bitmap entries of the first words that are extended together.
RUN_ENTRIES = 1 << 16
LEAST = 10
MOST_WORDS = 3
TOP = 2000
#: Parts of a language that are ranked apart before they are ranked together.
RANK_PARTS = 16
NO_LANG = "und"
#: A word is made of bytes that neither end a piece (.,;:!? and 0A to 0D) nor separate words (20, 09).
_ENDS = byte_class("2E-2E 2C-2C 3B-3B 3A-3A 21-21 3F-3F 0A-0D")
_WORD = ~(_ENDS | byte_class("20-20 09-09"))
_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


class Shard:
    """Places and hashes of words; gaps in the places are ends of pieces."""

    def __init__(self):
        self.ids, self.places, self.next = [], [], 0

    def add(self, ids: np.ndarray, gap: np.ndarray) -> None:
        """Words in order; gap: a piece or text ends before the word."""
        if len(ids):
            places = np.arange(len(ids)) + np.cumsum(gap) + self.next
            self.ids.append(ids)
            self.places.append(places)
            self.next = int(places[-1]) + 2

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = (np.concatenate(self.ids), np.concatenate(self.places)) if self.ids else (np.zeros(0, U64), np.zeros(0, np.int64))
        self.__init__()
        return out


class Bits:
    """Entries (owner, block, byte) of bitmaps, by owner and block."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, byte: np.ndarray):
        self.owner, self.block, self.byte = owner, block, byte

    @staticmethod
    def of(owner: np.ndarray, place: np.ndarray) -> Bits:
        """The bitmaps of owners at places; no place is there twice."""
        key = (owner << 40) | place
        key.sort()
        entry = key >> 3
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        byte = np.add.reduceat(np.left_shift(1, key & 7), first) if len(first) else np.zeros(0, np.int64)
        return Bits(entry[first] >> 37, entry[first] & (1 << 37) - 1, byte.astype(np.uint8))

    def take(self, at: np.ndarray) -> Bits:
        return Bits(self.owner[at], self.block[at], self.byte[at])

    def shifted(self) -> Bits:
        """Each bit one place further; what leaves a block is an entry of the next."""
        over = np.flatnonzero(self.byte & 128)
        stay = np.flatnonzero(self.byte & 127)
        join = lambda a, b: np.concatenate([a[stay], b])
        return Bits(join(self.owner, self.owner[over]), join(self.block, self.block[over] + 1), join((self.byte << 1).astype(np.uint8), np.ones(len(over), np.uint8)))


class Index:
    """Bitmaps of words by block."""

    def __init__(self, bits: Bits):
        order = np.argsort(bits.block, kind="stable")
        self.word, self.byte = bits.owner[order], bits.byte[order]
        self.first = np.searchsorted(bits.block[order], np.arange(int(bits.block.max(initial=-1)) + 3))

    def extended(self, phrase: Bits) -> tuple[np.ndarray, np.ndarray, Bits]:
        """(owner, word) of each entry of a phrase's bitmap AND a word's, both shifted into place, and these entries (owner: their own number)."""
        moved = phrase.shifted()
        inside = np.flatnonzero(moved.block < len(self.first) - 1)
        moved = moved.take(inside)
        low = self.first[moved.block]
        many = self.first[moved.block + 1] - low
        left = np.repeat(np.arange(len(many)), many)
        right = np.arange(len(left)) + np.repeat(low - (np.cumsum(many) - many), many)
        byte = moved.byte[left] & self.byte[right]
        hit = np.flatnonzero(byte)
        left, right = left[hit], right[hit]
        return moved.owner[left], self.word[right], Bits(np.zeros(0, np.int64), moved.block[left], byte[hit])


def slot(ids: list[np.ndarray], bits: int) -> np.ndarray:
    """The place in the bit table of phrases given by their words' numbers; the same as slot_column."""
    out = ids[0]
    for i, x in enumerate(ids[1:]):
        out = out ^ (x >> U64(19 + 9 * i))
    return out & U64((1 << bits) - 1)


def slot_column(cols: list[str], bits: int) -> Column:
    out = F.col(cols[0])
    for i, c in enumerate(cols[1:]):
        out = out.bitwiseXOR(F.shiftrightunsigned(c, 19 + 9 * i))
    return out.bitwiseAND(F.lit((1 << bits) - 1))


def known(filter_: np.ndarray, ids: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether the bit of each phrase is set."""
    at = slot(ids, bits)
    return (filter_[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def bit_table(frequent: DataFrame, cols: list[str], bits: int = FILTER_BITS) -> np.ndarray:
    """The bit table of frequent phrases: at most 2 ** (bits - 6) rows of 64 bits come to the driver."""
    at = frequent.select(slot_column(cols, bits).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(one).alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["i"].to_numpy()] = rows["w"].to_numpy()
    return out.view(U64)


def word_ids(piece: Piece, words: Words, langs: list[str | None], weak_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word with its language; weak_bits: of the first (tests)."""
    plain = words.hashes()
    raw = [(x if x is not None else NO_LANG).encode() for x in langs]
    ends = np.cumsum([len(x) for x in raw])
    lang = prefix_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends) if raw else np.zeros(0, U64)
    by_word = lang[words.doc()]
    # the second from another function of the bytes: a product by odd numbers that depend on the place
    lens = words.ends - words.starts
    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    byte = words.data[np.repeat(words.starts, lens) + step].astype(U64)
    value = mix((byte + U64(1)) * U64(0xD1B54A32D192ED03) ^ (step.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
    other = np.add.reduceat(value, np.cumsum(lens) - lens) if len(lens) else np.zeros(0, U64)
    first = mix(plain + mix(by_word) * U64(0x9E3779B97F4A7C15))
    if weak_bits < 64:
        first &= U64((1 << weak_bits) - 1)
    return first, mix(other ^ mix(by_word ^ U64(0x8EBC6AF09C88C6E3)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame, weak_bits: int = 64) -> DataFrame:
    """(lang, word, id, id2, n) of all words, n over all shards."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1)):
                data = LOWER[piece.data]
                words = piece.words(_WORD, data)
                own = langs[piece.first : piece.first + piece.n]
                a, b = word_ids(piece, words, own, weak_bits)
                # words of both hashes are one; the first place of each stands for it
                order = np.lexsort((b, a))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
                at = np.flatnonzero(new)
                first = order[at]
                lens = words.ends[first] - words.starts[first]
                ends = np.cumsum(lens)
                text = data[np.arange(int(lens.sum())) + np.repeat(words.starts[first] - (ends - lens), lens)]
                names = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])
                doc = words.doc()[first]
                lang = pa.array([x if x is not None else NO_LANG for x in own], pa.string()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [lang, names.cast(pa.string()), pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(np.diff(np.append(at, len(order))))], ["lang", "word", "id", "id2", "n"]
                )

    rows = _texts(docs).mapInArrow(tidied(scan), "lang string, word string, id long, id2 long, n long")
    return rows.groupBy("lang", "word").agg(F.first("id").alias("id"), F.first("id2").alias("id2"), F.sum("n").alias("n"))


def renumbered(words: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """words with clashes told apart by id2, and the numbers that clash (sorted)."""
    clash = np.sort(words.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id").toArrow()["id"].to_numpy().astype(np.int64))
    if not len(clash):
        return words.drop("id2"), clash
    twice = words.sparkSession.createDataFrame([(int(x),) for x in clash], "id long").withColumn("twice", F.lit(True))
    out = words.join(twice, "id", "left").select("lang", "word", F.when(F.col("twice"), F.col("id2")).otherwise(F.col("id")).alias("id"), "n")
    if out.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").head(1):
        raise ValueError("two words share two independent 64-bit hashes")
    return out, clash


def count_phrases(docs: DataFrame, size: int, tables: list[np.ndarray], clash: np.ndarray, bits: int = FILTER_BITS, shard_words: int = SHARD_WORDS, run_entries: int = RUN_ENTRIES, weak_bits: int = 64) -> DataFrame:
    """(w0, ..., n) of phrases of size words, all of whose parts may be frequent by the tables of sizes 1 to size - 1."""
    held = docs.sparkSession.sparkContext.broadcast((tables, clash))
    names = [f"w{i}" for i in range(size)]

    def count(shard: Shard, tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, places = shard.taken()
        values, code = np.unique(ids, return_inverse=True)
        keep = known(tables[0], [values], bits)[code]
        bitmaps = Bits.of(code[keep].astype(np.int64), places[keep])
        index = Index(bitmaps)

        def extend(phrase: list[np.ndarray], owned: Bits) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            """Counts of phrases of size words below the given ones; phrase[i][owner] is the i-th word's code."""
            owner, word, entries = index.extended(owned)
            key = owner * len(values) + word
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.diff(key[order], prepend=-1))
            grown = [p[owner[order[at]]] for p in phrase] + [word[order[at]]]
            k = len(grown)
            if k == size:
                ok = np.ones(len(at), bool)
                for m in range(2, size):  # its last m words; the first ones were looked up before
                    ok &= known(tables[m - 1], [values[g] for g in grown[size - m :]], bits)
                n = np.add.reduceat(_POP[entries.byte[order]], at) if len(at) else np.zeros(0, np.int64)
                yield [g[ok] for g in grown], n[ok]
                return
            ok = known(tables[k - 1], [values[g] for g in grown], bits)
            for m in range(2, k):
                ok &= known(tables[m - 1], [values[g] for g in grown[k - m :]], bits)
            number = np.cumsum(ok) - 1
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
            stay = np.flatnonzero(ok[group]) if len(at) else np.zeros(0, np.int64)
            yield from extend([g[ok] for g in grown], Bits(number[group[stay]], entries.block[order[stay]], entries.byte[order[stay]]))

        starts = np.append(np.flatnonzero(np.diff(bitmaps.owner, prepend=-1)), len(bitmaps.owner))
        low = 0
        while low < len(starts) - 1:
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + run_entries, "right")) - 1)
            some = bitmaps.take(np.arange(starts[low], starts[high]))
            first, own = np.unique(some.owner, return_inverse=True)
            for grown, n in extend([first], Bits(own.astype(np.int64), some.block, some.byte)):
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(values[g].view(np.int64)) for g in grown] + [pa.array(n)], [*names, "n"])
            low = high

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tables, clash), shard = held.value, Shard()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1)):
                data = LOWER[piece.data]
                words = piece.words(_WORD, data)
                ids, other = word_ids(piece, words, langs[piece.first : piece.first + piece.n], weak_bits)
                if len(clash):
                    ids = np.where(np.isin(ids.view(np.int64), clash), other, ids)
                cut = np.concatenate([[0], np.cumsum(_ENDS[data])])
                gap = np.ones(words.n, bool)
                gap[1:] = cut[words.starts[1:]] > cut[words.ends[:-1]]
                gap[words.first[:-1][words.counts > 0]] = True
                shard.add(ids, gap)
                if shard.next >= shard_words:
                    yield from count(shard, tables)
                    tidy()
        if shard.next:
            yield from count(shard, tables)

    rows = _texts(docs).mapInArrow(tidied(scan), ", ".join(f"{c} long" for c in [*names, "n"]))
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, inside_percent: int = 50, bits: int = FILTER_BITS, **options) -> DataFrame:
    """The first top phrases of 2 to most_words words of each lang: lang, rank, phrase, a, l, r, n, score.

    options: shard_words, run_entries and weak_bits of the scans, which change no result.
    """
    words = materialize(spark, count_words(docs, options.get("weak_bits", 64)), "words")
    words, clash = renumbered(words)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    vocabulary = materialize(spark, words.where(F.col("n") >= least).select(F.col("id").alias("w0"), "lang", "word", "n"), "frequent-words")
    levels, tables = [vocabulary.select("w0", "n")], [bit_table(vocabulary, ["w0"], bits)]
    for size in range(2, most_words + 1):
        found = materialize(spark, count_phrases(docs, size, tables, clash, bits, **options).where(F.col("n") >= least), f"phrases-{size}")
        levels.append(found)
        if size < most_words:
            tables.append(bit_table(found, [f"w{i}" for i in range(size)], bits))
    out = None
    for size in range(2, most_words + 1):
        part = _scored(levels, size, inside_percent)
        part = _spelled(part, vocabulary, size)
        out = part if out is None else out.unionByName(part)
    order = F.desc("score"), F.desc("a"), "phrase"
    # the first of each lang are among the first of its parts, so at most RANK_PARTS * top rows of a lang meet
    out = out.withColumn("part", F.pmod(F.hash("phrase"), F.lit(RANK_PARTS)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _scored(levels: list[DataFrame], size: int, inside_percent: int) -> DataFrame:
    """(w0, ..., a, l, r, score) of phrases of size words that no longer one has inside it often enough."""
    names = [f"w{i}" for i in range(size)]
    rows = levels[size - 1].withColumnRenamed("n", "a")
    cuts = []
    for k in range(1, size):  # the phrase after its first k words
        for side, cols in (("l", names[:k]), ("r", names[k:])):
            part = levels[len(cols) - 1]
            part = part.select(*(F.col(f"w{i}").alias(c) for i, c in enumerate(cols)), F.col("n").alias(f"{side}{k}"))
            rows = rows.join(part, cols)
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), wide(f"l{k}") * wide(f"r{k}"))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    rows = rows.withColumn("cut", best).select(*names, "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    inside = None
    for longer in range(size + 1, len(levels) + 1):
        for at in range(longer - size + 1):
            part = levels[longer - 1].select(*(F.col(f"w{at + i}").alias(c) for i, c in enumerate(names)), F.col("n").alias("most"))
            inside = part if inside is None else inside.unionByName(part)
    if inside is None:
        return rows
    inside = inside.groupBy(*names).agg(F.max("most").alias("most"))
    return rows.join(inside, names, "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * inside_percent)).drop("most")


def _spelled(rows: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """rows with lang and phrase for their words' numbers."""
    for i in range(size):
        named = vocabulary.select(F.col("w0").alias(f"w{i}"), F.col("word").alias(f"word{i}"), *([F.col("lang")] if i == 0 else []))
        rows = rows.join(named, f"w{i}")
    return rows.select("lang", F.concat_ws(" ", *(F.col(f"word{i}") for i in range(size))).alias("phrase"), "a", "l", "r", "score")


ORACLE = r"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), parts as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as part from texts
), words as (
  select lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda x: x <> '') as w from parts
), ones as (
  select lang, w1, count(*) as c from (select lang, unnest(w) as w1 from words) group by lang, w1
), twos as (
  select lang, p.w1, p.w2, count(*) as c from (
    select lang, unnest(list_transform(range(1, len(w)), lambda i: {'w1': w[i], 'w2': w[i + 1]})) as p from words
  ) group by all having count(*) >= 10
), threes as (
  select lang, p.w1, p.w2, p.w3, count(*) as c from (
    select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'w1': w[i], 'w2': w[i + 1], 'w3': w[i + 2]})) as p from words
  ) group by all having count(*) >= 10
), n as (
  select lang, sum(c)::bigint as n from ones group by lang
), inside as (
  select lang, w1, w2, max(c) as c from (select lang, w1, w2, c from threes union all select lang, w2, w3, c from threes) group by lang, w1, w2
), cuts as (
  select p.lang, p.w1 || ' ' || p.w2 as phrase, p.c as a, x.c as l, y.c as r, 1 as k
  from twos p join ones x on x.lang = p.lang and x.w1 = p.w1 join ones y on y.lang = p.lang and y.w1 = p.w2
  left join inside on inside.lang = p.lang and inside.w1 = p.w1 and inside.w2 = p.w2
  where inside.c is null or 100 * inside.c < 50 * p.c
  union all
  select p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.c, x.c, y.c, 1
  from threes p join ones x on x.lang = p.lang and x.w1 = p.w1 join twos y on y.lang = p.lang and y.w1 = p.w2 and y.w2 = p.w3
  union all
  select p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.c, x.c, y.c, 2
  from threes p join twos x on x.lang = p.lang and x.w1 = p.w1 and x.w2 = p.w2 join ones y on y.lang = p.lang and y.w1 = p.w3
), scored as (
  select *, (1000000 * a::hugeint * a) // (l::hugeint * r) as score from cuts
), lowest as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, k) as i from scored) where i = 1
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (
  select lowest.*, n.n, row_number() over (partition by lowest.lang order by score desc, a desc, phrase) as rank from lowest join n on n.lang = lowest.lang
) where rank <= 2000
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents"))
