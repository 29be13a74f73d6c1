"""Token-id output: one array of ids in document order, document boundaries in Elias-Fano code.

Documents are ordered by doc_id over range partitions (ties by a hash of the text, nulls first),
tokenized, and written as segments: rows of a Parquet table, each with the ids of some whole
consecutive documents as little-endian bytes (16 bits each where the vocabulary allows, else 32)
and the boundaries within the segment as an Elias-Fano sequence. A segment closes at
SEGMENT_IDS ids; only a single longer document makes a longer one. Spark's writer commits files
by task, so a lost executor costs its unfinished tasks only.

Elias-Fano (Elias 1974, Fano 1971): of n ascending numbers below u, the low
l = floor(log2(u / n)) bits are packed; the high parts are a bit string with bit
(value >> l) + i set for the i-th number: 2 + l bits a number, no table of 64-bit offsets.
select finds the i-th set bit through rank samples, the set bits before each BLOCK bits, which are
stored beside the bit string in 32 bits each (a sixteenth of it). The ids of a segment's documents
(doc_id) are coded the same way, as distances from the least. Documents are read back by select.

The number of ids in all earlier partitions is summed from one number per partition.

Edge cases: a null or empty text has the end id only; null doc_ids come first, in the order of
their texts' hashes; repeated rows are each written; an empty table gives no segments; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import HashMemo, Piece, byte_class, kept_by_worker, materialize, pieces, room, span_hashes, table, tidied, tidy

#: A segment closes once it has so many ids.
SEGMENT_IDS = 1 << 20
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Distinct parts of texts whose ids a worker remembers (some 40 bytes each); beyond, it starts anew.
MEMO_PARTS = 1_500_000
PIECE_BYTES = 500_000
#: New parts that the tokenizer is given at a time: what it returns takes some 600 bytes a part.
CALL_PARTS = 1 << 13
BLOCK = 512

SEGMENT = "part int, seg int, part_offset long, n_docs int, n_ids long, n_null int, width int, base_id long, ids binary, ends_low binary, ends_high binary, ends_ranks binary, ends_l int, docs_low binary, docs_high binary, docs_ranks binary, docs_l int"


# ---------------------------------------------------------------- Elias-Fano


@dataclass
class EliasFano:
    """n ascending numbers (ties allowed). low: packed low bits; high: bit string of the high parts; ranks: its rank samples."""

    n: int
    l: int
    low: bytes
    high: bytes
    ranks: bytes

    @staticmethod
    def encode(values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return EliasFano(0, 0, b"", b"", b"")
        bound = int(v[-1]) + 1
        l = max(0, (bound // n).bit_length() - 1)  # noqa: E741
        low = b""
        if l:
            bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        at = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        before = np.searchsorted(at, np.arange(0, len(high), BLOCK))
        return EliasFano(n, l, low, np.packbits(high, bitorder="little").tobytes(), before.astype("<u4").tobytes())

    def select(self, i: np.ndarray | int) -> np.ndarray:
        """The i-th numbers (from 0), from the blocks of the bit string that hold them."""
        i = np.asarray(i, np.int64)
        if i.size and not 0 <= i.min() <= i.max() < self.n:
            raise IndexError(i)
        ranks = np.frombuffer(self.ranks, "<u4").astype(np.int64)
        block = np.searchsorted(ranks, i, "right") - 1
        asked, back = np.unique(block, return_inverse=True)
        raw = np.frombuffer(self.high, np.uint8)
        rows = np.pad(raw, (0, -len(raw) % (BLOCK // 8))).reshape(-1, BLOCK // 8)[asked]
        row, bit = np.nonzero(np.unpackbits(rows, axis=1, bitorder="little"))
        first = np.searchsorted(row, np.arange(len(asked)))
        at = block * BLOCK + bit[first[back.reshape(i.shape)] + i - ranks[block]] if i.size else i
        return (at - i) << self.l | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the i-th numbers, each from the nine bytes from its first bit's on."""
        if not self.l or not i.size:
            return np.zeros_like(i)
        raw = np.frombuffer(self.low + bytes(9), np.uint8)
        first = i * self.l
        byte, shift = first // 8, (first % 8).astype(np.uint64)
        out = np.zeros(i.shape, np.uint64)
        for k in range(8):
            out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
        out >>= shift
        out |= np.where(shift > 0, raw[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (out & np.uint64((1 << self.l) - 1)).astype(np.int64)


# ---------------------------------------------------------------- tokens

# A text may be cut before an ASCII non-letter that follows an ASCII letter, and before ASCII white
# space that follows a byte of anything else: the pattern of a byte-level BPE never joins across
# these, so the parts can be encoded alone. Both cuts fall on character boundaries.
_SPACE = byte_class("20-20 09-0D")
_LETTER = byte_class("41-5A 61-7A")
_OTHER = byte_class("00-40 5B-60 7B-7F")


class Encoder:
    """Ids of texts by the tokenizers library, each distinct part encoded once while it is remembered.

    Parts are known by a 64-bit hash of their bytes.
    """

    def __init__(self, path: str, memo_parts: int = MEMO_PARTS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.limit = memo_parts
        self.end = np.array([END_ID], self.type).tobytes()
        self.forget()

    def forget(self) -> None:
        self.memo = HashMemo()
        self.starts, self.lens, self.ids = (np.zeros(1 << 10, t) for t in (np.int64, np.int32, self.type))
        self.used = 0

    def _add(self, hashes: np.ndarray, parts: list[str]) -> np.ndarray:
        """Encode new parts (by ascending hash); their numbers."""
        got = [e.ids for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int32, len(got))
        total = int(lens.sum())
        numbers = self.memo.add(hashes)
        self.starts, self.lens = room(self.starts, self.memo.n), room(self.lens, self.memo.n)
        self.ids = room(self.ids, self.used + total)
        self.starts[numbers] = self.used + np.cumsum(lens) - lens
        self.lens[numbers] = lens
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), self.type, total)
        self.used += total
        return numbers

    def encode(self, piece: Piece) -> list[bytes]:
        """The ids of each document with the end id, as little-endian bytes."""
        data, offsets = piece.data, piece.offsets
        if not len(data):
            return [self.end] * piece.n
        cut = np.zeros(len(data), bool)
        space, letter, other = _SPACE[data], _LETTER[data], _OTHER[data]
        cut[1:] = ~space[:-1] & space[1:] | letter[:-1] & other[1:]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        lens = np.diff(np.append(starts, len(data)))
        distinct, sample, back = np.unique(span_hashes(data, starts, lens), return_index=True, return_inverse=True)
        if self.memo.n + len(distinct) > self.limit:
            self.forget()
        number = self.memo.find(distinct)
        new = np.flatnonzero(number < 0)
        raw = data.tobytes()
        for low in range(0, len(new), CALL_PARTS):
            some = new[low : low + CALL_PARTS]
            at = starts[sample[some]]
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), (at + lens[sample[some]]).tolist(), strict=True)]
            number[some] = self._add(distinct[some], parts)
        size, first = self.lens[number][back].astype(np.int64), self.starts[number][back]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)].tobytes()
        bounds = (ends[np.searchsorted(starts, offsets)] * self.width).tolist()
        out = [ids[a:b] + self.end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if any(s in raw for s in self.specials):  # a text with a special token's string is encoded as it stands
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if any(s in raw[a:b] for s in self.specials):
                    text = raw[a:b].decode("utf-8", "replace")
                    out[i] = np.array(self.tok.encode(text, add_special_tokens=False).ids, self.type).tobytes() + self.end
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder: what one task has encoded serves the next."""
    return kept_by_worker(f"encoder {path}", lambda: Encoder(path))


# ---------------------------------------------------------------- writing and reading


def _segment(part: int, seg: int, at: int, ids: list[int | None], tokens: list[bytes], width: int) -> dict:
    known = np.array([x for x in ids if x is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum([len(t) // width for t in tokens]))
    docs = EliasFano.encode((known - base).astype(np.uint64))
    return {
        "part": part, "seg": seg, "part_offset": at, "n_docs": len(ids), "n_ids": sum(map(len, tokens)) // width, "n_null": len(ids) - len(known), "width": width, "base_id": base,
        "ids": b"".join(tokens), "ends_low": ends.low, "ends_high": ends.high, "ends_ranks": ends.ranks, "ends_l": ends.l, "docs_low": docs.low, "docs_high": docs.high, "docs_ranks": docs.ranks, "docs_l": docs.l,
    }


def write_segments(docs: DataFrame, tokenizer_path: str, n_parts: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of docs(doc_id, text) in ascending doc_id order, unwritten."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        ids, tokens, size, seg, at = [], [], 0, 0, 0
        schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SEGMENT.split(", "))])

        def close():
            return pa.RecordBatch.from_pylist([_segment(part, seg, at, ids, tokens, enc.width)], schema)

        for batch in batches:
            known = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1), PIECE_BYTES):
                for d, t in zip(known[piece.first :], enc.encode(piece), strict=False):
                    ids.append(d)
                    tokens.append(t)
                    size += len(t) // enc.width
                    if size >= segment_ids:
                        yield close()
                        at, ids, tokens, size, seg = at + size, [], [], 0, seg + 1
                        tidy()
        if ids:
            yield close()

    tie = F.xxhash64("text")
    dealt = docs.select("doc_id", "text").repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first(), tie)
    return dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie).mapInArrow(tidied(encode, keeps=True), SEGMENT)


def read_segment(row: dict, offset: int) -> Iterator[tuple[int | None, int, int, bytes]]:
    """(doc_id, start, n_tokens, ids as little-endian 32-bit) of each document of a segment that begins at offset."""
    n, nulls = row["n_docs"], row["n_null"]
    ends = EliasFano(n, row["ends_l"], row["ends_low"], row["ends_high"], row["ends_ranks"]).select(np.arange(n))
    docs = EliasFano(n - nulls, row["docs_l"], row["docs_low"], row["docs_high"], row["docs_ranks"]).select(np.arange(n - nulls)) + row["base_id"]
    ids = np.frombuffer(row["ids"], f"<u{row['width']}")
    start = 0
    for i, end in enumerate(ends.tolist()):
        yield (None if i < nulls else int(docs[i - nulls])), offset + start, end - start, ids[start:end].astype("<u4").tobytes()
        start = end


def read_back(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from written segments."""
    # one number a range partition: this small table is written, so that Spark broadcasts it by its size
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    before = materialize(segments.sparkSession, before, "part-starts")
    dealt = segments.join(before, "part").withColumn("offset", F.col("part_start") + F.col("part_offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                got = [(d, s, n, zlib.crc32(x)) for d, s, n, x in read_segment(row, row["offset"])]
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the segments of docs to the shared folder; return that table, read again."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(spark, write_segments(docs, tokenizer_path, n), "segments")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(token_output(spark, table(spark, sf_dir, "documents"), default_tokenizer()))
