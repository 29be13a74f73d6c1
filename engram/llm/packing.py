"""Cost-balanced packing of tokenized documents into sequences.

A document's ids are packed into sequences of at most SEQUENCE_TOKENS tokens. A piece of n tokens costs
n + n * n / ATTENTION: linear layers, and attention within the piece. Each task fills shards of
some SHARD_TOKENS tokens with its documents as it reads them and packs each shard:

* The shard's tokens make as many full sequences as they can; the rest, below one sequence,
  becomes sequences of lengths that are powers of two. So the lengths of all sequences are fixed
  before, all of them are filled, and none is padded (a sequence is padded to SEQUENCE_TOKENS
  except at a power of two).
* A document longer than a sequence is cut into full sequences of its own and a last piece.
* These pieces are assigned by descending length, each to the sequence of the lowest cost among
  those with room for it whole; where none has room, the sequence of the lowest cost with any room takes as
  much as it has, and the rest is assigned next.

Documents are never shuffled: a hot source or a group of copies costs what its texts cost, a lost
executor its unfinished tasks. Costs are balanced within a shard, that is over some thousand sequences that
follow each other in the table; a table sorted by length has cheaper and dearer shards. Pieces are
the same at each run over the same files; sequence ids are unique, not dense.

Edge cases: a null or empty text has the end id only; repeated rows are packed each, a null doc_id
is carried; an empty table gives no pieces; other columns are ignored. A very long text makes one
longer shard; it takes some 150 bytes of a worker's memory a byte while it is tokenized.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from engram.llm.common import kept_by_worker, pieces, table, tidied, tidy
from engram.llm.token_output import Encoder

SEQUENCE_TOKENS = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Tokens at which a piece's attention costs as much as its linear layers.
ATTENTION = 4096
#: A shard closes at so many tokens, or documents.
SHARD_TOKENS = 1 << 21
SHARD_DOCS = 1 << 15
PIECE_BYTES = 500_000


def cost(n: np.ndarray | int) -> np.ndarray | float:
    """The estimated cost of a piece of n tokens."""
    return n + n * n / ATTENTION


def rooms(total: int, most: int = SEQUENCE_TOKENS) -> np.ndarray:
    """Lengths of the sequences that total tokens fill: full ones, then powers of two."""
    rest = total % most
    return np.array([most] * (total // most) + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1], np.int64)


def pack(lengths: np.ndarray, most: int = SEQUENCE_TOKENS) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that pack documents of the given lengths; all sequences are full."""
    lengths = np.asarray(lengths, np.int64)
    full = lengths // most
    n_full = int(full.sum())
    owner = np.repeat(np.arange(len(lengths)), full)
    start = (np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)) * most
    out = [np.stack([owner, start, np.full(n_full, most), np.arange(n_full), np.zeros(n_full, np.int64)], 1)]
    rest = lengths % most
    room = rooms(int(rest.sum()), most)
    size, spent = room.copy(), np.zeros(len(room))
    rows = []
    for d in np.argsort(-rest, kind="stable").tolist():
        left, at = int(rest[d]), int(full[d]) * most
        while left:
            fits = room >= left
            s = int(np.where(fits, spent, np.inf).argmin())
            if not fits[s]:
                s = int(np.where(room > 0, spent, np.inf).argmin())
            n = min(left, int(room[s]))
            rows.append((d, at, n, n_full + s, int(size[s] - room[s])))
            room[s] -= n
            spent[s] += cost(n)
            at, left = at + n, left - n
    return np.concatenate([*out, np.array(rows, np.int64).reshape(-1, 5)])


class WordEncoder(Encoder):
    """Ids of texts with another end id. The tokenizer works on words and drops white space, so a text may be cut where Encoder cuts it."""

    def __init__(self, path: str, end_id: int):
        super().__init__(path)
        self.end = np.array([end_id], self.type).tobytes()


def encoder(path: str, end_id: int) -> WordEncoder:
    return kept_by_worker(f"encoder {path} {end_id}", lambda: WordEncoder(path, end_id))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, most: int = SEQUENCE_TOKENS, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, with_ids: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, ids.

    ids: little-endian unsigned 32-bit, null without with_ids. A sequence is its pieces by offset. most is a power of two.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the length of a sequence is a power of two")
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, end_id)
        next_id = TaskContext.get().partitionId() << 40
        known, tokens, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal next_id
            lens = np.array([len(t) // enc.width for t in tokens], np.int64)
            rows = pack(lens, most)
            length = np.bincount(rows[:, 3], rows[:, 2]).astype(np.int64)
            parts = [np.frombuffer(tokens[d], enc.type)[a : a + n].astype("<u4").tobytes() for d, a, n in rows[:, :3].tolist()]
            arrays = [pa.array([known[d] for d in rows[:, 0].tolist()], pa.int64()), *map(pa.array, (rows[:, 1], rows[:, 2])), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            arrays += [*map(pa.array, (lens[rows[:, 0]], rows[:, 3] + next_id, rows[:, 4], length[rows[:, 3]])), pa.array(parts if with_ids else [None] * len(parts), pa.binary())]
            next_id += len(length)
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1), PIECE_BYTES):
                for d, t in zip(ids[piece.first :], enc.encode(piece), strict=False):
                    known.append(d)
                    tokens.append(t)
                    size += len(t) // enc.width
                    if size >= shard_tokens or len(known) >= shard_docs:
                        yield close()
                        known, tokens, size = [], [], 0
                        tidy()
        if known:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(tidied(run, keeps=True), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False).drop("ids")
