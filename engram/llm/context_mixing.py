"""Language-model scoring by logistic context mixing.

A text is a sequence of words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) and one end. Each token is a
chain of decisions: end or not, and the word's bytes with a terminator, a byte as bits along a
Huffman code. Every word is spelled so. Each bit is predicted in several contexts: hashes of the
last 1, 2, 3, 4 and 6 bytes of the word and of the word so far, some of them with the state of the
words before. A context's prediction is the stretched probability ln((n1 + d) / (n0 + d)) of the
counts in its slot of a table; the tables grow with the training tokens up to what a worker's
memory holds (table_bits). A mixer adds the predictions (Mahoney 2005) with gated weights: a set
of weights is chosen by how often two of the contexts were seen and by the place in the word. An
adaptive probability map then refines the sum by the same gate.

State. The ANCHORS most frequent words fall into CLASSES classes by which of them follow each other
(classes_of). A word's state is the class that most anchors before it in its document have: what
the document so far tells of its language or kind crosses words by it, and yet the distinct pairs
of word and state are hardly more than the distinct words, so that each is spelled once.

Within a document the model adapts online: each word's probability is an average of the above, of
the word's share of the document's earlier words, and of its share of the words that followed the
same word earlier; the shares' weights are gated by how often that was, and by how well it has foretold the document so far.

All decisions have probabilities that sum to one at most, so the text's log10 probability and its
bits per byte are those of a proper model.

Training. Spark counts the words, the anchors' neighbours, and then the distinct words by state
into a table, whose rows stand for all places of all training documents. From it tasks fill tables
of one size that are summed by block. The code, the mixer, the map and the averages' weights are
fitted by sums over tasks, each word left out of the counts it is predicted from: byte counts for
the code; NEWTON steps by gradient and curvature for each gate of the mixer; hits of each cell for
the map; and, over the documents, for the averages the places by gate and by the logarithms of
their shares' ratios (in steps of 1 / RATIO_STEPS), which is all that expectation maximisation
needs. All are then frozen, so that a document's score depends on neither order nor partition.

Base score: the unigram model with add-one smoothing. The counts of dictionary words are known to
every task (the DICTIONARY most frequent, all of one count or none); other words are counted by a join on
their hash, a row for each document and word.

Edge cases: a null or empty text is the end alone; without training documents every count is 0,
base_score is 0 and the model is flat; repeated rows are documents of their own; a null doc_id is
never held out; a text longer than a piece is one piece, and takes some 100 bytes of a worker's memory a byte;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm.common import LOWER, PLAIN_WORD, U64, HashMemo, binary_bytes, grouped, held_out, kept_by_worker, materialize, mix, pieces, powers, room, table, tidied

#: log2 of each context's slots at least: the last byte with the state, the last 2, 3, 4 with the state, 6, the word so far, and with the state.
TABLE_BITS = (16, 18, 18, 18, 18, 18, 18)
#: log2 of a context's slots at most, for the memory of two workers an executor.
MOST_BITS = 22
#: The contexts whose counts choose the gate: 4 bytes with the state, the word so far with the state.
GATE_TABLES = (3, 6)
ANCHORS = 256
CLASSES = 16
#: Slots in a block: every context has whole blocks.
BLOCK_SLOTS = 1 << 14
DICTIONARY = 1 << 18
NEWTON = 2
#: Weights before the first step; none moves by more than MOST_MOVE in one.
START = (0.05, 0.05, 0.3, 0.4, 0.1, 0.1, 0.2)
MOST_MOVE = 0.6
RATIO_STEPS = 8
#: Ratios of shares beyond exp(RATIO_MOST / RATIO_STEPS) count as that; none: the share is 0.
RATIO_MOST = 2000
DELTA = 0.4
#: Neighbouring slots among which the decisions of one step are dealt.
LINE = 64
GATES = 7 * 3 * 4
MAP_STEPS = 33
MEMO_WORDS = 2_200_000
PIECE_BYTES = 2_000_000
#: Words spelled out at a time.
BATCH_WORDS = 3_000
#: A task hands on its distinct words by state once it has so many.
TASK_PAIRS = 800_000
END = 256


# ---------------------------------------------------------------- spelling


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code lengths, and for each symbol the inner nodes and bits of its code."""
    tick = itertools.count()
    heap = [(int(c), next(tick), s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    inner = itertools.count()
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    members = {s: [s] for s in range(len(counts))}
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        node = next(inner)
        for side, part in ((0, x), (1, y)):
            for s in members[part]:
                paths[s].append((node, side))
        members[("n", node)] = members.pop(x) + members.pop(y)
        heapq.heappush(heap, (a + b, next(tick), ("n", node)))
    lens = np.array([len(p) for p in paths], np.int64)
    nodes, bits = np.zeros((len(counts), lens.max()), np.int64), np.zeros((len(counts), lens.max()), bool)
    for s, p in enumerate(paths):
        for i, (node, side) in enumerate(reversed(p)):
            nodes[s, i], bits[s, i] = node, side
    return lens, nodes, bits


def table_bits(tokens: int) -> tuple[int, ...]:
    """log2 of each context's slots, for training tokens: two slots a token, within bounds; the short contexts need no more."""
    grown = min(max((2 * tokens).bit_length(), TABLE_BITS[-1]), MOST_BITS)
    return TABLE_BITS[:2] + (grown,) * len(TABLE_BITS[2:])


def bases(bits: tuple[int, ...]) -> np.ndarray:
    """The first slot of each context, and the number of slots."""
    return np.concatenate([[0], np.cumsum([1 << b for b in bits])])


_SALT = mix(np.arange(11, 11 + len(TABLE_BITS), dtype=U64)) | U64(1)
_SYMBOL = mix(np.arange(3000, 3257, dtype=U64))
_CLASS = mix(np.arange(5000, 5000 + CLASSES + 1, dtype=U64))


@dataclass
class Spelling:
    """Some words' steps (a byte or the terminator of a word) and the decisions of their distinct ones.

    Words in one state share the steps of a common prefix: word and step give each step's word and its number among the
    n distinct ones; at, bit, place and slots are of each decision: its distinct step, its bit, the gate's place, and the slot in each context.
    """

    word: np.ndarray
    step: np.ndarray
    n: int
    at: np.ndarray
    bit: np.ndarray
    place: np.ndarray
    slots: list[np.ndarray]

    def times(self, times: np.ndarray) -> np.ndarray:
        """How often each decision occurs, from how often each word does."""
        return np.bincount(self.step, times[self.word], self.n)[self.at]

    def log10s(self, p: np.ndarray, words: int) -> np.ndarray:
        """log10 of each word's probability, from each decision's probability of bit 1."""
        of_step = np.bincount(self.at, np.log(np.where(self.bit, p, 1 - p)), self.n) / np.log(10)
        return np.bincount(self.word, of_step[self.step], words)


#: Only so many first bytes are looked at for common prefixes.
SHARED = 24


class Speller:
    """Spells words, each in a state (a class of the words before it, 0 for none)."""

    def __init__(self, lens: np.ndarray, nodes: np.ndarray, bits: np.ndarray, tables: tuple[int, ...] = TABLE_BITS):
        self.lens, self.nodes, self.bits, self.tables = lens, nodes, bits, tables

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> Spelling:
        """Of the words at starts, of sizes; those next to each other share their steps, so they are best sorted."""
        n = sizes + 1
        first = np.cumsum(n) - n
        total = int(n.sum())
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(total) - first[own]
        sym = data[np.minimum(starts[own] + step, len(data) - 1)].astype(np.int64) if len(data) else np.zeros(total, np.int64)
        sym[first + sizes] = END

        # a step is the same as that of the word above if all bytes up to it are
        grid = np.full((len(n), SHARED), -1, np.int16)
        near = np.flatnonzero(step < SHARED)
        grid[own[near], step[near]] = sym[near]
        same = np.zeros(grid.shape, bool)
        same[1:] = (grid[1:] == grid[:-1]) & (state[1:] == state[:-1])[:, None]
        np.logical_and.accumulate(same, axis=1, out=same)
        fresh = np.ones(total, bool)
        fresh[near] = ~same[own[near], step[near]]
        number = np.cumsum(fresh) - 1
        known = np.zeros(grid.shape, np.int64)
        new = near[fresh[near]]
        known[own[new], step[new]] = number[new]
        np.maximum.accumulate(known, axis=0, out=known)
        number[near] = known[own[near], step[near]]

        value = _SYMBOL[sym] * powers(int(n.max(initial=1)) + 1)[step]
        so_far = np.cumsum(value, dtype=U64) - value
        so_far -= so_far[first][own]
        mine = np.flatnonzero(fresh)
        so_far, k, deep = so_far[mine], _CLASS[state][own[mine]], step[mine]
        back = np.zeros((7, len(mine)), U64)  # the byte i places back, plus one; 0 before the word
        for i in range(1, 7):
            back[i] = (sym.take(np.maximum(mine - i, 0)) + 1) * (deep >= i)
        two = back[1] | back[2] << U64(9)
        four = two | back[3] << U64(18) | back[4] << U64(27)
        contexts = (back[1] ^ k, two, two | back[3] << U64(18), four ^ k, four | back[5] << U64(36) | back[6] << U64(45), so_far, so_far ^ k)
        symbols = sym[mine]
        length = self.lens[symbols]
        at = np.repeat(np.arange(len(mine)), length)
        # a decision's place in the code table: its symbol's row, and its depth
        code = np.arange(len(at)) + np.repeat(symbols * self.nodes.shape[1] - (np.cumsum(length) - length), length)
        bit = self.bits.ravel().take(code)
        # the node moves a slot within LINE neighbours, so that a step's decisions lie together in memory; the nodes
        # nearest to the root, which most decisions fall on, have the last numbers and so places of their own
        move = (len(self.lens) - self.nodes & LINE - 1).ravel().take(code)
        slots = []
        for context, b, base, s in zip(contexts, self.tables, bases(self.tables), _SALT, strict=False):
            home = (mix(context + s) >> U64(64 - b)).view(np.int64) + base
            slot = np.repeat(home, length)
            slot ^= move
            slots.append(slot)
        return Spelling(own, number, len(mine), at, bit, np.repeat(np.minimum(deep, 3).astype(np.uint8), length), slots)


def in_order(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """An order of words that brings common prefixes in one state together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = []
    for at in (8, 0):
        key = np.zeros(len(starts), U64)
        for i in range(at, at + 8):
            key = key << U64(8) | np.where(sizes > i, padded[np.minimum(starts + i, len(data))], 0).astype(U64)
        keys.append(key)
    return np.lexsort((*keys, state))


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(DELTA)) / (n0 + np.float32(DELTA))).astype(np.float32)


#: Steps of a stretched probability in a slot: a byte holds -127..127 of them.
STRETCH_STEP = np.float32(1 / 9)
_EXACT = stretch(np.arange(256, dtype=np.float32)[:, None], np.arange(256, dtype=np.float32)[None, :]).ravel()
_PAIRS = np.arange(1 << 16)
#: By both counts: 0 for nothing seen, then by powers of four, 6 at most.
_CONFIDENCE = np.where(_PAIRS == 0, 0, np.minimum(1 + np.log2(np.maximum((_PAIRS & 255) + (_PAIRS >> 8), 1)) // 2, 6)).astype(np.uint8)
_COARSE = np.array([0, 1, 1, 1, 2, 2, 2], np.uint8)


def gates(seen: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """A number below GATES for the confidences of the contexts of GATE_TABLES and the place in the word."""
    return ((seen[1] * np.uint8(3) + _COARSE[seen[0]]) * np.uint8(4) + place.astype(np.uint8)).astype(np.intp)


class Slots:
    """All slots: counts, in 16 bits the number of bits 0 and of bits 1, each up to 255, and their stretched probability in STRETCH_STEPs."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray):
        self.counts, self.stretched = np.zeros(len(n0), np.uint16), np.zeros(len(n0), np.int8)
        for low in range(0, len(n0), 1 << 20):
            a, b = n0[low : low + (1 << 20)], n1[low : low + (1 << 20)]
            self.stretched[low : low + (1 << 20)] = np.clip(np.rint(stretch(a, b) / STRETCH_STEP), -127, 127)
            self.counts[low : low + (1 << 20)] = np.minimum(a, 255).astype(np.uint16) << 8 | np.minimum(b, 255).astype(np.uint16)

    def inputs(self, s: Spelling) -> tuple[list[np.ndarray], np.ndarray]:
        """Each context's stretched probability, and the gate."""
        seen = [_CONFIDENCE.take(self.counts.take(s.slots[i])) for i in GATE_TABLES]
        return [self.stretched.take(x) * STRETCH_STEP for x in s.slots], gates(seen, s.place)

    def left_out(self, s: Spelling) -> tuple[list[np.ndarray], np.ndarray]:
        """The same with each decision left out of its slots once; of counts from 255 on one makes no difference."""
        out, seen, less = [], [], np.where(s.bit, np.uint16(1), np.uint16(256))
        for i, at in enumerate(s.slots):
            own = self.counts.take(at)
            exact = own - less
            x = _EXACT.take(exact)
            many = np.flatnonzero((own & 255 == 255) | (own >= 255 << 8))  # one of both counts is more than it says
            x[many] = self.stretched[at[many]] * STRETCH_STEP
            out.append(x)
            if i in GATE_TABLES:
                exact[many] = own[many]
                seen.append(_CONFIDENCE[exact])
        return out, gates(seen, s.place)


@dataclass
class Mixer:
    weights: np.ndarray  # by gate: one for each context, and a bias
    map: np.ndarray  # by gate and step of the stretched sum: a probability

    @staticmethod
    def fresh() -> "Mixer":
        grid = 1 / (1 + np.exp(-(np.arange(MAP_STEPS) - MAP_STEPS // 2) / 2))
        return Mixer(np.tile([*START, 0.0], (GATES, 1)), np.tile(grid, (GATES, 1)))

    def sums(self, gate: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        z = weights[gate, -1]
        for i, x in enumerate(inputs):
            z += weights[:, i].take(gate) * x
        return z

    @staticmethod
    def step_of(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.clip(z * 2 + MAP_STEPS // 2, 0, MAP_STEPS - 1.001)
        low = s.astype(np.int64)
        return low, s - low

    def probability(self, gate: np.ndarray, z: np.ndarray) -> np.ndarray:
        low, part = self.step_of(z)
        flat, at = self.map.astype(np.float32).ravel(), gate * MAP_STEPS + low
        refined = flat[at] * (1 - part) + flat[at + 1] * part
        return np.clip((1 / (1 + np.exp(-np.clip(z, -30, 30))) + refined) / 2, 1e-6, 1 - 1e-6)

    def slopes(self, gate: np.ndarray, inputs: list[np.ndarray], bit: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """By gate the gradient of the weighted log likelihood, and the sum of p (1 - p) x x'."""
        p = 1 / (1 + np.exp(-np.clip(self.sums(gate, inputs), -30, 30)))
        error, bend = ((bit - p) * weight).astype(np.float32), (p * (1 - p) * weight).astype(np.float32)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        x = np.empty((len(inputs) + 1, len(p)), np.float32)
        for i, values in enumerate(inputs):
            x[i] = values.take(order)
        x[-1] = 1
        right = np.concatenate([error.take(order)[None], x * bend.take(order)]).T
        ends = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=GATES))])
        out = np.zeros((GATES, len(x), len(x) + 1))
        for g in np.flatnonzero(np.diff(ends)):
            out[g] = x[:, ends[g] : ends[g + 1]] @ right[ends[g] : ends[g + 1]]
        return out

    def step(self, slopes: np.ndarray) -> None:
        """A Newton step of each gate's weights."""
        curvature = slopes[:, :, 1:] + np.eye(slopes.shape[1]) * 50
        move = np.linalg.solve(curvature, slopes[:, :, :1])[:, :, 0]
        self.weights = self.weights + move * np.minimum(MOST_MOVE / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-12), 1)

    def cells(self, gate: np.ndarray, inputs: list[np.ndarray], bit: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each cell of the map, the weight that fell there and its part with bit 1."""
        low, part = self.step_of(self.sums(gate, inputs))
        at = 2 * (gate * MAP_STEPS + low) + bit
        whole, above = (np.bincount(at, x, 2 * self.map.size).reshape(-1, 2) for x in (weight, weight * part))
        by_bit = whole - above
        by_bit[1:] += above[:-1]  # the last step's part above is never used: step_of stays below it
        return np.stack([by_bit.sum(axis=1), by_bit[:, 1]])

    def refine(self, cells: np.ndarray) -> None:
        seen, hits = cells.reshape(2, *self.map.shape)
        self.map = (hits + 200 * self.map) / (seen + 200)


# ---------------------------------------------------------------- classes of words


def classes_of(near: np.ndarray) -> np.ndarray:
    """A class 1..CLASSES of each anchor, from how often each two follow each other.

    Spectral clustering (Ng, Jordan, Weiss 2001): the rows of the normalised table's first eigenvectors, by
    k-means from the farthest points. Fewer anchors than classes are classes of their own.
    """
    k = len(near)
    if k <= CLASSES:
        return np.arange(1, k + 1)
    both = near + near.T + 1e-3
    weight = both.sum(axis=1)
    scale = 1 / np.sqrt(weight)
    _, vectors = np.linalg.eigh(both * scale[:, None] * scale[None, :])
    rows = vectors[:, -CLASSES:]
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    centres = [rows[int(weight.argmax())]]
    for _ in range(CLASSES - 1):
        far = np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(rows[int((far * weight).argmax())])
    centres = np.array(centres)
    for _ in range(30):
        own = ((rows[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([weight[own == c] @ rows[own == c] / weight[own == c].sum() if (own == c).any() else centres[c] for c in range(CLASSES)])
    return own + 1


@dataclass
class Anchors:
    """The most frequent words (sorted hashes) and their classes."""

    words: np.ndarray
    classes: np.ndarray

    def found(self, h: np.ndarray, back=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors among words, and the number of each; h: the distinct words' hashes, back: each word's number among them (or h: each word's)."""
        if not len(self.words):
            return (np.zeros(0, np.int64),) * 2
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        number = np.where(self.words[at] == h, at, -1)[back]
        place = np.flatnonzero(number >= 0)
        return place, number[place]

    def states(self, w, h: np.ndarray, back: np.ndarray) -> np.ndarray:
        """For each word the class that most anchors before it in its document have (the least of equal ones); 0: none."""
        place, which = self.found(h, back)
        doc = w.doc()
        seen = np.zeros((len(place) + 1, CLASSES + 1), np.int32)
        seen[np.arange(1, len(place) + 1), self.classes[which]] = 1
        np.cumsum(seen, axis=0, out=seen)
        start = np.searchsorted(place, w.first[:-1])  # anchors before each document
        lead = np.searchsorted(place, np.arange(w.n))  # and before each word
        # a word's state changes only at anchors: one row for each anchor, and one for each document's start
        after = np.zeros(len(place), np.int64)
        if len(place):
            after = (seen[1:] - seen[start[doc[place]]]).argmax(axis=1)
        out = np.zeros(w.n, np.int64)
        some = np.flatnonzero(lead > start[doc])
        out[some] = after[lead[some] - 1]
        return out


# ---------------------------------------------------------------- averages


def stable_order(values: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers from 0 on below 2 ** 32, by digits of 16 bits."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if values.max(initial=0) > 0xFFFF:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def earlier(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each place the number of places before it with equal keys; order brings these together, by place."""
    head = np.ones(len(order), bool)
    if len(order):
        head[1:] = np.logical_or.reduce([(k := key[order])[1:] != k[:-1] for key in keys])
    at = np.flatnonzero(head)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    return out


#: Gates of the averages: how often the word before was met earlier in the document (never, once, two or three times,
#: more often), and how often a word so far was one that had followed the same word before (by quarters).
RECALL_GATES = 4 * 4


def recall(w, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word (numbers by distinct word): gate, share of the document's earlier words, share of earlier followers."""
    doc, place = w.doc(), w.place()
    before = np.zeros(len(word), np.int64)  # the word before, plus one; 0 at the start of a document
    before[1:] = word[:-1] + 1
    before[place == 0] = 0
    by_word = stable_order(word)
    same = earlier(by_word, word, doc)
    pair = earlier(by_word[stable_order(before[by_word])], before, word, doc)
    follow = np.zeros(len(word), np.int64)  # each earlier place of the word before has a follower
    follow[1:] = same[:-1]
    follow[place == 0] = 0
    gate = np.where(follow == 0, 0, np.where(follow == 1, 1, np.where(follow < 4, 2, 3)))
    tried, met = follow > 0, (follow > 0) & (pair > 0)
    so_far = [np.cumsum(x) - x for x in (tried, met)]
    tries, hits = (x - np.repeat(x[w.first[:-1][w.counts > 0]], w.counts[w.counts > 0]) for x in so_far)
    gate = 4 * gate + np.minimum(4 * (hits + 0.2) / (tries + 2), 3).astype(np.int64)
    return gate, same / np.maximum(place, 1), np.where(follow > 0, pair / np.maximum(follow, 1), 0)


def fit_averages(gate: np.ndarray, static: np.ndarray, own: np.ndarray, after: np.ndarray, times: np.ndarray, rounds: int = 30) -> np.ndarray:
    """By gate the weights of the three shares, by expectation maximisation over rows that stand for so many places."""
    parts = np.stack([static, own, after], axis=1)
    out = np.tile([0.9, 0.05, 0.05], (RECALL_GATES, 1))
    out[:4] = [0.95, 0.05, 0.0]  # nothing has followed yet
    for _ in range(rounds):
        each = out[gate] * parts
        each *= (times / np.maximum(each.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(gate, each[:, i], RECALL_GATES) for i in range(3)], axis=1) + [[1.0, 0.1, 0.1]]
        sums[:4, 2] = 0
        out = sums / sums.sum(axis=1, keepdims=True)
    return out


@dataclass
class Model:
    """All that a task needs to score; its size is bounded by MOST_BITS and DICTIONARY."""

    slots: Slots
    anchors: Anchors
    mixer: Mixer
    code: tuple
    end: float  # probability of the end at any token
    averages: np.ndarray
    words: np.ndarray  # the dictionary: sorted hashes, counts
    counts: np.ndarray
    tokens: int
    distinct: int
    documents: int

    def spellings(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
        """log10 probability of each word's spelling."""

        def chances(some):
            inputs, gate = self.slots.inputs(some)
            return self.mixer.probability(gate, self.mixer.sums(gate, inputs))

        return spell_all(Speller(*self.code), chances, data, starts, sizes, state)

    def listed(self, h: np.ndarray) -> np.ndarray:
        """The dictionary count of each hash, 0 for other words."""
        return lookup(self.words, self.counts, h)


def spell_all(speller: Speller, chances, data: np.ndarray, *at: np.ndarray) -> np.ndarray:
    """log10 probability of each word at (starts, sizes, state); chances gives a Spelling's probabilities of bit 1."""
    out, order = np.zeros(len(at[0])), in_order(data, *at)
    for low in range(0, len(order), BATCH_WORDS):
        some = order[low : low + BATCH_WORDS]
        spelling = speller(data, *(x[some] for x in at))
        out[some] = spelling.log10s(chances(spelling), len(some))
    return out


def lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The value of each hash among sorted keys, or 0."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0)


# ---------------------------------------------------------------- passes over the documents


def distinct_words(p, data: np.ndarray):
    """Words of a piece: the distinct ones' hashes, a place of each, and each word's number among them."""
    w = p.words(PLAIN_WORD, data)
    h = w.hashes()
    back, sample = grouped(h)
    order = np.argsort(h[sample])  # ascending keys are found faster
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return w, h[sample[order]], sample[order], rank[back]


def state_hashes(h: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A hash of each word with its state."""
    return mix(h ^ _CLASS[state])


class TaskWords:
    """Distinct words of a task with their counts."""

    def __init__(self):
        self.memo, self.counts = HashMemo(), np.zeros(1 << 12, np.int64)

    def add(self, p) -> None:
        w = p.words(PLAIN_WORD, LOWER[p.data])
        self.count(w, w.hashes())

    def count(self, w, hashes: np.ndarray) -> None:
        back, sample = grouped(hashes)
        order = np.argsort(hashes[sample])
        sample, times = sample[order], np.bincount(back, minlength=len(sample))[order]
        h = hashes[sample]
        number = self.memo.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self.memo.add(h[new])
            self.counts = room(self.counts, self.memo.n)
            self.keep(w, sample[new])
        self.counts[number] += times

    def keep(self, w, at: np.ndarray) -> None:
        pass

    def hashes(self) -> np.ndarray:
        out = np.zeros(self.memo.n, U64)
        for h, n in self.memo.levels:
            out[n] = h
        return out


class TaskStates(TaskWords):
    """Distinct words by state with their counts, hashes and bytes."""

    def __init__(self, anchors: Anchors):
        super().__init__()
        self.anchors, self.parts = anchors, []

    def add(self, p) -> None:
        w = p.words(PLAIN_WORD, LOWER[p.data])
        h = w.hashes()
        back, sample = grouped(h)
        self.at = h, self.anchors.states(w, h[sample], back)
        self.count(w, state_hashes(*self.at))

    def keep(self, w, at: np.ndarray) -> None:
        h, state = (x[at] for x in self.at)
        n = (w.ends - w.starts)[at]
        data = w.data[np.arange(n.sum()) + np.repeat(w.starts[at] - np.cumsum(n) + n, n)]
        self.parts.append((h, state, n, data))

    def rows(self):
        """Batches of (h, state, n, word)."""
        done = 0
        for h, state, n, data in self.parts:
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            word = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            times = pa.array(self.counts[done : done + len(h)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(state.astype(np.int32)), times, word], ["h", "state", "n", "word"])
            done += len(h)


#: A task hands on its words once it has so many distinct ones.
TASK_WORDS = 800_000


def dealt_by_hash(rows: DataFrame) -> DataFrame:
    """rows by h. A task's rows differ all, so summing them there first would be in vain."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n) of docs(text): the distinct words' hashes and counts."""

    def rows(words):
        h, n = words.hashes(), words.counts[: words.memo.n]
        for i in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], ["h", "n"])

    def scan(batches):
        words = TaskWords()
        for batch in batches:
            for p in pieces(batch.column(0), PIECE_BYTES):
                words.add(p)
                if words.memo.n > TASK_WORDS:
                    yield from rows(words)
                    words = TaskWords()
        yield from rows(words)

    parts = docs.select("text").mapInArrow(tidied(scan), "h long, n long")
    return dealt_by_hash(parts).groupBy("h").agg(F.sum("n").alias("n"))


def find_anchors(docs: DataFrame, counted: DataFrame) -> Anchors:
    """The most frequent words of counted(h, n) with their classes, by their order in docs(text)."""
    top = [r.h for r in counted.orderBy(F.desc("n"), "h").limit(ANCHORS).select("h").collect()]
    words = np.sort(np.array(top, np.int64).view(U64))
    anchors, k = Anchors(words, np.zeros(len(words), np.int64)), len(words)

    def scan(batches):
        near = np.zeros(k * k, np.int64)
        for batch in batches:
            for p in pieces(batch.column(0), PIECE_BYTES):
                w = p.words(PLAIN_WORD, LOWER[p.data])
                place, which = anchors.found(w.hashes())
                doc = w.doc()[place]
                near += np.bincount((which[:-1] * k + which[1:])[doc[1:] == doc[:-1]], minlength=k * k)
        at = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(near[at])], ["k", "n"])

    near = np.zeros(k * k)
    if k:
        # at most ANCHORS ** 2 rows
        for row in docs.select("text").mapInArrow(tidied(scan), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            near[row.k] = row.n
    anchors.classes = classes_of(near.reshape(k, k))
    return anchors


def count_states(spark: SparkSession, docs: DataFrame, anchors: Anchors) -> DataFrame:
    """(n, state, word) of each distinct word and state of docs(text)."""
    shared = spark.sparkContext.broadcast(anchors)

    def scan(batches):
        held = TaskStates(shared.value)
        for batch in batches:
            for p in pieces(batch.column(0), PIECE_BYTES):
                held.add(p)
                if held.memo.n > TASK_PAIRS:
                    yield from held.rows()
                    held = TaskStates(shared.value)
        yield from held.rows()

    parts = docs.select("text").mapInArrow(tidied(scan), "h long, state int, n long, word binary")
    return dealt_by_hash(parts).groupBy("h", "state").agg(F.sum("n").alias("n"), F.min("word").alias("word")).select("n", "state", "word").sortWithinPartitions("state", "word")


def word_spans(batch: pa.RecordBatch):
    """Times, and data, starts, sizes and state, of a batch of (n, state, word)."""
    data, offs = binary_bytes(batch.column(2))
    return batch.column(0).to_numpy(), (data, offs[:-1], np.diff(offs), batch.column(1).to_numpy().astype(np.int64))


def spelled(code: tuple, batch: pa.RecordBatch):
    """By runs of the words of a batch of (n, state, word): their spelling and how often each decision occurs."""
    speller, (times, (data, *at)) = Speller(*code), word_spans(batch)
    for low in range(0, len(times), BATCH_WORDS):
        some = slice(low, low + BATCH_WORDS)
        spelling = speller(data, *(x[some] for x in at))
        yield spelling, spelling.times(times[some])


def count_decisions(spark: SparkSession, states: DataFrame, code: tuple) -> Slots:
    """Counts of bits 0 and 1 in every slot, over all words of states(n, state, word)."""
    shared, slots_n = spark.sparkContext.broadcast(code), int(bases(code[3])[-1])

    def scan(batches):
        tables, load = np.zeros(2 * slots_n, np.uint32), 0

        def put(some, weight, rows=slice(None)):
            bits = some.bit[rows].astype(np.int64) * slots_n
            for s in some.slots:
                np.add.at(tables, s[rows] + bits, weight.astype(np.uint32))

        def emptied(shift):
            """What the tables hold, in units of 2 ** shift; they are 0 again."""
            for b in range(0, 2 * slots_n, BLOCK_SLOTS):
                part = tables[b : b + BLOCK_SLOTS]
                if part.any():  # small counts pack well
                    kind = np.uint8 if part.max() < 1 << 8 else np.uint32
                    yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK_SLOTS], pa.int32()), pa.array([shift], pa.int32()), pa.array([zlib.compress(part.astype(kind).tobytes(), 1)], pa.binary())], ["block", "shift", "counts"])
            tables[:] = 0

        for batch in batches:
            for some, times in spelled(shared.value, batch):
                times = times.astype(np.int64)
                total = int(times.sum())  # no slot gets more
                if load + total >= 1 << 32:
                    yield from emptied(0)
                    load = 0
                if total < 1 << 32:
                    put(some, times)
                    load += total
                    continue
                for shift in range(0, 63, 16):  # by digits of 16 bits, so many at a time that no slot can wrap
                    digit = times >> shift & 0xFFFF
                    for low in range(0, len(times), 1 << 16):
                        rows = slice(low, low + (1 << 16))
                        if digit[rows].any():
                            put(some, digit[rows], rows)
                            yield from emptied(shift)
        yield from emptied(0)

    def add_up(batches):
        key, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary())], ["block", "counts"])

        for batch in batches:
            for b, shift, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != key:
                    if key is not None:
                        yield done()
                    key, total = b, np.zeros(BLOCK_SLOTS, np.int64)
                part = zlib.decompress(counts)
                total += np.frombuffer(part, np.uint8 if len(part) == BLOCK_SLOTS else np.uint32).astype(np.int64) << shift
        if key is not None:
            yield done()

    parts = few(spark, states).mapInArrow(tidied(scan), "block int, shift int, counts binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = parts.repartition(n, "block").sortWithinPartitions("block").mapInArrow(tidied(add_up), "block int, counts binary")
    out = np.zeros(2 * slots_n, np.float32)
    for row in summed.toLocalIterator():  # tables of a bounded size
        out[row.block * BLOCK_SLOTS : (row.block + 1) * BLOCK_SLOTS] = np.frombuffer(zlib.decompress(row.counts), np.float32)
    return Slots(out[:slots_n], out[slots_n:])


def few(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows in a task a core at most: each task holds tables of its own."""
    return rows.coalesce(spark.sparkContext.defaultParallelism)


def sum_arrays(rows: DataFrame, scan, size: int) -> np.ndarray:
    """The sum over tasks of an array of this size; scan gives one array for a task's batches."""

    def task(batches):
        total = scan(batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.float64))], ["k", "v"])

    out = np.zeros(size)
    # a task gives size rows at most
    for row in rows.mapInArrow(tidied(task), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[row.k] = row.v
    return out


def count_symbols(states: DataFrame) -> np.ndarray:
    """How often each byte and the terminator occur in the words of states(n, state, word), plus one."""

    def scan(batches):
        n = np.zeros(END + 1)
        for batch in batches:
            times, (data, _, sizes, _) = word_spans(batch)
            n += np.bincount(data, np.repeat(times, sizes), END + 1)
            n[END] += times.sum()
        return n

    return sum_arrays(states, scan, END + 1) + 1


def sum_decisions(spark: SparkSession, states: DataFrame, counts, mixer: Mixer, what: str) -> np.ndarray:
    """The sum of mixer.slopes or mixer.cells over all words of states(n, state, word); counts: a broadcast code and slots."""
    shared = spark.sparkContext.broadcast(mixer)
    shape = getattr(mixer, what)(np.zeros(0, np.int64), [np.zeros(0, np.float32)] * len(TABLE_BITS), np.zeros(0, bool), np.zeros(0)).shape

    def scan(batches):
        total, (code, table) = np.zeros(shape), counts.value
        for batch in batches:
            for some, times in spelled(code, batch):
                inputs, gate = table.left_out(some)
                total += getattr(shared.value, what)(gate, inputs, some.bit, times)
        return total.ravel()

    return sum_arrays(few(spark, states), scan, int(np.prod(shape))).reshape(shape)


def sum_shares(spark: SparkSession, docs: DataFrame, counts, anchors: Anchors, mixer: Mixer) -> np.ndarray:
    """The averages' weights by the places of all words of docs(text)."""
    shared = spark.sparkContext.broadcast((mixer, anchors))
    wide, name = 2 * RATIO_MOST + 2, uuid.uuid4().hex

    def log10s(data, *at):
        (code, table), mixer = counts.value, shared.value[0]

        def chances(some):
            inputs, gate = table.left_out(some)
            return mixer.probability(gate, mixer.sums(gate, inputs))

        return spell_all(Speller(*code), chances, data, *at)

    def scan(batches):
        memory = kept_by_worker(name, Memory)
        for batch in batches:
            for p in pieces(batch.column(0), PIECE_BYTES):
                w, h, _, back = distinct_words(p, LOWER[p.data])
                gate, *shares = recall(w, back)
                static = np.zeros(w.n)
                again = np.flatnonzero(shares[0] > 0)  # elsewhere both shares are 0, whatever the spelling
                static[again] = memory.scores_of(log10s, w, h, back, shared.value[1], again) * np.log(10)
                key = gate
                for share in shares:
                    ratio = np.clip(np.rint(RATIO_STEPS * (np.log(np.maximum(share, 1e-300)) - static)), -RATIO_MOST, RATIO_MOST) + RATIO_MOST + 1
                    key = key * wide + np.where(share > 0, ratio, 0).astype(np.int64)
                k, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    rows = docs.select("text").mapInArrow(tidied(scan, keeps=True), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = rows.column("k").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(k)
    k, n = k[order], n[order]
    share = lambda r: np.where(r > 0, np.exp(np.minimum((r - RATIO_MOST - 1) / RATIO_STEPS, 600)), 0)
    return fit_averages(k // wide**2, np.ones(len(k)), share(k // wide % wide), share(k % wide), n)


def fit(spark: SparkSession, docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all docs(doc_id, text), and the table (h, n) of all their words."""
    counted = materialize(spark, count_words(docs), "words")
    n_docs = docs.count()
    total = counted.agg(F.count("*"), F.sum("n")).first()
    # the least count whose words are DICTIONARY at most; the table here has a row for each count that occurs
    by_count = counted.where("n > 1").groupBy("n").agg(F.count("*").alias("m"))
    held = by_count.withColumn("held", F.sum("m").over(W.orderBy(F.desc("n")))).where(F.col("held") <= DICTIONARY)
    least = held.agg(F.min("n")).first()[0]
    # so at most DICTIONARY rows reach the driver
    top = counted.where(F.col("n") >= (1 << 62 if least is None else least)).toArrow()
    h, n = top.column("h").to_numpy().view(U64), top.column("n").to_numpy()
    order = np.argsort(h)
    distinct, words = int(total[0]), int(total[1] or 0)
    tokens = words + n_docs
    anchors = find_anchors(docs, counted)
    states = materialize(spark, count_states(spark, docs, anchors), "states")
    code = (*huffman(count_symbols(states)), table_bits(tokens))
    slots = count_decisions(spark, states, code)
    mixer, averages = Mixer.fresh(), np.tile([1.0, 0, 0], (RECALL_GATES, 1))
    if words:
        counts = spark.sparkContext.broadcast((code, slots))
        for _ in range(NEWTON):
            mixer.step(sum_decisions(spark, states, counts, mixer, "slopes"))
        mixer.refine(sum_decisions(spark, states, counts, mixer, "cells"))
        averages = sum_shares(spark, docs, counts, anchors, mixer)
        counts.destroy()
    return Model(slots, anchors, mixer, code, (n_docs + 0.5) / (tokens + 1), averages, h[order], n[order], tokens, distinct + (n_docs > 0), n_docs), counted


class Memory:
    """Spellings of words by state that a worker has met, for one model: what one task has spelled serves the next."""

    def __init__(self):
        self.memo, self.scores = HashMemo(), np.zeros(1 << 12)

    def scores_of(self, spellings, w, h: np.ndarray, back: np.ndarray, anchors: Anchors, asked: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of the spelling of each of w's words (or of those asked, by their places), in its state.

        h: the distinct words' hashes, back: each word's number among them.
        """
        state = anchors.states(w, h, back)
        asked = np.arange(w.n) if asked is None else asked
        both = back[asked] * (CLASSES + 1) + state[asked]
        place = np.full(len(h) * (CLASSES + 1), -1)
        place[both[::-1]] = asked[::-1]
        there = np.flatnonzero(place >= 0)
        sample = place[there]
        key = state_hashes(h[back[sample]], state[sample])
        order = np.argsort(key)
        there, sample, key = there[order], sample[order], key[order]
        if self.memo.n + len(key) > MEMO_WORDS:
            self.__init__()
        number = self.memo.find(key)
        new = np.flatnonzero(number < 0)
        if len(new):
            at = sample[new]
            number[new] = self.memo.add(key[new])
            self.scores = room(self.scores, self.memo.n)
            self.scores[number[new]] = spellings(w.data, w.starts[at], (w.ends - w.starts)[at], state[at])
        place[there] = number
        return self.scores[place[both]]


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, tail_h array<long>, tail_n array<int>"


def score_piece(m: Model, memory: Memory, p) -> tuple:
    """n_tokens, n_known, base, score of each document, the base without its rare words' counts, and these words: offsets, hashes, times."""
    data = LOWER[p.data]
    w, h, sample, back = distinct_words(p, data)
    c = m.listed(h)
    rare = np.flatnonzero(c == 0)
    doc, each = w.doc(), c[back]
    gate, same, after = recall(w, back)
    mix_of = m.averages[gate]
    spelled = np.exp(memory.scores_of(m.spellings, w, h, back, m.anchors) * np.log(10))
    p_word = mix_of[:, 0] * spelled + mix_of[:, 1] * same + mix_of[:, 2] * after
    add = lambda x: np.bincount(doc, x, p.n) if w.n else np.zeros(p.n)
    score = add(np.log10(np.maximum(p_word, 1e-300))) + w.counts * np.log10(1 - m.end) + np.log10(m.end)
    base = add(np.log10(c + 1.0)[back]) + np.log10(m.documents + 1.0) - (w.counts + 1) * np.log10(m.tokens + 1.0 * (m.distinct + 1))
    known = add(each > 0).astype(np.int64) + (m.documents > 0)
    place = np.full(len(h), -1)
    place[rare] = np.arange(len(rare))
    out = each == 0
    pair, n = np.unique(doc[out] * max(len(rare), 1) + place[back[out]], return_counts=True) if w.n else (np.zeros(0, np.int64),) * 2
    at = pair % max(len(rare), 1)
    offsets = np.searchsorted(pair, np.arange(p.n + 1) * max(len(rare), 1))
    return w.counts + 1, known, base, score, offsets, h[rare][at], n


def score_rows(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """SCORED of docs(doc_id, held_out, text), written; the executors then let go of the model."""
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def scan(batches):
        from pyspark import TaskContext

        memory = kept_by_worker(name, Memory)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for p in pieces(batch.column(2), PIECE_BYTES):
                n_tokens, known, base, score, offs, h, n = score_piece(shared.value, memory, p)
                ids = rid + np.arange(p.n)
                rid += p.n
                cols = [pa.array(ids), *(batch.column(i).slice(p.first, p.n) for i in range(2)), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score), pa.array(np.diff(p.offsets))]
                cols += [pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(x)) for x in (h.view(np.int64), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(tidied(scan, keeps=True), SCORED)
    scored = materialize(spark, rows, "scored")
    shared.destroy()
    return scored


def score_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores of docs(doc_id, text, held_out); the rows that are not held out train."""
    model, counted = fit(spark, docs.where(~F.col("held_out")))
    scored = score_rows(spark, docs, model)
    tails = scored.select("rid", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t"))
    tails = tails.select("rid", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("times"))
    found = tails.join(counted, "h")  # a word that was never met adds nothing
    by_row = found.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("met"))
    out = scored.drop("tail_h", "tail_n").join(by_row, "rid", "left")
    bits = -F.col("score") * float(np.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", bits.alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    return score_documents(spark, docs)
