"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact shingle sets verify them.

Words are [^\\x20\\x09-\\x0D]+, unchanged; a text's shingles are the distinct runs of SHINGLE words
(all its words as one where it has fewer). Two texts are linked if the Jaccard similarity of their
shingles is at least THRESHOLD.

Equal texts are one class: only one of them takes part, whatever the number of copies.

Forest. A text has TREES signatures of DEPTH minimum hashes. A tree is a trie over its signatures;
here it is held as sorted prefixes, and texts that agree on a prefix of d values stand below one
node of depth d. Two texts of similarity s meet at depth d in at least one tree with probability
1 - (1 - s^d)^TREES. Search starts with the long prefixes of DEPTHS; after each round the recall
is estimated from the links verified so far, each link of similarity s standing for
1 / P(meet | s) links (Horvitz-Thompson), and prefixes are shortened by one until the estimate
reaches TARGET or the shortest depth is reached. P(meet | 0.8) is 0.9993, 0.99993 and 0.999997 at
depths 6, 5 and 4. A round reads the
shingles of the texts that no round before has asked for.

Verification. Texts that meet at a node are joined to candidate components (edges to the least
text of each node, never pairs). The pairs of a component of at most BLOCK texts are verified
exactly, by products of its text-by-shingle matrix. A larger component is first measured against
its head, the least text: the Jaccard distance d is a metric, so texts a and b are certainly linked
if d(a, head) + d(b, head) <= 1 - THRESHOLD, and certainly not if the two differ by more. Its texts
are dealt to blocks by their distance (in RINGS rings); certain links are sums of block sizes, and
only the other pairs of blocks are verified as above. So near copies by the thousand, all close to
their head, cost one comparison each. A task returns for each text its number of links and the
least text it is connected to, never pairs, so results grow with the number of texts. What stays
quadratic is a component of many texts 0.1 to 0.3 from its head, in blocks of BLOCK texts.

Result, one row a document: class_id (least doc_id among documents connected by links or equal
texts), text_id (least doc_id of the equal texts), n_copies (documents with the same text, itself
included) and n_links (other texts linked to its text).

Edge cases: null and empty texts are one text without shingles, linked to none; repeated rows are
copies; null doc_ids count as copies but give no class_id or text_id unless alone (then null); a
text longer than a piece takes some 100 bytes of a worker's memory a byte; an empty table gives no
rows; other columns are ignored or kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm.common import PLAIN_WORD, U64, materialize, mix, pieces, table, tidied, whole_row
from engram.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)  # as a fraction, so that it is compared in integers
TREES = 24
DEPTH = 6
DEPTHS = (6, 5, 4)
TARGET = 0.9995
BLOCK = 512
#: Rings of distance from the head that make up 1 - THRESHOLD.
RINGS = 8

_MULTIPLIERS = mix(np.arange(1, TREES * DEPTH + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingle_runs(w) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some documents, and the offset of each document in them."""
    h = w.hashes()
    runs, at = w.windows(h, SHINGLE)
    doc = w.doc()
    owner = doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(short):
        extra = np.array([mix(np.array([hash_of(h[w.first[i] : w.first[i + 1]])], U64))[0] for i in short], U64)
        runs, owner = np.concatenate([runs, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        runs, owner = runs[order], owner[order]
    return runs, np.searchsorted(owner, np.arange(len(w.counts) + 1))


def hash_of(words: np.ndarray) -> int:
    total = len(words)
    for x in words.tolist():
        total = (total * 0x9E3779B97F4A7C15 + x) & (1 << 64) - 1
    return total


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, sig: TREES * DEPTH ints or null) of docs(doc_id, t1, t2, text)."""

    def scan(batches):
        for batch in batches:
            for p in pieces(batch.column(3)):
                runs, offsets = shingle_runs(p.words(PLAIN_WORD))
                full = np.flatnonzero(np.diff(offsets) > 0)
                sig = np.zeros((p.n, len(_MULTIPLIERS)), np.int32)
                if len(full):
                    starts = offsets[full]
                    for i, m in enumerate(_MULTIPLIERS):
                        sig[full, i] = (np.minimum.reduceat(runs * m, starts) >> U64(33)).astype(np.int32)
                offs = np.arange(p.n + 1, dtype=np.int32) * sig.shape[1]
                empty = np.ones(p.n, bool)
                empty[full] = False
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(sig.ravel()), mask=pa.array(empty))
                part = [batch.column(i).slice(p.first, p.n) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*part, lists], ["doc_id", "t1", "t2", "sig"])

    return docs.select("doc_id", "t1", "t2", "text").mapInArrow(tidied(scan), "doc_id long, t1 long, t2 int, sig array<int>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(rid, shingles: sorted distinct longs) of rows(rid, text)."""

    def scan(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                runs, offsets = shingle_runs(p.words(PLAIN_WORD))
                doc = np.repeat(np.arange(p.n), np.diff(offsets))
                order = np.lexsort((runs, doc))
                r, d = runs[order], doc[order]
                head = np.ones(len(r), bool)
                head[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
                r, d = r[head], d[head]
                offs = np.searchsorted(d, np.arange(p.n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(r.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, p.n), lists], ["rid", "shingles"])

    return rows.select("rid", "text").mapInArrow(tidied(scan), "rid long, shingles array<long>")


def meet(s: np.ndarray, depth: int) -> np.ndarray:
    """Probability that texts of similarity s share a prefix of this depth in some tree."""
    return 1 - (1 - s**depth) ** TREES


def links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each two sets are linked, and their similarity."""
    lens = np.array([len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lens)
    use = n[at] > 1  # a shingle of one text is shared by none
    rank = np.cumsum(n > 1) - 1
    col, row = rank[at[use]], owner[use]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [low, low + width])
        x = np.zeros((len(sets), min(width, int(col[-1]) + 1 - low)), np.float32)
        x[row[a:b], col[a:b] - low] = 1
        both += x @ x.T
    union = lens[:, None] + lens[None, :] - both
    linked = THRESHOLD[1] * both >= THRESHOLD[0] * union
    np.fill_diagonal(linked, False)
    return linked, both / np.maximum(union, 1)


def least_connected(linked: np.ndarray) -> np.ndarray:
    """For each row the least number it is connected to."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(rows: DataFrame, depth: int) -> DataFrame:
    """(rid, root, n_links, weight) from rows(comp, i, j, block, rid, shingles), dealt by comp, i, j and sorted by these and rid."""

    def task(i, j, block, rid, sets):
        block, rid = np.array(block), np.array(rid)
        linked, s = links(sets)
        if i != j:
            linked &= block[:, None] != block[None, :]
        weight = np.where(linked, 1 / np.maximum(meet(s, depth), 1e-9), 0).sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(rid[least_connected(linked)]), pa.array(linked.sum(axis=1).astype(np.int64)), pa.array(weight)], ["rid", "root", "n_links", "weight"])

    def scan(batches):
        key, held = None, ([], [], [])
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            block, rid, lists = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            values, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            for x, new in enumerate(keys):
                if new != key:
                    if key is not None:
                        yield task(key[1], key[2], *held)
                    key, held = new, ([], [], [])
                if held[1] and held[1][-1] == rid[x]:  # equal rows of the input
                    continue
                held[0].append(block[x])
                held[1].append(rid[x])
                held[2].append(values[offs[x] : offs[x + 1]].copy())
        if key is not None:
            yield task(key[1], key[2], *held)

    return rows.select("comp", "i", "j", "block", "rid", "shingles").mapInArrow(tidied(scan), "rid long, root long, n_links long, weight double")


def text_key() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.hash("text").alias("t2")]


def node_edges(reps: DataFrame, depth: int) -> DataFrame:
    """(u, v): each text and the least text below the same node of this depth, if they differ."""
    nodes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.slice("sig", t * DEPTH + 1, depth)))
    below = reps.where("sig is not null").select("rid", F.explode(nodes).alias("node"))
    heads = below.groupBy("node").agg(F.min("rid").alias("head"), F.count("*").alias("n")).where("n > 1").select("node", "head")
    return below.join(heads, "node").where("rid != head").select(F.col("rid").alias("u"), F.col("head").alias("v")).distinct()


def place(spark: SparkSession, comps: DataFrame, sets: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of blocks to be verified, (rid, comp, block, i, j), and the certain links, (rid, root, n_links, weight), of comps(node, root)."""
    sizes = comps.groupBy("root").agg(F.count("*").alias("n"))
    sized = comps.join(sizes, "root").select(F.col("node").alias("rid"), F.col("root").alias("comp"), "n")
    whole = sized.where(F.col("n") <= BLOCK).select("rid", "comp", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    large = sized.where(F.col("n") > BLOCK).join(sets, "rid")
    heads = large.where("rid = comp").select("comp", F.col("shingles").alias("head")).dropDuplicates(["comp"])
    both = F.size(F.array_intersect("shingles", "head"))
    away = 1 - both / (F.size("shingles") + F.size("head") - both)
    wide = 1 - THRESHOLD[0] / THRESHOLD[1]
    ringed = materialize(spark, large.join(heads, "comp").select("rid", "comp", F.floor(away * (RINGS / wide) + 1e-9).cast("int").alias("ring")), "rings", light=True)
    split = ringed.groupBy("comp", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    dealt = ringed.join(split, ["comp", "ring"]).select("rid", "comp", "ring", (F.shiftleft("ring", 24) + part).alias("block"))
    blocks = dealt.groupBy("comp", "block").agg(F.first("ring").alias("ring"), F.count("*").alias("size"))
    other = blocks.select(F.col("comp").alias("comp2"), F.col("block").alias("other"), F.col("ring").alias("ring2"), F.col("size").alias("size2"))
    pairs = blocks.join(other, F.col("comp") == F.col("comp2")).where(F.abs(F.col("ring") - F.col("ring2")) <= RINGS)
    linked = F.col("ring") + F.col("ring2") + 2 <= RINGS  # the outer edges of both rings
    doubt = pairs.where(~linked).select("comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    open_pairs = dealt.join(doubt, ["comp", "block"]).select("rid", "comp", "block", "i", "j")

    # a certain link's similarity is known to its rings: the least that it can be stands for it
    least = 1 - (F.col("ring") + F.col("ring2") + 2) * (wide / RINGS)
    one = 1 / (1 - F.pow(1 - F.pow(least, depth), TREES))
    own = (F.col("block") == F.col("other")).cast("int")
    sums = pairs.where(linked).groupBy("comp", "block").agg(F.sum(F.col("size2") - own).alias("n_links"), F.sum((F.col("size2") - own) * one).alias("weight"))
    sure = dealt.join(sums, ["comp", "block"]).select("rid", F.col("comp").alias("root"), "n_links", "weight")
    return whole.union(open_pairs), sure


def near_duplicates(spark: SparkSession, docs: DataFrame, depths: tuple = DEPTHS, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """Texts (rid, t1, t2, text_id, n_copies), and classes (rid, root, n_links) of the texts that have links."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_key())
    by_text = signatures(keyed).groupBy("t1", "t2").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    reps = materialize(spark, by_text.withColumn("rid", F.monotonically_increasing_id()), "texts")

    sets = None
    for depth in depths:
        comps = components(spark, node_edges(reps, depth))
        asked = comps.select(F.col("node").alias("rid"))
        asked = asked if sets is None else asked.join(sets.select("rid"), "rid", "left_anti")
        asked = materialize(spark, asked.join(reps.select("rid", "t1", "t2", "text_id"), "rid"), "asked", light=True)
        # one document of each text: the one whose id names it (null ids only where there is no other)
        # a sort-merge join whatever the size, so that the texts' one shuffle is the same share of any input
        own = keyed.join(asked.hint("merge"), ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("text_id")))
        own = own.dropDuplicates(["t1", "t2"]).select("rid", "text")  # equal rows; in place, as the rows lie by text
        more = materialize(spark, shingle_sets(own), "shingles")
        sets = more if sets is None else sets.union(more)
        placed, sure = place(spark, comps, sets, depth)
        rows = placed.join(sets, "rid").repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rid")
        found = materialize(spark, verify(rows, depth), "links").union(materialize(spark, sure, "sure-links", light=True))
        n, all_links = found.agg(F.sum("n_links"), F.sum("weight")).first()
        if not n or n / all_links >= target:
            break
    counts = found.groupBy("rid").agg(F.sum("n_links").alias("n_links"))
    roots = components(spark, found.where("rid != root").select(F.col("rid").alias("u"), F.col("root").alias("v")))
    classes = counts.join(roots, counts["rid"] == roots["node"]).select("rid", "root", "n_links")
    return reps.drop("sig"), materialize(spark, classes, "classes", light=True)


def class_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(t1, t2, class_id, text_id, n_copies, n_links) of each text of docs."""
    reps, classes = near_duplicates(spark, docs)
    known = reps.join(classes, "rid", "left").withColumn("root", F.coalesce("root", "rid")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    ids = known.where("n_links > 0").groupBy("root").agg(F.min("text_id").alias("least"))
    joined = known.join(ids, "root", "left").withColumn("class_id", F.coalesce("least", "text_id"))
    return materialize(spark, joined.select("t1", "t2", "class_id", "text_id", "n_copies", "n_links"), "text-classes", light=True)


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the least doc_id, one of equal rows (a row of null id where there is no other)."""
    classes = class_rows(spark, docs)
    keep = classes.where(F.col("text_id").eqNullSafe(F.col("class_id")))
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("d"), *text_key())
    kept = rows.join(keep.select("t1", "t2", "text_id"), ["t1", "t2"]).where(F.col("d").eqNullSafe(F.col("text_id")))
    first = F.row_number().over(W.partitionBy("t1", "t2").orderBy(F.lit(0)))
    return kept.withColumn("nth", first).where("nth = 1").select("row.*")


ORACLE = r"""
with recursive t as (select text, min(doc_id) as text_id, count(*) as n_copies from documents group by text),
w as (select text_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from t),
s as (select distinct text_id, array_to_string(w[i:i + 4], ' ') as g from w, unnest(range(1, greatest(len(w) - 3, 2))) as r(i) where len(w) > 0),
n as (select text_id, count(*) as c from s group by 1),
p as (select a.text_id as a, b.text_id as b, count(*) as both_have from s a join s b on a.g = b.g and a.text_id <> b.text_id group by 1, 2),
l as (select a, b from p join n x on x.text_id = a join n y on y.text_id = b where 5 * both_have >= 4 * (x.c + y.c - both_have)),
r(node, other) as (select a, a from l union select node, b from r join l on a = other),
c as (select node, min(other) as least_id from r group by 1), k as (select a as node, count(*) as n_links from l group by 1)
select d.doc_id, least(coalesce(c.least_id, t.text_id), t.text_id) as class_id, t.text_id, t.n_copies, coalesce(k.n_links, 0) as n_links
from documents d join t on t.text is not distinct from d.text left join c on c.node = t.text_id left join k on k.node = t.text_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", *text_key())
    return keyed.join(class_rows(spark, docs), ["t1", "t2"]).select("doc_id", "class_id", "text_id", "n_copies", "n_links")
