"""Benchmark decontamination: short test items inside long documents, in DataFrame operations only.

Texts are lower-cased and cut into words (letters and digits of any script); a shingle is SHINGLE
consecutive words. An item is contained in a document that has at least THRESHOLD of its distinct
shingles.

Search. Containment is asymmetric: a long document's own MinHash says little of a short passage in
it, so the sketches are those of the items. Items are partitioned by size (power of two of their
number of shingles), and an item's sketch is its SKETCH least shingle hashes. Each partition has a
threshold, the greatest hash in its items' sketches: the larger the items, the lower. A document
is probed with those of its shingle hashes that lie below the highest threshold, each kept for the
partitions whose threshold it does not exceed. A document that has the share t of an item's
shingles misses all of the sketch with probability (1 - t) ** SKETCH: never for a whole passage,
6.4e-5 at t = 0.8. Each common sketch hash makes the pair a candidate.

Verification. Candidate documents are read again and the shared shingles counted by their words.

Joins: the sketches and the candidates are written tables, so Spark broadcasts them only when
their size on disk is below its own broadcast threshold, and else shuffles by hash; no document
meets another. Work on a document is linear in its length.

Edge cases: a null text counts as empty; items and documents of fewer than SHINGLE words have no
shingles and match nothing; equal items are items of their own; repeated rows give one pair each;
null ids are carried as null; an empty table gives no pairs; other columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import doc_key, materialize, table, whole_row

SHINGLE = 5
SKETCH = 6
THRESHOLD = 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def over_windows(array: Column, k: int, of) -> Column:
    """of(i) for each window start i (from 0) of k consecutive elements."""
    return F.when(F.size(array) >= k, F.transform(F.sequence(F.lit(0), F.size(array) - k), of)).otherwise(F.array())


def shingle_hashes(hashes: Column, k: int = SHINGLE) -> Column:
    """Distinct hashes of k consecutive word hashes."""
    return F.array_distinct(over_windows(hashes, k, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))))


def shingles(array: Column, k: int = SHINGLE) -> Column:
    """Distinct shingles as texts of words with a space between."""
    return F.array_distinct(over_windows(array, k, lambda i: F.array_join(F.slice(array, i + 1, k), " ")))


def hashed(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and h, the shingle hashes of text."""
    by_word = df.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    return by_word.select(*keep, shingle_hashes(F.col("w")).alias("h"))


def sketches(spark: SparkSession, items: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """(item, h, size_class, top): the least hashes of each item, and its partition's threshold."""
    own = hashed(items, "item").where(F.size("h") > 0)
    own = own.select("item", F.floor(F.log2(F.size("h"))).cast("int").alias("size_class"), F.slice(F.array_sort("h"), 1, sketch).alias("least"))
    tops = own.groupBy("size_class").agg(F.max(F.element_at("least", -1)).alias("top"))
    return materialize(spark, own.join(tops, "size_class").select("item", "size_class", "top", F.explode("least").alias("h")), "sketches")


def contained(spark: SparkSession, docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, sketch: int = SKETCH) -> DataFrame:
    """(k, k2, doc_id, item_id, n_shared, n_shingles) of docs(doc_id, text) that contain items(item_id, text).

    k and k2 are the keys of doc_key(). A row each for equal rows of docs.
    """
    items = bench.select("item_id", "text").withColumn("item", F.xxhash64("item_id", "text"))
    sk = sketches(spark, items.select("item", "text").dropDuplicates(["item"]), sketch)
    ceiling = sk.agg(F.max("top")).first()[0]  # one number
    if ceiling is None:
        ceiling = -(1 << 63)
    keyed = docs.select("doc_id", "text", *doc_key())
    probes = hashed(keyed, "k", "k2").select("k", "k2", F.explode(F.filter("h", lambda h: h <= F.lit(ceiling))).alias("h"))
    found = probes.join(sk, "h").where(F.col("h") <= F.col("top")).select("k", "k2", "item").distinct()
    candidates = materialize(spark, found, "candidates")
    wanted = items.withColumn("w", words(F.col("text"))).withColumn("want", shingles(F.col("w"))).select("item", "item_id", "want")
    pairs = keyed.join(candidates, ["k", "k2"]).join(wanted, "item")
    pairs = pairs.withColumn("have", words(F.col("text")))
    counted = pairs.select("k", "k2", "doc_id", "item_id", F.size(F.array_intersect(shingles(F.col("have")), "want")).cast("long").alias("n_shared"), F.size("want").cast("long").alias("n_shingles"))
    # written before the threshold: as a filter above it would be pushed below, and each shingle's words cut anew
    return materialize(spark, counted, "pairs").where(F.col("n_shared") >= threshold * F.col("n_shingles"))


def clean_rows(spark: SparkSession, docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with their columns."""
    bad = materialize(spark, contained(spark, docs, bench).select("k", "k2").distinct(), "contaminated")
    rows = docs.select(whole_row(docs).alias("row"), *doc_key())
    return rows.join(bad, ["k", "k2"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


ORACLE = r"""
with d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) s from d where len(w) >= 5),
bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) s from b where len(w) >= 5),
n as (select item_id, count(*) n_shingles from bs group by 1),
m as (select doc_id, item_id, count(*) n_shared from ds join bs using (s) group by 1, 2)
select doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) as containment from m join n using (item_id) where n_shared >= 0.8 * n_shingles
"""
