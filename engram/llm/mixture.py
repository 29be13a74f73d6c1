"""Mixing sources to target weights: water-filled targets, and documents chosen by exact subset sums.

Targets. The mix has share * (all words). It is dealt to the sources by weight; a target stops at
cap * (words of its source), and what is above is dealt again by weight among the others until
none is above. The targets so reached are min(cap * words, level * weight) for one level, which
is found from the sources sorted by cap * words / weight.

Documents. A source's target is met by whole passes over all its documents and a rest below one
pass. For the rest documents are counted by exact length: of the c documents of a length the
fraction rest / words is taken, rounded down; what remains is filled from the longest lengths
down, one document of each, until at most DP_WORDS words remain; then a bounded-knapsack dynamic
program over (length, spare documents) finds the reachable sum next to what remains. All of this
works on (source, length, count): the lengths of a source are at most sqrt(2 * its words), and no
document row meets another of its group.

Choice. Which documents of a length are taken is decided by a seeded hash of doc_id and text: those
up to a limit, the hash of the last one that is taken. Documents are counted in slices of the hash
range; only the slice with the limit is looked into, row by row counted by hash, so no task sees
all documents of a length. The limits (source, length, hash) are a small table, and each row is
decided on by itself: texts are never shuffled, but for rows that share a limit's hash (repeated
rows) of which a part is taken.
Results depend on the seed alone, not on the number of slices or partitions.

Edge cases: a null text has 0 words, whatever its length else; a document of 0 words is not taken; a
null source is a source of its own, last; a source without words has target 0; repeated rows are
documents of their own (those equal in doc_id, source and text are alike, any of them is taken);
a null doc_id is hashed by its text alone; an empty table gives an empty result; other columns are
ignored or kept as they are. A very long text is counted by the JVM's own regular expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import materialize, table, whole_row

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 20_240_601
#: The dynamic program runs once at most this many words remain (or the longest document, if longer).
DP_WORDS = 1 << 16


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", cap * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("w"), "i")
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = share * F.sum("source_size").over(everything)
    # the level if all sources before this one stop at their caps
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    tried = ranked.withColumn("level", (budget - before) / left)
    # the first source in this order whose cap is above the level sets it for all after it
    tried = tried.withColumn("open", F.col("most") / F.col("w") > F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("w"), F.col("i"), F.col("level")))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    final = tried.withColumn("found", level["level"])
    return final.select("source", "source_size", F.when(F.col("found").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("found") * F.col("w"))).alias("target"))


def reach(total: int, items: list[tuple[int, int]]) -> dict[int, int]:
    """Numbers of items to take, by length, so that their sum is as near total as it can be.

    items: (length, spare). Sets of reachable sums up to 2 * total are bit strings; each item
    enters in binary parts (1, 2, 4, ... copies), and the parts are retraced from the found sum.
    """
    mask, sums, parts, seen = (1 << 2 * total + 1) - 1, 1, [], []
    for length, spare in items:
        step = 1
        while spare > 0 and length * step <= 2 * total and not sums >> total & 1:
            k = min(step, spare)
            seen.append(sums)
            parts.append((length, k))
            sums = (sums | sums << length * k) & mask
            spare, step = spare - k, step * 2
    best = next(s for d in range(total + 1) for s in (total - d, total + d) if sums >> s & 1)
    out: dict[int, int] = {}
    for (length, k), before in zip(reversed(parts), reversed(seen), strict=True):
        if not before >> best & 1:  # not reachable without this part
            out[length] = out.get(length, 0) + k
            best -= length * k
    return out


def quotas(lengths: np.ndarray, counts: np.ndarray, rest: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take for about rest words, 0 <= rest < all words."""
    words = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if rest <= 0 or words <= 0:
        return take
    rest = min(rest, words)
    # exact integers: a corpus has more words than a double or, times a count, a long can hold
    take = np.array([int(c) * rest // words if n > 0 else 0 for n, c in zip(lengths.tolist(), counts.tolist(), strict=True)], np.int64)
    left = rest - sum(int(a) * int(b) for a, b in zip(take.tolist(), lengths.tolist(), strict=True))
    order = np.argsort(-lengths)
    bound = max(dp_words, int(lengths.max()))
    for i in order:
        if left <= bound:
            break
        if lengths[i] > 0 and take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    where = {int(n): i for i, n in enumerate(lengths)}
    for length, k in reach(left, [(int(lengths[i]), int(counts[i] - take[i])) for i in order if 0 < lengths[i] <= 2 * left and counts[i] > take[i]]).items():
        take[where[length]] += k
    return take


KEY = ["no_source", "src", "size"]


def measured(docs: DataFrame, *more: Column, seed: int = SEED) -> DataFrame:
    """no_source, src, size and h, the hash that decides, of each row of docs, and more columns."""
    h = F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")
    return docs.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), n_words(F.col("text")).alias("size"), h, *more)


def choose(spark: SparkSession, sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """Sources (no_source, src, source_size, target), and limits (no_source, src, size, passes, star, part) of sized(no_source, src, size, h).

    Rows of a source and size are taken passes times, those with h < star once more, and part of those with h = star;
    part is null where all of them are taken. star is null where none is. sized is read twice; it should be a written table.
    """
    slices = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    # the hash's range from least to largest in equal slices
    named = sized.withColumn("slice", F.floor((F.col("h") / 2.0**64 + 0.5) * slices).cast("int"))
    counted = materialize(spark, named.groupBy(*KEY, "slice").agg(F.count("*").alias("n")), "slices")
    by_length = counted.groupBy(*KEY).agg(F.sum("n").alias("n"))
    per_source = by_length.groupBy("no_source", "src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aimed = targets(per_source.select(F.when(~F.col("no_source"), F.col("src")).alias("source"), "source_size"), weights, share, cap)
    aimed = aimed.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), "source_size", "target")
    aimed = materialize(spark, aimed, "targets")

    def plan(key, rows):
        import pandas as pd

        whole, target = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
        passes = min(int(target // whole), int(cap)) if whole else 0
        rest = int(round(target - passes * whole)) if passes < int(cap) else 0
        rows = rows.sort_values("size")
        extra = quotas(rows["size"].to_numpy(), rows["n"].to_numpy(), rest)
        return pd.DataFrame({"no_source": rows.no_source, "src": rows.src, "size": rows["size"], "passes": passes, "extra": extra})

    # a group's rows are the distinct lengths of one source
    planned = by_length.join(aimed, ["no_source", "src"]).groupBy("no_source", "src").applyInPandas(plan, "no_source boolean, src string, size long, passes int, extra long")
    planned = materialize(spark, planned.where("size > 0"), "plan")
    ahead = F.sum("n").over(Window.partitionBy(*KEY).orderBy("slice")) - F.col("n")
    cut = counted.withColumn("ahead", ahead).join(planned.where("extra > 0"), KEY).where("ahead < extra and extra <= ahead + n")
    near = named.join(cut.select(*KEY, "slice", (F.col("extra") - F.col("ahead")).alias("open")), [*KEY, "slice"])
    alike = near.groupBy(*KEY, "open", "h").agg(F.count("*").alias("m"))
    below = alike.withColumn("below", F.sum("m").over(Window.partitionBy(*KEY).orderBy("h")) - F.col("m"))
    last = below.where("below < open and open <= below + m")
    stars = last.select(*KEY, F.col("h").alias("star"), F.when(F.col("open") < F.col("below") + F.col("m"), F.col("open") - F.col("below")).alias("part"))
    limits = planned.drop("extra").join(stars, KEY, "left").where("passes > 0 or star is not null")
    return aimed, materialize(spark, limits, "limits")


def dealt(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows(no_source, src, size, h, ...) with copies, how often the mix takes the row."""
    found = rows.join(limits, KEY, "left")
    split = F.coalesce((F.col("h") == F.col("star")) & F.col("part").isNotNull(), F.lit(False))
    more = F.coalesce(F.col("h") <= F.col("star"), F.lit(False)).cast("int")
    clear = found.where(~split).withColumn("copies", F.coalesce("passes", F.lit(0)) + more)
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))  # rows that are alike
    tied = found.where(split).withColumn("copies", F.col("passes") + (nth <= F.col("part")).cast("int"))
    return clear.union(tied).drop("passes", "star", "part")


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words taken, repeats counted) of each row of docs."""
    sized = materialize(spark, measured(docs, F.col("doc_id")), "sizes")
    aimed, limits = choose(spark, sized)
    out = dealt(sized, limits).join(aimed, ["no_source", "src"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of the mix, a document taken twice as two rows, with the columns of docs."""
    _, limits = choose(spark, materialize(spark, measured(docs), "sizes"))
    out = dealt(measured(docs, whole_row(docs).alias("row")), limits).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark, table(spark, sf_dir, "documents"))
