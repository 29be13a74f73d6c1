"""Readers: text folders, metric text, JSON tables, simple YAML settings, embeddings by a cache."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(name, text) of each file that is not blank."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return rows.where(F.rlike("text", F.lit(r"\S")))


def metric_samples(lines: DataFrame, value: str = "value") -> DataFrame:
    """(metric, type, suffix, labels, value) of metric text in the usual exposition format, one line a row.

    A sample belongs to the family of its # TYPE line; counters are found with and without _total.
    """
    line = F.trim(F.col(value))
    types = lines.select(F.regexp_extract(line, r"^# TYPE (\S+) (\S+)$", 1).alias("family"), F.regexp_extract(line, r"^# TYPE (\S+) (\S+)$", 2).alias("type")).where("family != ''")
    types = types.withColumn("family", F.when(F.col("type") == "counter", F.regexp_replace("family", "_total$", "")).otherwise(F.col("family"))).distinct()
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})? +(\S+)(?: +\d+)?$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    rows = lines.where(~F.startswith(line, F.lit("#")) & F.rlike(line, F.lit(pattern))).select(part(1).alias("name"), part(2).alias("raw"), part(3).alias("v"))
    pairs = F.arrays_zip(F.regexp_extract_all("raw", F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(1)).alias("k"), F.regexp_extract_all("raw", F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(2)).alias("v"))
    suffix = F.regexp_extract("name", r"(_bucket|_count|_sum|_total)$", 1)
    rows = rows.withColumn("suffix", suffix).withColumn("base", F.regexp_replace("name", r"(_bucket|_count|_sum|_total)$", ""))
    number = F.when(F.col("v") == "+Inf", F.lit(float("inf"))).when(F.col("v") == "-Inf", F.lit(float("-inf"))).otherwise(F.col("v").try_cast("double"))
    rows = rows.select("name", "base", "suffix", F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"]))).alias("labels"), number.alias("value"))
    whole = rows.join(types, rows["name"] == types["family"], "left").select(rows["*"], "family", "type")
    own = whole.where("family is not null").withColumn("suffix", F.lit("")).withColumn("metric", F.col("name"))
    rest = whole.where("family is null").drop("family", "type").join(types, F.col("base") == F.col("family"), "left").withColumn("metric", F.coalesce("family", "name"))
    rest = rest.withColumn("suffix", F.when(F.col("family").isNull(), F.lit("")).otherwise(F.col("suffix")))
    return own.select("metric", "type", "suffix", "labels", "value").unionByName(rest.select("metric", "type", "suffix", "labels", "value"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files; no rows where there is no such file, nulls where a row cannot be read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def settings_text(text: str) -> dict:
    """Nested mappings of scalars, and lists of such, in the block style of YAML."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        pass

    def scalar(s: str):
        s = s.split(" #")[0].strip()
        if s[:1] in "\"'" and s[-1:] == s[:1]:
            return s[1:-1]
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s.lower(), s)

    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(i: int, depth: int):
        out = [] if rows[i][1].startswith("- ") or rows[i][1] == "-" else {}
        while i < len(rows) and rows[i][0] >= depth:
            at, line = rows[i]
            if isinstance(out, list):
                inner = line[1:].strip()
                if ":" in inner and not inner.startswith(("\"", "'")):
                    rows[i] = (at + 2, inner)
                    value, i = block(i, at + 2)
                    out.append(value)
                else:
                    out.append(scalar(inner))
                    i += 1
                continue
            if line.startswith("- ") and at <= depth and out:
                break
            key, _, rest = line.partition(":")
            if rest.strip() and not rest.strip().startswith("#"):
                out[key.strip()], i = scalar(rest), i + 1
            elif i + 1 < len(rows) and (rows[i + 1][0] > at or rows[i + 1][0] == at and rows[i + 1][1].startswith("- ")):
                out[key.strip()], i = block(i + 1, rows[i + 1][0])
            else:
                out[key.strip()], i = None, i + 1
        return out, i

    return block(0, rows[0][0])[0] if rows else {}


class Embedder(Protocol):
    """An embedding model: vectors of texts."""

    dim: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in for a model: signed hashed words, of unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        import numpy as np

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()


def embed(text: Column, model: Embedder) -> Column:
    """Vectors in Arrow batches; blank texts and texts that the model cannot take get zeros."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        zero = [0.0] * model.dim
        full = [i for i, t in enumerate(values) if t and t.strip()]
        out = [zero] * len(values)
        for i in range(0, len(full), 256):
            some = full[i : i + 256]
            try:
                for j, v in zip(some, model([values[j] for j in some]), strict=True):
                    out[j] = v
            except ValueError:
                continue
        return pa.array(out, pa.list_(pa.float32()))

    return vectors(text)


def with_embeddings(rows: DataFrame, cache: DataFrame, model: Embedder, name: str = "default") -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, new cache rows): the model sees each missing text once."""
    keyed = rows.withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))
    known = cache.where(F.col("model") == name).select("text_key", "embedding")
    missing = keyed.select("text_key", "text").dropDuplicates(["text_key"]).join(known, "text_key", "left_anti")
    fresh = missing.select("text_key", F.lit(name).alias("model"), embed(F.col("text"), model).alias("embedding"))
    return keyed.join(known.unionByName(fresh.select("text_key", "embedding")), "text_key", "left").drop("text_key"), fresh
