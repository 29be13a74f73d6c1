"""The corpus pipeline: quality rules, near duplicates, decontamination, source mixing, token output.

Each stage works on all rows that its predecessor kept. A stage's result is written as Parquet to
the shared folder and read again as the next one's input, so an executor lost in one stage never
costs the work of another. All stages but the last return the columns of documents.

Edge cases, of every stage (its operator's docstring says more): a null or empty text has no words,
so the quality rules reject it; a null lang is a language, a null source a source of its own; a null
doc_id is carried; repeated rows are copies, of which one stays; further columns are carried; texts
are taken whole, however long; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm import decontamination, mixture, near_duplicates, quality_rules, token_output
from engram.llm.common import materialize, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(spark, docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or near-equal texts."""
    return near_duplicates.one_of_each(spark, docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean_rows(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; one that the mix takes twice is there twice."""
    return mixture.mixed_rows(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to files, and each document's place, read back from these."""
    return token_output.read_back(token_output.token_output(spark, docs, token_output.default_tokenizer()))


STAGES = [
    ("quality_rules", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("source_mixing", mixed_documents),
    ("token_output", tokens),
]

#: SQL expresses neither the smoothed perplexity nor the tokenizer; tests hold each operator against brute force, and run() against a naive composition of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
