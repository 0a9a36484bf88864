"""Corpus pipeline: filter, deduplicate, mix and pack the table ``documents``.

Each stage gets what its predecessor kept, read back from Parquet.  All but the last return the columns
of ``documents``: the classifier drops junk, exact dedup keeps one of equal texts, the Jaccard join
(five words, similarity 0.8) keeps one document of each group of near copies, mixing repeats or leaves
out documents to meet the sources' targets, and packing returns the pieces of the training sequences.

Defined results: rows are told apart by keys of their own, so null or repeated ids lose no text; a null text
counts as empty, which the classifier rejects (it has no words to judge); a null source is a source; extra
columns pass through the stages unchanged, whatever their names, and end at packing; an empty table, or one of
which the classifier keeps nothing, gives no piece; texts of any length go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import common, exact_dedup, jaccard, mixing, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_representatives(docs, k=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot train the classifier; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scratch() as keep:  # what a stage has staged goes when its result is written, and so does its input
            docs = keep(common.stage(stage(spark, before, sf_dir), name.replace(" ", "-")))
        common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
