"""File scans: recent documents with their kind, audits, samples, pairs of staged files, page counts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.errors import InvalidParameter
from sedge.functions.scalars import mime_type

# Guards of an ingest run.
MAX_FILES, MAX_BYTES = 10_000, 20 * 1024 * 1024
KINDS = "*.{pdf,PDF,png,PNG,jpg,JPG,jpeg,JPEG}"


def file_limit(asked: int | None, most: int | None = None) -> int:
    """Files of a run: what is asked for, never 0 or above the maximum (environment, then 10,000)."""
    most = most or int(os.environ.get("SEDGE_INGEST_MAX_FILES", MAX_FILES))
    if asked is None:
        return most
    if not 1 <= asked <= most:
        raise InvalidParameter("limit", f"must be 1 to {most}")
    return asked


def scan(spark: SparkSession, path: str, pattern: str = KINDS, content: bool = True, recursive: bool = False) -> DataFrame:
    """Files with path, modificationTime, length, kind and, unless left out, content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    df = df if content else df.drop("content")
    return df.withColumn("kind", mime_type(F.col("path")))


def recent(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("modificationTime"), "path").limit(limit)


def size_guard(df: DataFrame, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): empty and oversized files are rejected."""
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too large")
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by rising seeded hash: uniform, reproducible, one top-n and no full sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def pair_by_stem(spark: SparkSession, root: str) -> DataFrame:
    """``x.bin`` joined with ``x.json``: stem, content, details."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    bins = scan(spark, root, "*.bin").select(stem(F.col("path")).alias("stem"), "content")
    details = spark.read.text(root, wholetext=True, pathGlobFilter="*.json").select(stem(F.input_file_name()).alias("stem"), F.col("value").alias("details"))
    return bins.join(details, "stem")


def extract(df: DataFrame, call: Callable[[bytes], str], out: str = "text") -> DataFrame:
    """Applies a pluggable extractor (PDF text, OCR) to ``content``; a failure becomes ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c in b["content"]:
                try:
                    rows.append((call(bytes(c)), None))
                except Exception as e:  # noqa: BLE001 - the extractor's failure is data
                    rows.append((None, str(e)))
            yield b.drop(columns="content").assign(**{out: [r[0] for r in rows], "error": [r[1] for r in rows]})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "content")
    return df.mapInPandas(run, f"{kept}, {out} string, error string")


def count_pages(df: DataFrame, pages: Callable[[bytes], int]) -> DataFrame:
    """files, failed, pages over a tree."""
    counted = extract(df, lambda c: str(pages(c)), "n")
    return counted.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum(F.col("n").cast("long")).alias("pages"))
