"""Sinks: JSON lines, tab-separated audits, staged payload pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sedge.operators.usage import audit_tsv


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "true"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_audit(audited: DataFrame, path: str) -> None:
    audit_tsv(audited).write.mode("errorifexists").text(path)


def stage_payloads(payloads: DataFrame, path: str) -> None:
    """Payloads (doc_id, content, details) waiting for a batch, partitioned by hash prefix of the id."""
    payloads.withColumn("prefix", F.substring("doc_id", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def load_payload(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """Prunes to one partition before it filters; the prefix is text, even where all are digits."""
    staged = spark.read.parquet(path).schema
    schema = StructType([StructField(f.name, StringType() if f.name == "prefix" else f.dataType) for f in staged])
    return spark.read.schema(schema).parquet(path).where((F.col("prefix") == doc_id[:2]) & (F.col("doc_id") == doc_id))


def without_payloads(payloads: DataFrame, done: DataFrame) -> DataFrame:
    return payloads.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
