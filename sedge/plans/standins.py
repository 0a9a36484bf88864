"""Driver tables in the roles of records, chunks and jobs; each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.ids import chunk_record_id, content_id, doc_record_id
from sedge.functions.scalars import epoch_ms
from sedge.plans.registry import table

NOW_MS = 1_706_745_600_000
SILO = "main"
QUERY = "hean thion onnt"
VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]

JOBS_SQL = """
jobs AS (SELECT 'job-' || event_id AS job_id, 'doc-' || user_id AS doc_id,
  CASE event_type WHEN 'click' THEN 'Generating' WHEN 'purchase' THEN 'Generated' WHEN 'error' THEN 'Failed' ELSE 'Pending' END AS status,
  CASE WHEN event_type = 'signup' THEN 'Batch' ELSE 'Sync' END AS generation_mode,
  epoch_us(ts) // 1000 AS created_at_ms, epoch_us(ts) // 1000 + (event_id % 7) * 3600000 AS updated_at_ms, false AS stale,
  event_id % 5 AS retry_count, 3 AS max_retries, NULL::VARCHAR AS last_error,
  CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000 + (event_id % 11) * 86400000 END AS next_retry_at_ms FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = epoch_ms(F.col("ts"))
    status = F.when(F.col("event_type") == "click", "Generating").when(F.col("event_type") == "purchase", "Generated").when(F.col("event_type") == "error", "Failed").otherwise("Pending")
    return e.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"), F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("doc_id"), status.alias("status"),
        F.when(F.col("event_type") == "signup", "Batch").otherwise("Sync").alias("generation_mode"), ms.alias("created_at_ms"), (ms + F.col("event_id") % 7 * 3_600_000).alias("updated_at_ms"),
        F.lit(False).alias("stale"), (F.col("event_id") % 5).alias("retry_count"), F.lit(3).alias("max_retries"), F.lit(None).cast("string").alias("last_error"),
        F.when(F.col("event_id") % 3 != 0, ms + F.col("event_id") % 11 * 86_400_000).alias("next_retry_at_ms"),
    )


RECORDS_SQL = """
records AS (SELECT 'main-' || doc_id || '-doc' AS id, 'doc' AS doc_type, doc_id::VARCHAR AS doc_id, text AS content, [sha256(text)] AS blob_cids FROM documents
  UNION ALL SELECT 'main-' || conv_id || '-chunk-' || (turn + 1), 'chunk', conv_id::VARCHAR, text, []::VARCHAR[] FROM conversations)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, conv = F.col("doc_id").cast("string"), F.col("conv_id").cast("string")
    docs = table(spark, sf_dir, "documents").select(doc_record_id(F.lit(SILO), doc).alias("id"), F.lit("doc").alias("doc_type"), doc.alias("doc_id"), F.col("text").alias("content"), F.array(content_id(F.col("text"))).alias("blob_cids"))
    chunks = table(spark, sf_dir, "conversations").select(chunk_record_id(F.lit(SILO), conv, F.col("turn") + 1).alias("id"), F.lit("chunk").alias("doc_type"), conv.alias("doc_id"), F.col("text").alias("content"), F.array().cast("array<string>").alias("blob_cids"))
    return docs.unionByName(chunks)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("ord"), F.col("role").alias("section"), F.col("text").alias("content"))


def props(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
