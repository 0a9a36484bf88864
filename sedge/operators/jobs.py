"""The job table: statistics, ready and stale jobs, the reaper, and a keyed state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.errors import Duplicate
from sedge.functions.scalars import backoff_ms

# Ages after which a job is stale, and the delays of a retry.
HOUR = 3_600_000
PENDING_AGE_MS, GENERATING_AGE_MS = 48 * HOUR, 12 * HOUR
BASE_DELAY_MS, MAX_DELAY_MS = 300_000, HOUR
REAP_LIMIT = 1000


def stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.min("created_at_ms").alias("oldest_created_ms"), F.min("updated_at_ms").alias("oldest_updated_ms"))


def oldest(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.where(F.col("status") == status).agg(F.min("created_at_ms").alias("oldest_created_ms"), F.min("updated_at_ms").alias("oldest_updated_ms"))


def _due(now_ms: int) -> Column:
    return F.col("next_retry_at_ms").isNull() | (F.col("next_retry_at_ms") <= now_ms)


def ready(jobs: DataFrame, status: str, now_ms: int, limit: int | None = None, extra: Column | None = None) -> DataFrame:
    found = jobs.where((F.col("status") == status) & _due(now_ms) & (F.lit(True) if extra is None else extra))
    return found if limit is None else found.orderBy("job_id").limit(limit)


def stale(jobs: DataFrame, status: str, age_ms: int, now_ms: int, limit: int | None = None) -> DataFrame:
    found = jobs.where((F.col("status") == status) & (F.col("updated_at_ms") <= now_ms - age_ms) & _due(now_ms))
    return found if limit is None else found.orderBy("job_id").limit(limit)


def reap(jobs: DataFrame, now_ms: int, action: str = "both", limit: int | None = REAP_LIMIT) -> DataFrame:
    """The stale jobs with their new state: columns of ``jobs`` plus ``outcome`` (requeued, failed, skipped)."""
    found = stale(jobs, "Pending", PENDING_AGE_MS, now_ms, limit).unionByName(stale(jobs, "Generating", GENERATING_AGE_MS, now_ms, limit))
    left = F.col("retry_count") < F.col("max_retries")
    outcome = {"both": F.when(left, "requeued").otherwise("failed"), "requeue": F.when(left, "requeued").otherwise("skipped"), "fail": F.lit("failed")}[action]
    found = found.withColumn("outcome", outcome)
    again, over = F.col("outcome") == "requeued", F.col("outcome") == "failed"
    return found.select(
        *[c for c in jobs.columns if c not in ("status", "stale", "retry_count", "next_retry_at_ms", "updated_at_ms", "last_error")],
        F.when(again, "Pending").when(over, "Failed").otherwise(F.col("status")).alias("status"),
        (F.col("stale") | again | over).alias("stale"),
        F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(again, now_ms + backoff_ms(F.col("retry_count"), BASE_DELAY_MS, MAX_DELAY_MS)).otherwise(F.col("next_retry_at_ms")).alias("next_retry_at_ms"),
        F.when(again | over, F.lit(now_ms)).otherwise(F.col("updated_at_ms")).alias("updated_at_ms"),
        F.when(over, "job is stale").otherwise(F.col("last_error")).alias("last_error"),
        "outcome",
    )


def reap_report(reaped: DataFrame) -> DataFrame:
    return reaped.groupBy("outcome").agg(F.count(F.lit(1)).alias("jobs"))


def latest(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """State machine in batch form: each key's value by its last event; events are pre-aggregated."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("events"))


def enqueue(jobs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): keys that exist, or came before in the batch, are rejected."""
    first = Window.partitionBy("job_id").orderBy("created_at_ms")
    numbered = new.withColumn("_n", F.row_number().over(first)).join(jobs.select("job_id", F.lit(True).alias("_known")).distinct(), "job_id", "left")
    fresh = F.col("_known").isNull() & (F.col("_n") == 1)
    return numbered.where(fresh).drop("_n", "_known"), numbered.where(~fresh).drop("_n", "_known")


def enqueue_strict(jobs: DataFrame, new: DataFrame) -> DataFrame:
    accepted, rejected = enqueue(jobs, new)
    if not rejected.limit(1).isEmpty():
        raise Duplicate("job_id exists")
    return accepted


def count_failed(responses: str, error: str = "error") -> Column:
    return F.size(F.filter(responses, lambda r: r[error].isNotNull()))


def run_summary(jobs: DataFrame, most: int = 100) -> DataFrame:
    """One row on an ingest run: how many jobs there are and in which state, and the first ``most`` failed ones
    by name; ``failed`` counts all of them."""
    state = lambda s: F.count_if(F.col("status") == s)
    counts = jobs.agg(F.count(F.lit(1)).alias("total"), state("Generated").alias("generated"), state("Generating").alias("in_flight"), state("Pending").alias("queued"), state("Failed").alias("failed"))
    first = jobs.where("status = 'Failed'").select("doc_id").distinct().orderBy("doc_id").limit(most)
    return counts.crossJoin(first.agg(F.array_sort(F.collect_list("doc_id")).alias("failed_docs")))  # one row each
