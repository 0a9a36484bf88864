"""Queries: jobs, the reaper, usage, summaries, small scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import scalars as sc
from sedge.operators import jobs as jb
from sedge.operators import store, usage
from sedge.plans.registry import query, table
from sedge.plans.standins import JOBS_SQL, NOW_MS, jobs, props
from sedge.sources import portal

_DUE = f"(next_retry_at_ms IS NULL OR next_retry_at_ms <= {NOW_MS})"


@query(f"WITH {JOBS_SQL} SELECT status, count(*) AS jobs, min(created_at_ms) AS oldest_created_ms, min(updated_at_ms) AS oldest_updated_ms FROM jobs GROUP BY 1")
def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.stats(jobs(spark, sf_dir))


@query(f"WITH {JOBS_SQL} SELECT min(created_at_ms) AS oldest_created_ms, min(updated_at_ms) AS oldest_updated_ms FROM jobs WHERE status = 'Failed'")
def job_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.oldest(jobs(spark, sf_dir), "Failed")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS events FROM events GROUP BY 1")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {JOBS_SQL} SELECT job_id, status, created_at_ms, retry_count FROM jobs WHERE job_id = 'job-42'")
def job_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get(jobs(spark, sf_dir), "job_id", "job-42").select("job_id", "status", "created_at_ms", "retry_count")


@query(f"WITH {JOBS_SQL} SELECT job_id, updated_at_ms FROM jobs WHERE status = 'Pending' AND generation_mode = 'Batch' AND {_DUE}")
def ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.ready(jobs(spark, sf_dir), "Pending", NOW_MS, extra=F.col("generation_mode") == "Batch").select("job_id", "updated_at_ms")


@query(f"WITH {JOBS_SQL} SELECT job_id, updated_at_ms FROM jobs WHERE status = 'Generating' AND updated_at_ms <= {NOW_MS - 12 * 3600000} AND {_DUE}")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.stale(jobs(spark, sf_dir), "Generating", jb.GENERATING_AGE_MS, NOW_MS).select("job_id", "updated_at_ms")


_REAPED = f"""{JOBS_SQL}, r AS (SELECT *, CASE WHEN retry_count < max_retries THEN 'requeued' ELSE 'failed' END AS outcome FROM jobs
 WHERE {_DUE} AND (status = 'Pending' AND updated_at_ms <= {NOW_MS - 48 * 3600000} OR status = 'Generating' AND updated_at_ms <= {NOW_MS - 12 * 3600000}))"""


@query(f"""WITH {_REAPED} SELECT job_id, outcome, CASE outcome WHEN 'requeued' THEN 'Pending' ELSE 'Failed' END AS status, CASE outcome WHEN 'requeued' THEN retry_count + 1 ELSE retry_count END AS retry_count,
 CASE outcome WHEN 'requeued' THEN ({NOW_MS} + least(300000 * (2 ** retry_count)::BIGINT, 3600000))::BIGINT ELSE next_retry_at_ms END AS next_retry_at_ms FROM r""")
def reap_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.reap(jobs(spark, sf_dir), NOW_MS, limit=None).select("job_id", "outcome", "status", "retry_count", "next_retry_at_ms")


@query(f"WITH {_REAPED} SELECT outcome, count(*) AS jobs FROM r GROUP BY 1")
def reap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.reap_report(jb.reap(jobs(spark, sf_dir), NOW_MS, limit=None))


@query("SELECT event_id, greatest(300000, least(3600000, (300000 * 2 ** least(event_id % 30, 20))::BIGINT))::BIGINT AS delay_ms FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sc.backoff_ms(F.col("event_id") % 30, jb.BASE_DELAY_MS, jb.MAX_DELAY_MS).alias("delay_ms"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Running' WHEN 2 THEN 'Running' WHEN 3 THEN 'Succeeded' WHEN 4 THEN 'Failed' WHEN 5 THEN 'Failed' ELSE 'Pending' END AS state FROM events""")
def state_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("queued", "running", "paused", "succeeded", "partially_succeeded", "expired")], F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", sc.provider_state(F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))).alias("state"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) AS responses FROM events GROUP BY 1")
def count_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.when(F.col("event_type") == "error", F.col("props")).alias("error"))).alias("responses"))
    return r.select("user_id", jb.count_failed("responses").cast("long").alias("failed"), F.size("responses").cast("long").alias("responses"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') || ' UTC' AS at FROM events")
def format_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sc.format_ms(sc.epoch_ms(F.col("ts"))).alias("at"))


@query("SELECT event_id, (k + user_id)::BIGINT AS input_total, k AS output_total, (2 * k + user_id + 3)::BIGINT AS total, greatest(k + user_id - 50, 0)::BIGINT AS effective_input FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = props(table(spark, sf_dir, "events"))
    u = e.select("event_id", F.create_map(F.lit("text"), F.col("k"), F.lit("image"), F.col("user_id")).alias("input"), F.create_map(F.lit("text"), F.col("k")).alias("output"), F.lit(3).alias("thoughts"), F.lit(50).alias("cache_creation"))
    return usage.totals(u).select("event_id", "input_total", "output_total", "total", "effective_input")


@query("""WITH e AS (SELECT user_id, event_type, (props->>'$.k')::BIGINT AS k FROM events)
SELECT user_id, m AS modality, sum(n)::BIGINT AS tokens FROM (SELECT user_id, event_type AS m, k AS n FROM e UNION ALL SELECT user_id, 'all', 1 FROM e) GROUP BY 1, 2""")
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = props(table(spark, sf_dir, "events")).withColumn("usage", F.create_map(F.col("event_type"), F.col("k"), F.lit("all"), F.lit(1).cast("long")))
    return usage.merge(e, "user_id", "usage")


@query(f"WITH {JOBS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'Generated') AS generated, count(*) FILTER (status = 'Generating') AS in_flight, count(*) FILTER (status = 'Pending') AS queued, count(*) FILTER (status = 'Failed') AS failed FROM jobs")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"generated": "Generated", "in_flight": "Generating", "queued": "Pending", "failed": "Failed"}
    return jobs(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(n) for n, s in names.items()])


@query("SELECT count(*) AS discovered, count(DISTINCT sha256(text)) AS stored, count(*) - count(DISTINCT sha256(text)) AS skipped FROM documents")
def scrape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    put = store.put_blobs(spark.createDataFrame([], "silo string, cid string"), docs, "main")
    return put.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(~F.col("existed")).alias("stored"), F.count_if("existed").alias("skipped"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(event_id, user_id) WHEN event_id % 4 = 1 THEN event_id WHEN event_id % 4 = 2 THEN user_id END AS target FROM events")
def discovery_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("event_id") % 4 < 2, F.col("event_id"))
    total = F.when(F.col("event_id") % 4 % 2 == 0, F.col("user_id"))
    total = F.when(F.col("event_id") % 4 == 3, F.lit(None)).otherwise(total)
    return table(spark, sf_dir, "events").select("event_id", portal.discovery_target(limit, total).alias("target"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KiB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.2f MiB', b / 1048576.0::DOUBLE)
 WHEN b < 1099511627776 THEN printf('%.2f GiB', b / 1073741824.0::DOUBLE) ELSE printf('%.2f TiB', b / 1099511627776.0::DOUBLE) END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS b FROM orders)""")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.human_size(F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("size"))


@query("SELECT c_custkey, 'structured-' || left(regexp_replace(c_name || ' / ' || c_mktsegment || ' long display name for jobs', '[^A-Za-z0-9_-]', '-', 'g'), 40) AS name FROM customer")
def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", sc.display_name(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit(" long display name for jobs"))).alias("name"))


@query("SELECT event_id, CASE WHEN user_id < 100 AND event_type <> 'error' THEN event_type WHEN value > 10 THEN props END AS picked FROM events")
def fallback_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when((F.col("user_id") < 100) & (F.col("event_type") != "error"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(first, F.when(F.col("value") > 10, F.col("props"))).alias("picked"))
