"""Timers and keyed state on streams, against the batch rules."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from sedge.operators import jobs
from sedge.streaming import timers

PROVIDER = timers.PROVIDER
DDL = "job_id string, status string, created_at_ms long, updated_at_ms long, stale boolean, retry_count int, max_retries int, last_error string, next_retry_at_ms long"
HOUR = 3_600_000


@pytest.fixture
def state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(spark, source, make, folder, ddl, mode):
    """Play the Parquet files that are there through a stream; all rows that it gave out."""
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    out = f"{folder}/out-{uuid.uuid4().hex}"
    make(stream).writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_reaper_by_timers(spark, state, tmp_path):
    """As the watermark passes a job's age it is requeued or fails, as ``reap`` has it for the same table and time."""
    source, now = str(tmp_path / "in"), 1_000 * HOUR
    table = [
        ("young", "Pending", 0, now - 47 * HOUR, False, 0, 3, None, None), ("old", "Pending", 0, now - 49 * HOUR, False, 0, 3, None, None),
        ("spent", "Generating", 0, now - 13 * HOUR, False, 3, 3, None, None), ("busy", "Generating", 0, now - 11 * HOUR, False, 0, 3, None, None),
        ("done", "Generated", 0, now - 90 * HOUR, False, 0, 3, None, None), ("later", "Pending", 0, now - 60 * HOUR, False, 1, 3, None, now + 2 * HOUR),
        ("again", "Generating", 0, now - 20 * HOUR, False, 1, 3, None, now - 3 * HOUR),
    ]
    df = spark.createDataFrame(table, DDL)
    want = {(r.job_id, r.outcome, r.status, r.retry_count) for r in jobs.reap(df, now).collect()}
    assert {w[0] for w in want} == {"old", "spent", "again"}
    df.coalesce(1).write.parquet(source)
    clock = spark.createDataFrame([("clock", "Generated", 0, now, False, 0, 0, None, None)], DDL)
    for _ in range(2):  # its time is the watermark of the batch behind it
        clock.coalesce(1).write.mode("append").parquet(source)
    rows = run(spark, source, timers.reap_stream, tmp_path, DDL, "update")
    assert {r[:4] for r in rows} == want
    delay = {r[0]: r[4] - r[5] for r in rows if r[1] == "requeued"}
    assert delay == {"old": 300_000, "again": 600_000}
    # The same query goes on from its checkpoint: later the others follow, and what was requeued goes stale again.
    clock.withColumn("updated_at_ms", F.lit(now + 60 * HOUR)).coalesce(1).write.mode("append").parquet(source)
    clock.withColumn("updated_at_ms", F.lit(now + 60 * HOUR + 1)).coalesce(1).write.mode("append").parquet(source)
    later = {(r[0], r[1], r[3]) for r in run(spark, source, timers.reap_stream, tmp_path, DDL, "update")}
    assert {("young", "requeued", 1), ("busy", "requeued", 1), ("later", "requeued", 2), ("old", "requeued", 2)} <= later
    assert not {j for j, _, _ in later} & {"done", "spent", "clock"}


def admissions(rows, per_window, window, burst):
    """A cell rate limiter over finished rows (key, time, id)."""
    due, step, out = {}, window / per_window, {}
    for key, at, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        begin = max(due.get(key, at), at)
        out[i] = begin + step - at <= step * burst
        due[key] = begin + step if out[i] else begin
    return out


ROWS = [(i % 3, 40 * i + (i % 5), i) for i in range(60)] + [(7, 0, 100), (7, 0, 101), (7, 0, 102), (7, 0, 103)]


def offered(spark, source):
    for part in (ROWS[:25], ROWS[25:50], ROWS[50:]):
        spark.createDataFrame(part, "k int, at long, id int").coalesce(1).write.mode("append").parquet(source)


def test_limits_over_batches(spark, tmp_path):
    """A key's allowance is carried from batch to batch: the same admissions as over the finished table."""
    source = str(tmp_path / "in")
    offered(spark, source)
    want = admissions(ROWS, 5, 1000, 3)
    out = timers.limited(spark, source, lambda df: df, "k", "at", "id", 5, 1000, 3, files_per_trigger=1)
    assert {r.id: r.admitted for r in out.collect()} == want and len(set(want.values())) == 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER  # as it was


def test_limits_with_state_that_expires(spark, state, tmp_path):
    """With a time to live the query runs on; what it gave out within it is the same."""
    source, out = str(tmp_path / "in"), f"{tmp_path}/out"
    offered(spark, source)
    stream = spark.readStream.schema("k int, at long, id int").option("maxFilesPerTrigger", 1).parquet(source)
    limited = timers.limit_stream(stream, "k", "at", "id", 5, 1000, 3, ttl_ms=3_600_000)
    query = limited.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if query.exception() is not None or (tmp_path / "out" / "_SUCCESS").exists() and spark.read.schema("id int").parquet(out).count() == len(ROWS):
                break
    finally:
        query.stop()
    assert {r.id: r.admitted for r in spark.read.parquet(out).collect()} == admissions(ROWS, 5, 1000, 3)
