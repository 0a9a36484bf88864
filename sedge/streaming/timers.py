"""Keyed state on unbounded streams: the reaper of stale jobs by timers, and rate limits with state that expires.

Both are ``transformWithState`` processors: one small value per key in the state store, which Spark checkpoints; nothing is
collected per key.  In mode ``EventTime`` the clock is the watermark of the events, in ``ProcessingTime`` the machine's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sedge import storage
from sedge.operators.jobs import BASE_DELAY_MS, GENERATING_AGE_MS, MAX_DELAY_MS, PENDING_AGE_MS

#: The state store that these processors need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"
AGES = {"Pending": PENDING_AGE_MS, "Generating": GENERATING_AGE_MS}
REAPED = "job_id string, outcome string, status string, retry_count int, next_retry_at_ms long, updated_at_ms long"


def backoff(retries: int) -> int:
    """The delay of a retry without jitter: doubled each time, bounded."""
    return int(min(BASE_DELAY_MS * 2 ** min(retries, 20), MAX_DELAY_MS))


class Reaper(StatefulProcessor):
    """A job without an event for the age of its status is requeued, or fails when its retries are used up.

    The state is (status, updated_at_ms, retry_count, max_retries, next_retry_at_ms) of a job that can go stale; its one timer stands
    where it does.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, updated long, retries int, most int, next long")

    def _rest(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _wait(self, status: str, updated: int, retries: int, most: int, next_ms: int | None) -> None:
        self._rest()
        if status not in AGES:  # done: nothing can go stale
            self.job.clear()
            return
        self.job.update((status, updated, retries, most, -1 if next_ms is None else next_ms))
        self.handle.registerTimer(max(updated + AGES[status], next_ms or 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = None
        for b in rows:
            own = b.sort_values("updated_at_ms", kind="stable").iloc[-1]
            if last is None or own["updated_at_ms"] >= last["updated_at_ms"]:
                last = own
        if last is not None and not (self.job.exists() and self.job.get()[1] > last["updated_at_ms"]):
            wait = last["next_retry_at_ms"]
            self._wait(last["status"], int(last["updated_at_ms"]), int(last["retry_count"]), int(last["max_retries"]), None if pd.isna(wait) else int(wait))
        yield pd.DataFrame(columns=["job_id", "outcome", "status", "retry_count", "next_retry_at_ms", "updated_at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.job.exists():
            return
        _, _, retries, most, _ = self.job.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if retries < most:
            next_ms = now + backoff(retries)
            out = (key[0], "requeued", "Pending", retries + 1, next_ms, now)
            self._wait("Pending", now, retries + 1, most, next_ms)
        else:
            out = (key[0], "failed", "Failed", retries, None, now)
            self._wait("Failed", now, retries, most, None)
        yield pd.DataFrame([out], columns=["job_id", "outcome", "status", "retry_count", "next_retry_at_ms", "updated_at_ms"]).astype({"next_retry_at_ms": "Int64"})

    def close(self) -> None:
        pass


def reap_stream(events: DataFrame, mode: str = "EventTime", delay: str = "0 seconds") -> DataFrame:
    """What becomes of stale jobs, from a stream of job states (job_id, status, updated_at_ms, retry_count, max_retries,
    next_retry_at_ms); with event time the watermark follows ``updated_at_ms``."""
    rows = events.select("job_id", "status", "updated_at_ms", "retry_count", "max_retries", "next_retry_at_ms")
    if mode == "EventTime":
        rows = rows.withColumn("at", F.timestamp_millis("updated_at_ms")).withWatermark("at", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(Reaper(), REAPED, "Update", mode)


class Limiter(StatefulProcessor):
    """A generic cell rate limiter: the state is the time at which the key's next request is due."""

    def __init__(self, key: str, at_us: str, order: str, per_window: int, window_us: int, burst: int, ttl_ms: int | None):
        self.key, self.at_us, self.order, self.ttl_ms = key, at_us, order, ttl_ms
        self.step = window_us / per_window
        self.slack = self.step * burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "due double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self.due.get()[0] if self.due.exists() else None
        for b in rows:
            b = b.sort_values([self.at_us, self.order], kind="stable")
            admitted = []
            for t in b[self.at_us].astype(float):
                begin = t if due is None else max(due, t)
                ok = begin + self.step - t <= self.slack
                due = begin + self.step if ok else begin if due is None else due
                admitted.append(ok)
            yield b.assign(admitted=admitted)
        if due is not None:
            self.due.update((due,))

    def close(self) -> None:
        pass


def limit_stream(stream: DataFrame, key: str, at_us: str, order: str, per_window: int, window_us: int, burst: int, ttl_ms: int | None = None) -> DataFrame:
    """Adds ``admitted`` to the rows of a stream: ``per_window`` per window and key, ``burst`` at once.

    A key's state is one number, kept from batch to batch; it goes ``ttl_ms`` after the key's last request, which
    must be later than its due time.  Requests of a key count in the order of their times inside a batch.
    """
    mode = "None" if ttl_ms is None else "ProcessingTime"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy(key).transformWithStateInPandas(Limiter(key, at_us, order, per_window, window_us, burst, ttl_ms), f"{fields}, admitted boolean", "Append", mode)


def limited(spark: SparkSession, source: str, prepare: Callable[[DataFrame], DataFrame], key: str, at_us: str, order: str, per_window: int, window_us: int, burst: int, files_per_trigger: int = 64) -> DataFrame:
    """``limit_stream`` over a Parquet folder or file, read as a stream until nothing is left and ``prepare``d."""
    root = f"{storage.shared_dir(spark)}/sedge-limits-{uuid.uuid4().hex}"
    fs, at = storage.file_system(spark, source)
    folder, name = (source, "*.parquet") if fs.getFileStatus(at).isDirectory() else source.rsplit("/", 1)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    rows = limit_stream(prepare(stream), key, at_us, order, per_window, window_us, burst)
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, PROVIDER)
    try:
        rows.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_SETTING, before)
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")
