"""Streams: content-addressed ingest with replay detection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge import storage
from sedge.functions.ids import content_id


def ingest(spark: SparkSession, source: str, content: str, target: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Reads ``source`` (Parquet) as a stream until nothing is left and stores each distinct content once.

    The store is a Parquet table of (cid, size_bytes, batch).  A batch's new ids are found by an anti join
    against the store, so replays of a file or a batch add nothing.
    """
    root = target or f"{storage.shared_dir(spark)}/sedge-stream-{uuid.uuid4().hex}"
    store, marks = f"{root}/store", f"{root}/checkpoint"
    schema = spark.read.parquet(source).schema
    folder = source if not source.endswith(".parquet") or _is_folder(spark, source) else source.rsplit("/", 1)[0]
    name = "*.parquet" if folder == source else source.rsplit("/", 1)[1]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    offered = stream.select(content_id(F.col(content)).alias("cid"), F.octet_length(content).cast("long").alias("size_bytes"))

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["cid"]).withColumn("batch", F.lit(number))
        if storage.exists(batch.sparkSession, store):
            new = new.join(batch.sparkSession.read.parquet(store).where(F.col("batch") != number).select("cid"), "cid", "left_anti")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    query = offered.writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    if not storage.exists(spark, store):
        return spark.createDataFrame([], "cid string, size_bytes long, batch int")
    return spark.read.parquet(store)


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = storage.file_system(spark, path)
    return fs.getFileStatus(at).isDirectory()


def dedup_stream(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First occurrences of a key in an unbounded stream; the watermark bounds what is remembered."""
    return stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key]).drop("_at")
