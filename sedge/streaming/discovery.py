"""Discovery of documents on a portal as a stream: pages with admission control, a worker stage, content stored once.

Pages come in micro-batches of ``maxPagesPerTrigger``; a batch is finished - every document fetched and stored or rejected - before the
next pages are asked for, which is the back-pressure.  Its documents are dealt over ``workers`` tasks.  The stream ends with
the first empty page or the target; its checkpoint lets a restart go on behind the last finished batch.

Tables below the target: ``store`` (cid, size_bytes, content) in folders of batch and id prefix, ``events`` (a row per document: ordinal,
doc_id, docket, decision_type, cid, existed) and ``rejects`` (doc_id, stage, message) by batch.  A batch that is repeated after a
failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge import storage
from sedge.functions.ids import content_id
from sedge.sources import portal

#: Length of the id prefix that names a folder of the store.
PREFIX = 2


def tasks(pages: DataFrame) -> DataFrame:
    """ordinal, page, href, doc_id, docket, decision_type of the wanted items of pages, and ``error`` for pages that cannot be read."""
    parsed = pages.withColumn("_page", portal.result_page(F.col("html"))).select("page", "seen", "target", F.col("_page.error").alias("error"), F.posexplode_outer("_page.items").alias("at", "item"))
    numbered = parsed.withColumn("ordinal", F.col("seen") + F.col("at") + 1)
    wanted = F.col("error").isNotNull() | (F.col("item").isNotNull() & (F.col("target").isNull() | (F.col("ordinal") <= F.col("target"))))
    return numbered.where(wanted).select("ordinal", "page", "error", "item.*")


def _worked(work: Callable[[str, str], bytes]):
    """Adds ``content`` and ``message``, what went wrong in ``work(doc_id, href)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents, messages = [], []
            for doc_id, href in zip(b["doc_id"], b["href"], strict=True):
                try:
                    contents.append(work(doc_id, href))
                    messages.append(None)
                except Exception as problem:  # noqa: BLE001 - whatever a fetch raises is told in the rejects
                    contents.append(None)
                    messages.append(f"{type(problem).__name__}: {problem}")
            yield b.assign(content=contents, message=messages)

    return run


def _append(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)


def discover(spark: SparkSession, source: str, work: Callable[[str, str], bytes], target: str, workers: int = 8, max_pages: int = 4, limit: int | None = None) -> dict[str, int]:
    """Run discovery from the registered portal source ``source`` to its end; counts of this and earlier runs over ``target``:
    discovered, stored, skipped (content that was there), rejected."""
    options = {"maxPagesPerTrigger": str(max_pages)} | ({"limit": str(limit)} if limit is not None else {})
    pages = spark.readStream.format(source).options(**options).load()
    store, events, rejects = (f"{target}/{t}" for t in ("store", "events", "rejects"))

    def batch(rows: DataFrame, number: int) -> None:
        found = storage.stage(tasks(rows), "discovered")
        fetched = found.where("error is null").drop("error").repartition(workers)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fetched.schema)
        done = storage.stage(fetched.mapInPandas(_worked(work), f"{kinds}, content binary, message string"), "fetched").withColumn("batch", F.lit(number))
        good = done.where("message is null and content is not null").withColumn("cid", content_id(F.col("content"))).withColumn("prefix", F.substring("cid", 1, PREFIX))
        first = good.groupBy("cid", "prefix", "batch").agg(F.min("ordinal").alias("ordinal"))
        if _has_rows(rows.sparkSession, store):
            prefixes = [r.prefix for r in first.select("prefix").distinct().collect()]  # 256 at most
            held = rows.sparkSession.read.parquet(store).where((F.col("batch") != number) & F.col("prefix").isin(prefixes)).select("cid").distinct()
            first = first.join(held, "cid", "left_anti")
        new = good.join(first.select("ordinal"), "ordinal").select("cid", F.octet_length("content").cast("long").alias("size_bytes"), "content", "batch", "prefix")
        marked = good.join(first.select("ordinal", F.lit(True).alias("new")), "ordinal", "left")
        _append(marked.select("ordinal", "doc_id", "docket", "decision_type", "cid", F.col("new").isNull().alias("existed"), "batch"), events)
        bad = done.where("message is not null or content is null").select("ordinal", "doc_id", F.lit("fetch").alias("stage"), F.coalesce("message", F.lit("no content")).alias("message"), "batch")
        unread = found.where("error is not null").select("ordinal", "doc_id", F.lit("page").alias("stage"), F.col("error").alias("message"), F.lit(number).alias("batch"))
        _append(bad.unionByName(unread), rejects)
        _append(new, store, "prefix")

    query = pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{target}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return summary(spark, target)


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether any batch has written a partition."""
    fs, at = storage.file_system(spark, path)
    return fs.exists(at) and any(f.getPath().getName().startswith("batch=") for f in fs.listStatus(at))


def summary(spark: SparkSession, target: str) -> dict[str, int]:
    count = lambda t, c: spark.read.parquet(f"{target}/{t}").where(c).count() if _has_rows(spark, f"{target}/{t}") else 0
    stored, skipped, rejected = count("events", "not existed"), count("events", "existed"), count("rejects", "true")
    return {"discovered": stored + skipped + rejected, "stored": stored, "skipped": skipped, "rejected": rejected}
