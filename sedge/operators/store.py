"""Keyed tables of records and blobs: upsert, delete, put, statistics, snapshots, retention."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructType

from sedge import storage
from sedge.errors import NotFound
from sedge.functions.ids import DELETABLE_CID, content_id

DELETE_LIMIT = 50_000
#: Folders of a backup: the manifests by name, and the data that they share.
MANIFESTS, UNITS = "manifests", "units"
_DELETABLE = re.compile(DELETABLE_CID[:-1] + r"\Z")


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", order: str | None = None, replace_by: str | None = None) -> DataFrame:
    """``existing`` with whole rows replaced by those of ``new`` with the same key.

    Where ``new`` repeats a key, the row of largest ``order`` wins, without ``order`` the later row of the batch.
    ``replace_by`` (say ``doc_id``) also drops old rows of the same document that ``new`` does not repeat; without it they stay.
    """
    new = last_of(new, key, order)
    gone = replace_by or key
    return existing.join(new.select(gone).distinct(), gone, "left_anti").unionByName(new, allowMissingColumns=True)


def last_of(new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: that of largest ``order``, which goes, or the last one in the batch."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order or "_place")))
    numbered = new if order else new.withColumn("_place", F.monotonically_increasing_id())
    return numbered.withColumn("_last", rank).where("_last = 1").drop("_last", order or "_place")


def put_blobs(store: DataFrame, files: DataFrame, silo: str) -> DataFrame:
    """One row per offered file: silo, cid, size_bytes, existed - true for content that the store or an
    earlier row of the batch holds."""
    offered = files.select(F.lit(silo).alias("silo"), content_id(F.col("content")).alias("cid"), F.octet_length(F.col("content").cast("binary")).cast("long").alias("size_bytes"), "path")
    n = F.row_number().over(Window.partitionBy("silo", "cid").orderBy("path"))
    known = store.select("silo", "cid", F.lit(True).alias("known")).distinct()
    joined = offered.withColumn("n", n).join(known, ["silo", "cid"], "left")
    return joined.select("path", "silo", "cid", "size_bytes", (F.col("known").isNotNull() | (F.col("n") > 1)).alias("existed"))


def head(store: DataFrame, silo: str, cid: str) -> DataFrame:
    return store.where((F.col("silo") == silo) & (F.col("cid") == cid)).select("cid", "size_bytes")


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The record with a key, or NotFound."""
    found = df.where(F.col(key) == F.lit(value))
    if found.limit(1).isEmpty():
        raise NotFound(f"{key} {value}")
    return found


def delete_plan(records: DataFrame, doc: str, limit: int | None = DELETE_LIMIT) -> DataFrame:
    """One row per document: records, chunks, cids - what deleting it takes away.

    ``limit`` caps the records of a document, as a guard; None lifts it.
    """
    if limit is not None:
        records = records.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy("id"))).where(F.col("_n") <= limit).drop("_n")
    found = records.groupBy(doc).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("doc_type") == "chunk").alias("chunks"), F.flatten(F.collect_set("blob_cids")).alias("_cids"))
    return found.select(doc, "records", "chunks", _distinct_cids(F.col("_cids"), F.col(doc).cast("string")).alias("cids"))


def _distinct_cids(found: Column, fallback: Column) -> Column:
    valid = lambda a: F.filter(a, lambda x: x.rlike(DELETABLE_CID))
    return F.array_sort(F.array_distinct(F.when(F.size(valid(found)) > 0, valid(found)).otherwise(valid(F.array(fallback)))))


def delete(records: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """``records`` without those whose key is in ``values`` (one column of the same name)."""
    return records.join(values.select(key).distinct(), key, "left_anti")


def _strings(value) -> Iterator[str]:
    """All strings of a JSON value."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list | dict):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _strings(x)


def _named(value: dict) -> Iterator[str]:
    """Strings under keys that name a cid or blob, and strings in arrays, at any depth of objects."""
    for key, x in value.items():
        if isinstance(x, str):
            low = key.lower()
            if ("cid" in low or "blob" in low) and "doc_id" not in low:
                yield x
        elif isinstance(x, dict):
            yield from _named(x)
        elif isinstance(x, list):
            for item in x:
                if isinstance(item, str):
                    yield item
                elif isinstance(item, dict):
                    yield from _named(item)


def cids_of(record: str | None) -> list[str]:
    try:
        record = json.loads(record) if record else {}
    except ValueError:
        return []
    if not isinstance(record, dict):
        return []
    part = lambda of, key: of.get(key) if isinstance(of.get(key), dict) else {}
    ingest = part(record, "ingest")
    found = [*_strings(record.get("blob_cids")), *_strings(ingest.get("blob_cids")), *_strings(part(ingest, "blobs")), *_named(part(record, "structured"))]
    valid = [x for x in found if _DELETABLE.match(x)]
    own = record.get("doc_id")
    return list(dict.fromkeys(valid or ([own] if isinstance(own, str) and _DELETABLE.match(own) else [])))


@pandas_udf(ArrayType(StringType()))
def collect_cids(record: pd.Series) -> pd.Series:
    """Content ids mentioned in a JSON record: ``blob_cids``, ``ingest.blob_cids``, ``ingest.blobs``, and in
    ``structured``, at any depth, strings under keys that name a cid or blob and strings in arrays; where there is
    none, ``doc_id``.  Invalid ones are ignored, first occurrences in order.  (The depth is open, which
    built-in functions cannot follow.)"""
    return record.map(cids_of)


def breakdown(records: DataFrame) -> DataFrame:
    kind = F.when(F.col("doc_type").isin("doc", "chunk"), F.col("doc_type")).otherwise("other")
    return records.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("records"))


def index_stats(records: DataFrame, doc: str, vector: str) -> DataFrame:
    has = F.col(vector).isNotNull()
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_if(has).alias("vectors"), F.count_distinct(F.when(has, F.col(doc))).alias("docs_with_vectors"))


def describe_embedder(name: str, kind: str, dims: int | None = None, quantized: bool = False) -> str:
    shape = f", dims: {dims}" if dims is not None else ""
    return f"{name} (kind: {kind}{shape}, {'quantized' if quantized else 'float32'})"


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(name, ts, files, bytes) of the backups below ``root``, newest first, from their manifests; no data are read."""
    fs, at = storage.file_system(spark, f"{root}/{MANIFESTS}")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    rows = []
    for name in names:
        units = manifest(spark, root, name)["units"]
        rows.append((name, sum(u["files"] for u in units), sum(u["bytes"] for u in units)))
    found = spark.createDataFrame(rows, "name string, files long, bytes long")
    ts = F.to_timestamp(F.regexp_extract("name", "([0-9T]{15})$", 1), "yyyyMMdd'T'HHmmss")
    return found.withColumn("ts", ts).select("name", "ts", "files", "bytes").orderBy(F.desc("ts"), F.desc("name"))


def manifest(spark: SparkSession, root: str, name: str) -> dict:
    """What a backup holds: per table its columns and how it is dealt, and the units (data directories) with their digests."""
    if not storage.exists(spark, f"{root}/{MANIFESTS}/{name}"):
        raise NotFound(f"{name} in {root}")
    return json.loads(storage.read_text(spark, f"{root}/{MANIFESTS}/{name}"))


def _digest(df: DataFrame) -> dict:
    """Rows of a unit and an order-free digest of them."""
    row = F.xxhash64(*sorted(df.columns)) if df.columns else F.lit(0)
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return {"rows": found.n, "digest": str(found.h or 0)}


def _size(spark: SparkSession, path: str) -> dict:
    fs, at = storage.file_system(spark, path)
    found = [f.getLen() for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet")]
    return {"files": len(found), "bytes": sum(found)}


def back_up(spark: SparkSession, tables: dict[str, str], root: str, name: str) -> int:
    """Add a backup of ``tables`` (name to path) below ``root``; returns how many units were written.

    Data directories of a table never change, so one that an earlier backup holds is not copied again: a backup of an unchanged
    table is a manifest alone.  Spark copies what is new, and every copy is held against its source.
    """
    made: dict = {"tables": {}, "units": []}
    known = {u["at"]: u for old in _names(spark, root) for u in manifest(spark, root, old)["units"]}
    written = 0
    for table, path in tables.items():
        found = storage.state(spark, path)
        if found is None:
            raise NotFound(path)
        made["tables"][table] = {"schema": found.schema.jsonValue(), "key": found.key, "buckets": found.buckets, "parts": found.parts}
        for at in sorted(found.parts.values()):
            where = f"{table}/{at}"
            if where not in known:
                source, copy = f"{path}/{at}", f"{root}/{UNITS}/{where}"
                spark.read.schema(found.schema).parquet(source).write.mode("overwrite").parquet(copy)
                unit = {"at": where, **_digest(spark.read.schema(found.schema).parquet(source)), **_size(spark, copy)}
                if unit | _digest(spark.read.schema(found.schema).parquet(copy)) != unit:
                    raise OSError(f"{copy} differs from its source")
                known[where] = unit
                written += 1
            made["units"].append(known[where])
    if not storage.write_once(spark, f"{root}/{MANIFESTS}/{name}", json.dumps(made) + "\n"):
        raise FileExistsError(name)
    return written


def _names(spark: SparkSession, root: str) -> list[str]:
    fs, at = storage.file_system(spark, f"{root}/{MANIFESTS}")
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def backed_up(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    """A table as a backup holds it."""
    kept = manifest(spark, root, name)["tables"][table]
    schema = StructType.fromJson(kept["schema"])
    paths = [f"{root}/{UNITS}/{table}/{at}" for at in sorted(kept["parts"].values())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def check_backup(spark: SparkSession, root: str, name: str) -> DataFrame:
    """at, rows, bytes, problem: each unit of a backup held against its manifest; problem is null, ``missing`` or ``changed``."""
    kept = manifest(spark, root, name)
    out = []
    for unit in kept["units"]:
        path, problem = f"{root}/{UNITS}/{unit['at']}", None
        if not storage.exists(spark, f"{path}/_SUCCESS"):
            problem = "missing"
        else:
            schema = StructType.fromJson(kept["tables"][unit["at"].split("/")[0]]["schema"])
            problem = "changed" if unit | _digest(spark.read.schema(schema).parquet(path)) != unit else None
        out.append((unit["at"], unit["rows"], unit["bytes"], problem))
    return spark.createDataFrame(out, "at string, rows long, bytes long, problem string")


def forget(spark: SparkSession, root: str, names: list[str]) -> int:
    """Remove backups and the units that no other backup holds; returns the number of units removed."""
    gone = {u["at"] for n in names for u in manifest(spark, root, n)["units"]}
    for n in names:
        fs, at = storage.file_system(spark, f"{root}/{MANIFESTS}/{n}")
        fs.delete(at, False)
    gone -= {u["at"] for n in _names(spark, root) for u in manifest(spark, root, n)["units"]}
    for unit in gone:
        fs, at = storage.file_system(spark, f"{root}/{UNITS}/{unit}")
        fs.delete(at, True)
    return len(gone)


def verify_snapshot(now: DataFrame, copy: DataFrame) -> DataFrame:
    """(rows, copied, missing, extra): whether a copy holds the rows of its source, compared by row digests."""
    digest = lambda df: df.select(F.xxhash64(*sorted(df.columns)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    a, b = digest(now), digest(copy)
    both = a.join(b.select("h", F.col("n").alias("m")), "h", "full_outer").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    zero = F.lit(0)
    return both.agg(F.coalesce(F.sum("n"), zero).alias("rows"), F.coalesce(F.sum("m"), zero).alias("copied"), F.coalesce(F.sum(F.greatest(F.col("n") - F.col("m"), zero)), zero).alias("missing"), F.coalesce(F.sum(F.greatest(F.col("m") - F.col("n"), zero)), zero).alias("extra"))


def restore_plan(now: DataFrame, then: DataFrame) -> DataFrame:
    """(action, records): what restoring ``then``, backed-up records, over ``now`` would add, replace, remove and keep."""
    old = then.select("id", F.xxhash64(*now.columns).alias("then"))
    both = now.select("id", F.xxhash64(*now.columns).alias("now")).join(old, "id", "full_outer")
    action = F.when(F.col("now").isNull(), "add").when(F.col("then").isNull(), "remove").when(F.col("now") != F.col("then"), "replace").otherwise("keep")
    return both.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("records"))


def index_sizes(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(index, files, bytes) of the directories below ``root``; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = F.substring_index(F.col("path"), "/", -1)
    parent = F.element_at(F.split("path", "/"), -2)
    name = F.when(parent.endswith(".parquet"), parent).otherwise(base)
    return files.groupBy(F.regexp_replace(name, r"\.parquet$", "").alias("index")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def retention(snapshots: DataFrame, ts: str, key: str, daily: int = 7, weekly: int = 4, monthly: int = 6) -> DataFrame:
    """The snapshots to keep: the last of each of the latest days, weeks and months.

    Buckets are numbered over days first, so only a row per day reaches the ranking of buckets.
    """
    kept = None
    for unit, n in (("DAY", daily), ("WEEK", weekly), ("MONTH", monthly)):
        latest = snapshots.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.max_by(key, F.struct(ts, key)).alias(key), F.max(ts).alias(ts))
        part = latest.orderBy(F.desc("bucket")).limit(n).select(key, ts)
        kept = part if kept is None else kept.unionByName(part)
    return kept.distinct()
