"""Tables on shared storage: staging, and versioned tables that are changed in one step, bucket by bucket.

A table is a directory of data (``v-<id>/`` or ``v-<id>/bucket=<n>/``, written once and never changed) and of numbered commits.
A commit lists the directories that make up the table.  It is made by creating the file of the next number,
which one writer only can do, whatever process or machine it runs on: the others get ``Conflict``.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedge.errors import Conflict

COMMITS = "_commits"
#: No expectation of a table's version.
ANY = "*"
#: Tasks that write a bucket together, so that none holds a whole one.
WRITERS = 4
#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scope: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and all runs on this machine, a new one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='sedge-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of ``path``: any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage; gone when the JVM ends, or by
    ``drop`` or the end of ``scratch`` before.  The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sedge-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _staged[out] = path
    if (scope := _scope.get()) is not None:
        scope.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more; other tables stay as they are."""
    for table in tables:
        if path := _staged.pop(table, None):
            fs, at = file_system(table.sparkSession, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are staged inside go at its end, but for those that the function it gives was called with."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    outer = _scope.get()
    token = _scope.set(made)
    try:
        yield keep
    finally:
        _scope.reset(token)
        drop(*(t for t in made if not any(t is k for k in kept)))
        if outer is not None:
            outer.extend(kept)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


class Version(NamedTuple):
    """A state of a table: its number, its columns, how its rows are dealt, and the directory of each bucket (of ``""`` where there are none)."""

    number: int
    schema: StructType
    key: str | None
    buckets: int
    parts: dict[str, str]

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "key": self.key, "buckets": self.buckets, "parts": self.parts}) + "\n"


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not be there; False where another writer was first."""
    fs, at = file_system(spark, path)
    try:
        out = fs.create(at, False)
    except Py4JJavaError as problem:
        if "FileAlreadyExists" in problem.java_exception.getClass().getName() or fs.exists(at):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def state(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The table's state, or that of an earlier commit; None for a plain Parquet directory or none at all."""
    fs, at = file_system(spark, f"{path}/{COMMITS}")
    if not fs.exists(at):
        return None
    names = sorted((f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().isdigit()), reverse=True)
    for name in names if number is None else [n for n in names if int(n) == number]:
        text = read_text(spark, f"{path}/{COMMITS}/{name}")
        if text.endswith("\n"):  # else its writer has not finished it
            got = json.loads(text)
            return Version(int(name), StructType.fromJson(got["schema"]), got["key"], got["buckets"], got["parts"])
    return None


def current(spark: SparkSession, path: str) -> str | None:
    """Number of the table's last commit, as text."""
    found = state(spark, path)
    return None if found is None else str(found.number)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str, buckets: Iterable[int] | None = None, number: int | None = None) -> DataFrame:
    """The table as it is now, or at commit ``number``; with ``buckets`` only these."""
    found = state(spark, path, number)
    if found is None:
        return spark.read.parquet(path)
    wanted = None if buckets is None else {str(b) for b in buckets}
    parts = [f"{path}/{at}" for b, at in sorted(found.parts.items()) if wanted is None or b in wanted]
    return spark.read.schema(found.schema).parquet(*parts) if parts else spark.createDataFrame([], found.schema)


def _write(df: DataFrame, path: str, key: str | None, buckets: int) -> dict[str, str]:
    """Write rows as new directories; the directory of each bucket that has rows."""
    version = f"v-{uuid.uuid4().hex}"
    if not buckets:
        df.write.parquet(f"{path}/{version}")
        return {"": version}
    spark = df.sparkSession
    dealt = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket", F.pmod(F.hash(key), F.lit(WRITERS)))
    dealt.write.partitionBy("bucket").parquet(f"{path}/{version}")
    fs, at = file_system(spark, f"{path}/{version}")
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return {n.split("=")[1]: f"{version}/{n}" for n in names if n.startswith("bucket=")}


def _commit(spark: SparkSession, path: str, before: Version | None, after: Version, made: Iterable[str]) -> str:
    if write_once(spark, f"{path}/{COMMITS}/{after.number:012d}", after.text()):
        _drop_unused(spark, path, before, after)
        return str(after.number)
    for at in {m.split("/")[0] for m in made}:
        _remove(spark, f"{path}/{at}")
    raise Conflict(path)


def _drop_unused(spark: SparkSession, path: str, before: Version | None, after: Version) -> None:
    """Remove what the commit before last used and neither of the last two does; those who read the one before go on."""
    old = state(spark, path, before.number - 1) if before is not None else None
    if old is None:
        return
    used = set(after.parts.values()) | set(before.parts.values())
    for at in set(old.parts.values()) - used:
        _remove(spark, f"{path}/{at}")


def replace_table(df: DataFrame, path: str, expected: str | None = ANY, key: str | None = None, buckets: int = 0) -> str:
    """Write ``df`` as the whole table; returns the commit's number.

    Readers see the old table or the new one, never none, and a failure leaves the old one in force.  ``expected`` is the commit
    that ``df`` was made from: where another writer has committed meanwhile, ``Conflict`` is raised and nothing
    changes.  With ``buckets`` rows are dealt by a hash of ``key``, so that ``change_buckets`` can rewrite some of them.
    """
    spark = df.sparkSession
    before = state(spark, path)
    if expected is not ANY and (None if before is None else str(before.number)) != expected:
        raise Conflict(path)
    parts = _write(df, path, key, buckets)
    while True:
        after = Version(0 if before is None else before.number + 1, df.schema, key, buckets, parts)
        try:
            return _commit(spark, path, before, after, parts.values() if expected is not ANY else ())
        except Conflict:
            if expected is not ANY:
                raise
            before = state(spark, path)


def change_buckets(spark: SparkSession, path: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame], expected: str | None = ANY) -> str:
    """Rewrite the buckets of the keys in ``touched`` (one column, the table's key): ``change`` gets their rows and returns what takes
    their place.  All other buckets stay the files that they are.  A table without buckets is rewritten."""
    before = state(spark, path)
    if before is None or not before.buckets:
        return replace_table(change(read_table(spark, path)), path, expected)
    if expected is not ANY and str(before.number) != expected:
        raise Conflict(path)
    found = [r[0] for r in touched.select(bucket_of(touched.columns[0], before.buckets)).distinct().collect()]  # bucket numbers
    if not found:
        return str(before.number)
    new = change(read_table(spark, path, found, before.number)).select(*before.schema.names)
    made = _write(new, path, before.key, before.buckets)
    gone = {str(b) for b in found}
    parts = {b: at for b, at in before.parts.items() if b not in gone} | made
    return _commit(spark, path, before, before._replace(number=before.number + 1, parts=parts), made.values())


def directories(spark: SparkSession, path: str) -> Sequence[str]:
    """The data directories that make up the table now."""
    found = state(spark, path)
    return [] if found is None else sorted(found.parts.values())


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)
