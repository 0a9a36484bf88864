"""Payload pairs as a data sink: for each document its bytes and its JSON, side by side, all of a job or none.

Tasks write ``<doc>.bin`` and ``<doc>.json`` into a folder of the job that readers do not see (its name begins with ``_``).  When all tasks
have succeeded the commit renames the folder; when one has failed the abort removes it.  So no half pair and no part of a
job is ever visible.  Files go through pyarrow's file systems, so the path may be of any store that these know.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sedge.errors import InvalidParameter


@dataclass
class Written(WriterCommitMessage):
    pairs: int


class PairSink(DataSource):
    """``df.write.format("pairs").mode("append").save(path)`` for rows (doc_id, content, details)."""

    @classmethod
    def name(cls) -> str:
        return "pairs"

    def schema(self) -> str:
        return "doc_id string, content binary, details string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise InvalidParameter("mode", "pairs are appended")
        return _PairWriter(self.options["path"])


class _PairWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(f"{self.path}/{name}" if "://" in self.path else f"file://{self.path}/{name}")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = self._at(f"_job-{self.job}")
        store.create_dir(folder, recursive=True)
        many = 0
        for row in iterator:
            if not row.doc_id or "/" in row.doc_id:
                raise InvalidParameter("doc_id", f"cannot name a file: {row.doc_id!r}")
            for end, data in (("bin", bytes(row.content or b"")), ("json", (row.details or "{}").encode())):
                with store.open_output_stream(f"{folder}/{row.doc_id}.{end}") as out:
                    out.write(data)
            many += 1
        return Written(many)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._at(f"_job-{self.job}")
        if sum(m.pairs for m in messages if m is not None):
            store.move(folder, self._at(f"job-{self.job}")[1])

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._at(f"_job-{self.job}")
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, details) of all finished jobs below ``path``."""
    kept = spark.read.format("binaryFile").option("pathGlobFilter", "*.{bin,json}").load(f"{path}/job-*")
    name = F.substring_index("path", "/", -1)
    parts = kept.select(F.regexp_replace(name, r"\.(bin|json)$", "").alias("doc_id"), F.element_at(F.split("path", "/"), -2).alias("job"), F.substring_index(name, ".", -1).alias("kind"), "content")
    # Two rows a pair.
    both = parts.groupBy("job", "doc_id").agg(F.max(F.when(F.col("kind") == "bin", F.col("content"))).alias("content"), F.max(F.when(F.col("kind") == "json", F.col("content"))).cast("string").alias("details"))
    return both.select("doc_id", "content", "details")
