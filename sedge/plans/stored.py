"""Stored search indexes of the driver tables, built once per state of their files and kept until the session ends."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sedge import storage
from sedge.operators.cells import Cells
from sedge.operators.fielded import Index
from sedge.plans.registry import table


def _at(spark: SparkSession, df: DataFrame, name: str) -> str:
    """A folder for an index of ``df``, named by its files, their sizes and times."""
    seen = []
    for file in sorted(df.inputFiles()):
        fs, at = storage.file_system(spark, file)
        found = fs.getFileStatus(at)
        seen.append(f"{file} {found.getLen()} {found.getModificationTime()}")
    made = f"{storage.shared_dir(spark)}/sedge-{name}-{hashlib.sha256(chr(10).join(seen).encode()).hexdigest()}"
    fs, at = storage.file_system(spark, made)
    fs.deleteOnExit(at)
    return made


def words(spark: SparkSession, sf_dir: str, names: Sequence[str] = Index.RANKED) -> Index:
    """The index of the documents' texts with the tables that a query reads; those that are there already stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = Index(spark, _at(spark, docs, "words"), "doc_id")
    return index.build(docs, ["text"], {}, [n for n in names if not index.ready([n])])


def vectors(spark: SparkSession, sf_dir: str) -> Cells:
    rows = table(spark, sf_dir, "embeddings")
    cells = Cells(spark, _at(spark, rows, "vectors"), "vec_id")
    return cells if cells.ready() else cells.build(rows, "embedding", 64, rows=512)
