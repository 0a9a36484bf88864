"""Vector search over stored cells: vectors beside their nearest of some centroids, of which a query reads the nearest.

Centroids come from Lloyd steps over a sample of unit vectors (``SAMPLE`` rows; all rows are stored), each an assignment in
Arrow and an aggregation.  The vectors are written partitioned by cell, with their norms, so that a query prunes whole
directories.  A unit vector of cell c is within the cell's radius of its centroid, which tells cells that cannot hold one
of the best k: with ``exact`` the search reads all others, without it the ``probes`` nearest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge import storage
from sedge.operators.search import DIGITS

#: Rows of a cell aimed at, cells at most, rows that centroids are fitted on, Lloyd steps, rows of a file.
ROWS = 4096
MOST = 4096
SAMPLE = 1 << 16
STEPS = 6
FILE = 1 << 18
#: The cell of vectors without direction, which every search reads.
FLAT = -1
_ROOM = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (units @ centres.T), axis=1)


def _sums(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, d, s, n): per batch and cell, sums of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, dim = centres.shape
        total, count = np.zeros((many, dim)), np.zeros(many, np.int64)
        for b in batches:
            units, norm = _units(_matrix(b.column("vector"), dim))
            cell = _nearest(units, centres)
            np.add.at(total, cell[norm > 0], units[norm > 0])
            count += np.bincount(cell[norm > 0], minlength=many)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(np.repeat(used, dim)), pa.array(np.tile(np.arange(dim), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], dim))], names=["cell", "d", "s", "n"])

    return run


def fit(rows: DataFrame, dim: int, many: int, steps: int = STEPS) -> np.ndarray:
    """``many`` centroids of the unit vectors of ``rows`` (key, vector), a sample of which fits in memory."""
    begin = rows.orderBy(F.xxhash64("key"), "key").limit(many).select("vector").toArrow()  # MOST rows
    centres = _units(_matrix(begin.column("vector").combine_chunks(), dim))[0]
    for _ in range(steps):
        sums = rows.mapInArrow(_sums(centres), "cell long, d long, s double, n long").groupBy("cell", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
        cell, d = (sums.column(c).to_numpy() for c in ("cell", "d"))
        moved = centres.copy()
        moved[cell, d] = sums.column("s").to_numpy() / sums.column("n").to_numpy()
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _place(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                units, norm = _units(_matrix(b.column("vector"), centres.shape[1]))
                cell = _nearest(units, centres)
                away = np.sqrt(((units - centres[cell]) ** 2).sum(axis=1))
                yield pa.record_batch([b.column("key"), b.column("vector"), pa.array(norm), pa.array(away), pa.array(np.where(norm > 0, cell, FLAT))], names=["key", "vector", "norm", "away", "cell"])

    return run


def _scored(query: np.ndarray, k: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, score) of each batch, of its best ``k`` and what ties with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = float(np.sqrt(query @ query))
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vector"), len(query))
            norm = b.column("norm").to_numpy() * size if "norm" in b.schema.names else np.sqrt((x * x).sum(axis=1)) * size
            cosine = np.where(norm > 0, x @ query / np.where(norm > 0, norm, 1), 0.0)
            score = np.round((1 + cosine) / 2, DIGITS)
            keep = np.arange(len(score))
            if k is not None and len(score) > k:
                keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            yield pa.record_batch([b.column("key").take(pa.array(keep)), pa.array(score[keep])], names=["key", "score"])

    return run


def scan(df: DataFrame, query: Sequence[float], key: str, vector: str, k: int | None = None) -> DataFrame:
    """(key, score) with score (1 + cosine) / 2 of all rows of ``df`` that have a vector of the query's length; with ``k`` only of
    rows that can be among the best."""
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == len(query))).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_scored(np.array(query, np.float64), k), f"key {kind}, score double").withColumnRenamed("key", key)


class Cells:
    """The stored vectors of one version below ``at``: ``vectors`` by cell, and ``centres`` (cell, centre, radius, rows)."""

    def __init__(self, spark: SparkSession, at: str, key: str):
        self.spark, self.at, self.key = spark, at.rstrip("/"), key

    def ready(self) -> bool:
        return storage.exists(self.spark, f"{self.at}/centres/_SUCCESS")

    def build(self, df: DataFrame, vector: str, dim: int, rows: int = ROWS) -> Cells:
        """Write the cells of all rows with a vector of ``dim`` components."""
        held = storage.stage(df.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(self.key).alias("key"), F.col(vector).cast("array<double>").alias("vector")), "cells-rows")
        kind, count = held.schema["key"].dataType.simpleString(), held.count()
        sample = held.where(F.pmod(F.xxhash64("key"), F.lit(max(1, count // SAMPLE))) == 0)
        centres = fit(sample, dim, max(1, min(MOST, count // rows, sample.count()))) if count else np.zeros((1, dim))
        placed = storage.stage(held.mapInArrow(_place(centres), f"key {kind}, vector array<double>, norm double, away double, cell long"), "cells-placed")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"))  # MOST rows
        files = sizes.select("cell", F.ceil(F.col("rows") / FILE).alias("files"))
        dealt = placed.join(F.broadcast(files), "cell").repartition("cell", F.pmod(F.xxhash64("key"), "files")).select("key", F.col("vector").cast("array<float>").alias("vector") if self._single(df, vector) else "vector", "norm", "cell")
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{self.at}/vectors")
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(FLAT, [0.0] * dim)], "cell long, centre array<double>")
        known.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/centres")
        return self

    @staticmethod
    def _single(df: DataFrame, vector: str) -> bool:
        return df.schema[vector].dataType.elementType.simpleString() == "float"

    def read(self, cells: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/vectors").where(F.col("cell").isin([int(c) for c in cells]))

    def search(self, query: Sequence[float], k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """(key, score) of rows among which are the best ``k`` of the cells that are read."""
        known = self.spark.read.parquet(f"{self.at}/centres").toArrow()  # MOST rows
        if not known.num_rows:
            return self.spark.createDataFrame([], "key string, score double").withColumnRenamed("key", self.key)
        cell, rows = known.column("cell").to_numpy(), known.column("rows").to_numpy()
        q = np.array(query, np.float64)
        unit = _units(q[None])[0][0]
        away = np.sqrt(((_matrix(known.column("centre").combine_chunks(), len(q)) - unit) ** 2).sum(axis=1))
        away[cell == FLAT] = -1.0
        order = np.argsort(away, kind="stable")
        many = max(min(probes + int((cell == FLAT).any()), len(order)), int(np.searchsorted(np.cumsum(rows[order]), k)) + 1)
        near = order[:many]
        if exact and many < len(order):
            last = self._of(cell[near], q, k).orderBy(F.desc("score")).offset(k - 1).limit(1).first()
            # |q - x|^2 = 2 - 2 cos for unit vectors; a query without direction is equally far from all.
            reach = math.sqrt(max(0.0, 4 - 4 * (last.score - 10.0**-DIGITS))) if last is not None and q.any() else math.inf
            bound = away - known.column("radius").to_numpy()
            near = np.flatnonzero((bound <= reach + _ROOM) | (cell == FLAT))
        return self._of(cell[near], q, k)

    def _of(self, cells: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
        rows = self.read(cells.tolist()).select("key", F.col("vector").cast("array<double>").alias("vector"), "norm")
        kind = rows.schema["key"].dataType.simpleString()
        return rows.mapInArrow(_scored(q, k), f"key {kind}, score double").withColumnRenamed("key", self.key)
