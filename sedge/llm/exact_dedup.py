"""Exact duplicate removal by a distributed content sort.

1. Splitters.  A hashed sample of rows (half of ``SAMPLED`` expected) gives keys (head of the normalised text, 64-bit hash of
   all of it, hash of the row's number) with their texts' bytes; splitters cut the keys into ranges of equal bytes, about
   ``RANGE_BYTES`` each.  Only sampled texts are normalised for that.
2. Sort.  Every row finds its range by binary search among the splitters (JVM expressions); each range is
   one partition, sorted externally on (head, hash, normalised text, doc_id), which places equal texts
   next to each other.
3. Runs.  A streaming pass compares every row with its neighbour - full bytes, not only hashes - and
   closes runs of equals; it holds one batch and the ids of the open run.

The row's number is part of the range key, so a group of any size, whatever its ids, is dealt over many partitions; only the first
and last run of a partition can go on elsewhere, and those (two per partition at most) are united by
their full text afterwards.

Defined results: a null text counts as empty; empty texts equal each other; of equal texts the row
with the most code points in the original text, then the smallest id, stays; a null id sorts last;
of repeated rows exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common
from sedge.llm.textkit import buffers

#: Characters of the normalised text by which it is ranged, rows drawn for the splitters (half of it expected), bytes of a range.
HEAD = 16
SAMPLED = 1 << 18
RANGE_BYTES = 64 << 20

_ROWS = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("keep_chars", pa.int64()), ("group_size", pa.int64()), ("best", pa.bool_()), ("text_sha256", pa.string()), ("edge", pa.int64()), ("edge_text", pa.string())])
_DDL = "doc_id long, keep_id long, keep_chars long, group_size long, best boolean, text_sha256 string, edge long, edge_text string"


def _new_runs(norm: pa.Array, code: np.ndarray, last: tuple[int, bytes] | None) -> np.ndarray:
    """True where a row's normalised bytes differ from those of the row before it."""
    off, raw = buffers(norm)
    size = np.diff(off)
    new = np.ones(len(code), bool)
    same = np.flatnonzero((code[1:] == code[:-1]) & (size[1:] == size[:-1])) + 1
    for i in same:  # equal hash and length: now the bytes themselves
        new[i] = not np.array_equal(raw[off[i] : off[i + 1]], raw[off[i - 1] : off[i]])
    if last is not None and code[0] == last[0]:
        new[0] = raw[off[0] : off[1]].tobytes() != last[1]
    return new


class _Runs:
    """Turns a sorted stream of rows into finished runs of equal texts, as record batches."""

    def __init__(self, pid: int):
        self.pid, self.first, self.open = pid, True, []
        self.text = b""

    def begin(self, text: bytes) -> None:
        self.text, self.open = text, []

    def close(self, last: bool) -> list:
        """Columns of the open run: ids, what stays, its length, size, best, digest, edge, edge text."""
        doc, void, n = (np.concatenate(x) for x in zip(*self.open, strict=True))
        best = int(np.lexsort((doc, void, -n))[0])
        is_best = np.zeros(len(doc), bool)
        is_best[best] = True
        edge = 2 * self.pid if self.first else 2 * self.pid + 1 if last else -1
        self.first = False
        many = len(doc)
        text = [self.text.decode() if i == best and edge >= 0 else None for i in range(many)] if edge >= 0 else pa.nulls(many, pa.string())
        return [
            pa.array(doc, pa.int64(), mask=void), pa.repeat(pa.scalar(None if void[best] else int(doc[best]), pa.int64()), many), pa.repeat(pa.scalar(int(n[best])), many), pa.repeat(pa.scalar(many), many),
            pa.array(is_best), pa.repeat(pa.scalar(hashlib.sha256(self.text).hexdigest()), many), pa.repeat(pa.scalar(edge if edge >= 0 else None, pa.int64()), many), pa.array(text, pa.string()),
        ]


def _inner_runs(doc: np.ndarray, void: np.ndarray, n: np.ndarray, start: np.ndarray, off: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    """Runs that begin and end inside a batch, ``start`` holding their bounds."""
    lo, hi = start[0], start[-1]
    run = np.repeat(np.arange(len(start) - 1), np.diff(start))
    own, blank, chars = doc[lo:hi], void[lo:hi], n[lo:hi]
    order = np.lexsort((own, blank, -chars, run))
    best = order[start[:-1] - lo]
    is_best = np.zeros(len(own), bool)
    is_best[best] = True
    sha = pa.array([hashlib.sha256(raw[off[i] : off[i + 1]]).hexdigest() for i in start[:-1]])
    ids = lambda at: pa.array(own[at], pa.int64(), mask=blank[at])
    return pa.RecordBatch.from_arrays([ids(slice(None)), ids(best[run]), pa.array(chars[best][run]), pa.array(np.diff(start)[run]), pa.array(is_best), sha.take(pa.array(run)), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.string())], schema=_ROWS)


def _close_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, last = _Runs(TaskContext.get().partitionId()), None
    for b in batches:
        if not b.num_rows:
            continue
        norm, code = b.column("norm"), b.column("code").to_numpy(zero_copy_only=False)
        off, raw = buffers(norm)
        new = np.flatnonzero(_new_runs(norm, code, last))
        void = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        n = b.column("chars").to_numpy(zero_copy_only=False)
        if not len(new):
            runs.open.append((doc, void, n))
            continue
        if last is not None:
            runs.open.append((doc[: new[0]], void[: new[0]], n[: new[0]]))
            yield pa.RecordBatch.from_arrays(runs.close(False), schema=_ROWS)
        elif len(new) > 1:  # the partition's first run ends here
            runs.begin(raw[off[0] : off[1]].tobytes())
            runs.open.append((doc[: new[1]], void[: new[1]], n[: new[1]]))
            yield pa.RecordBatch.from_arrays(runs.close(False), schema=_ROWS)
            new = new[1:]
        if len(new) > 1:
            yield _inner_runs(doc, void, n, new, off, raw)
        at = new[-1]
        runs.begin(raw[off[at] : off[at + 1]].tobytes())
        runs.open.append((doc[at:], void[at:], n[at:]))
        last = (code[-1], runs.text)
    if last is not None:
        t = pa.Table.from_batches([pa.RecordBatch.from_arrays(runs.close(True), schema=_ROWS)])
        yield from t.to_batches(max_chunksize=65536)


def _normalised(text_col: str) -> Column:
    return F.regexp_replace(common.text_or_empty(text_col), common.BLANK, "")


def _splitters(df: DataFrame, id_col: str, text_col: str) -> list[tuple[str, int, int]]:
    """Keys (hex of the head, hash, id) that cut the table into ranges of about equal bytes."""
    many = df.count()
    if not many:
        return []
    every = -(-2 * many // SAMPLED)
    # Rows are drawn by the hash of their number before anything is normalised; half of SAMPLED are expected.
    drawn = df.select(F.col(text_col).alias("text"), _spread().alias("spread")).where(F.pmod("spread", F.lit(every)) == 0)
    norm = _normalised("text")
    got = drawn.select(F.hex(F.substring(norm, 1, HEAD).cast("binary")).alias("head"), F.xxhash64(norm).alias("code"), F.xxhash64("spread").alias("row"), (F.octet_length(norm) + 64).alias("bytes")).orderBy("head", "code", "row").toArrow()
    size = np.cumsum(got.column("bytes").to_numpy().astype(np.int64)) if got.num_rows else np.zeros(1, np.int64)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size[-1] * every // RANGE_BYTES) + 1)
    at = np.unique(np.searchsorted(size, size[-1] * np.arange(1, ranges) / ranges))
    rows = got.take(pa.array(at[at < got.num_rows])).to_pylist()
    return sorted({(r["head"], r["code"], r["row"]) for r in rows})


def _spread() -> Column:
    """A hash of the row's number in its scan."""
    return F.xxhash64(F.monotonically_increasing_id())


def _range_of(splitters: list[tuple[str, int, int]]) -> Column:
    """Number of splitters that are not above the row's key, by binary search."""
    if not splitters:
        return F.lit(0)
    heads, codes, rows = zip(*splitters, strict=True)
    table = [F.split(F.lit(",".join(heads)), ","), *(F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (codes, rows))]
    key = F.struct(F.hex(F.col("head").cast("binary")).alias("a"), F.col("code").alias("b"), F.col("row").alias("c"))
    bits = len(splitters).bit_length()

    def step(found: Column, bit: Column) -> Column:
        tried = found + bit
        here = F.struct(*(F.get(t, tried - 1).alias(n) for t, n in zip(table, "abc", strict=True)))
        return F.when((tried <= len(splitters)) & (here <= key), tried).otherwise(found)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)]), F.lit(0), step)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    splitters = _splitters(df, id_col, text_col)
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(common.text_or_empty(text_col)).cast("long").alias("chars"), _normalised(text_col).alias("norm"), F.xxhash64(_spread()).alias("row"))
    keyed = keyed.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("code", F.xxhash64("norm")).withColumn("range", _range_of(splitters))
    dealt = keyed.repartitionById(len(splitters) + 1, "range")
    runs = dealt.sortWithinPartitions("head", "code", "norm", F.asc_nulls_last("doc_id")).select("doc_id", "chars", "norm", "code").mapInArrow(_close_runs, _DDL)
    rows = common.stage(runs, "exact-runs")
    # Two runs a partition at most have an edge: this table is bounded by the partition count.
    edges = (
        rows.where("edge_text is not null").groupBy("edge_text")
        .agg(F.collect_list("edge").alias("edges"), F.sum("group_size").alias("all_size"), F.min(F.struct((-F.col("keep_chars")).alias("c"), F.col("keep_id").isNull().alias("n"), F.col("keep_id").alias("k"), F.col("edge").alias("e"))).alias("w"))
        .select(F.explode("edges").alias("edge"), "all_size", F.col("w.k").alias("all_keep"), F.col("w.e").alias("winner"))
    )
    joined = rows.drop("edge_text").join(F.broadcast(edges), "edge", "left")
    inner = F.col("edge").isNull()
    return joined.select(
        "doc_id",
        F.when(inner, F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.when(inner, F.col("group_size")).otherwise(F.col("all_size")).alias("group_size"),
        (F.col("best") & (inner | (F.col("winner") == F.col("edge")))).alias("kept"),
        "text_sha256",
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows are matched by id; where ids repeat, by id and digest of the normalised text, and of a row that is
    repeated outright one stays.
    """
    found = exact_dedup(df, id_col, text_col)
    key, sha, chars, rank = common.fresh(df, "keep_key", "keep_sha", "keep_chars", "keep_rank")
    if found.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        return common.without(df, id_col, found.where(~F.col("kept")).select(F.col("doc_id").alias(key)), key)
    own = F.sha2(_normalised(text_col), 256)
    stay = found.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    kept = df.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (own == F.col(sha)), "left_semi")
    first = Window.partitionBy(id_col, sha).orderBy(F.desc(chars))
    return kept.withColumns({sha: own, chars: F.char_length(common.text_or_empty(text_col))}).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(sha, chars, rank)
