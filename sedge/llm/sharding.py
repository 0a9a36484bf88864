"""Byte-balanced shards by Karmarkar-Karp differencing, in a tree of bounded groups.

Law ``bytes``.  Equal texts form indivisible groups; only a group larger than a whole shard's share is
split by document (at most ``shards`` groups can be that large).  Differencing repeatedly takes the two
partial partitions of largest spread and adds them oppositely ordered.  A partial partition is just a
vector of shard sums, so the method composes: buckets of about ``GROUP`` groups are solved in parallel
tasks, each result is again one partial partition, and those are solved in the same way until one is
left.  Rows of a group with many copies are salted before they are joined with their group's shard, so
that a hot group (empty texts, say, which have next to no bytes) makes many tasks.  Slots number a shard's documents without gaps through counts per (shard, hash range) and their
running sums, so no task sees a whole shard.

Defined results: a null text has no bytes and size 1, and groups with the empty text; repeated rows
are separate documents; a null id is a document like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common

SHARDS = 16
GROUP = 4096
#: Rows of a group from which on its rows are salted, if the table has a million times fewer.
HOT_ROWS = 100_000
#: Documents in a hash range of a shard, and ranges at most.
RANGE_ROWS, MOST_RANGES = 400, 4096


def difference(vectors: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions (rows): for each row the final shard of each of its slots."""
    n, k = vectors.shape
    sums = np.zeros((2 * n - 1, k), vectors.dtype)
    sums[:n] = vectors
    sides: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(vectors.max(axis=1) - vectors.min(axis=1))]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        up, down = np.argsort(sums[a], kind="stable"), np.argsort(-sums[b], kind="stable")
        c = n + len(sides)
        sums[c] = sums[a][up] + sums[b][down]
        sides.append((a, up, b, down))
        heapq.heappush(heap, (-int(sums[c].max() - sums[c].min()), c))
    final = np.zeros((2 * n - 1, k), np.int64)
    final[2 * n - 2] = np.arange(k)
    for c in range(2 * n - 2, n - 1, -1):
        a, up, b, down = sides[c - n]
        final[a][up] = final[c]
        final[b][down] = final[c]
    return final[:n]


def _solve_units(shards: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("digest", "ascending"), ("piece", "ascending")])
        vectors = np.zeros((t.num_rows, shards), np.int64)
        vectors[:, 0] = t.column("bytes").to_numpy()
        return t.select(["digest", "piece", "bucket", "bytes"]).append_column("label", pa.array(difference(vectors)[:, 0]))

    return run


def _solve_buckets(t: pa.Table) -> pa.Table:
    t = t.sort_by("node")
    vectors = np.array(t.column("sums").to_pylist(), np.int64)
    return pa.table({"node": t.column("node"), "above": t.column("above"), "labels": pa.array(difference(vectors).tolist(), pa.list_(pa.int64()))})


def _tree(sums: DataFrame, shards: int, nodes: int) -> DataFrame:
    """(bucket, shard of each label) from the buckets' sums, level by level."""
    placed = None
    while True:
        above = -(-nodes // GROUP)
        solved = common.stage(sums.withColumn("above", F.pmod(F.xxhash64("node"), F.lit(above))).groupBy("above").applyInArrow(_solve_buckets, "node long, above long, labels array<long>"), "shard-tree")
        if placed is None:
            placed = solved.select(F.col("node").alias("bucket"), "above", "labels")
        else:
            step = solved.select(F.col("node").alias("below"), "above", F.col("labels").alias("outer"))
            placed = placed.withColumnRenamed("above", "below").join(step, "below").select("bucket", "above", F.transform("labels", lambda x: F.element_at("outer", (x + 1).cast("int"))).alias("labels"))
        if above == 1:
            return placed.select("bucket", "labels")
        flat = sums.join(solved, "node").select("above", F.explode(F.arrays_zip("labels", "sums")).alias("x")).groupBy("above", F.col("x.labels").alias("label")).agg(F.sum("x.sums").alias("s"))
        sums = common.stage(_vectors(flat.withColumnRenamed("above", "node"), shards), "shard-sums")
        nodes = above


def _vectors(flat: DataFrame, shards: int) -> DataFrame:
    """(node, sums) from (node, label, s): ``shards`` numbers a node."""
    got = flat.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("m"))
    return got.select("node", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("sums"))


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = common.text_or_empty(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(F.col(id_col).cast("long"), F.monotonically_increasing_id()).alias("own"))
    rows = common.stage(rows, "shard-rows")
    groups = common.stage(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("many")), "shard-groups")
    whole = groups.agg(F.sum("bytes"), F.sum("many"), F.count(F.lit(1))).first()
    bytes_all, count_all = whole[0] or 0, whole[1] or 0
    if not count_all:
        return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = max(1, bytes_all // shards)
    # Fewer than ``shards`` groups exceed a shard's share and a million at most have ``hot`` rows: bounded tables.
    hot = max(HOT_ROWS, int(count_all) // 1_000_000)
    pieces = F.when(F.col("bytes") > share, F.ceil(2 * F.col("bytes") / share)).otherwise(1)
    large = groups.where((F.col("bytes") > share) | (F.col("many") >= hot)).select("digest", pieces.cast("long").alias("pieces"), F.ceil(F.col("many") / hot).cast("long").alias("salts"))
    dealt = lambda n, *by: F.when(F.col(n).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("own", *by), n)).cast("long")
    rows = rows.join(F.broadcast(large), "digest", "left").select("doc_id", "size", "crc", "digest", "own", dealt("pieces").alias("piece"), dealt("salts", F.lit("salt")).alias("salt"))
    units = rows.groupBy("digest", "piece").agg(F.sum("size").alias("bytes"))
    buckets = max(1, -(-int(whole[2]) // GROUP))
    units = units.withColumn("bucket", F.pmod(F.xxhash64("digest", "piece"), F.lit(buckets)))
    solved = common.stage(units.groupBy("bucket").applyInArrow(_solve_units(shards), "digest binary, piece long, bucket long, bytes long, label long"), "shard-units")
    sums = _vectors(solved.groupBy(F.col("bucket").alias("node"), "label").agg(F.sum("bytes").alias("s")), shards)
    tree = _tree(common.stage(sums, "shard-sums"), shards, buckets)
    final = solved.join(tree, "bucket").select("digest", "piece", F.element_at("labels", (F.col("label") + 1).cast("int")).cast("int").alias("shard"))
    ranges = min(MOST_RANGES, max(1, -(-int(count_all) // (shards * RANGE_ROWS))))
    final = final.join(F.broadcast(large.select("digest", "salts")), "digest", "left")
    final = final.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
    placed = rows.join(final, ["digest", "piece", "salt"]).select("doc_id", "size", "crc", "shard", F.pmod(F.xxhash64("own", "crc"), F.lit(ranges)).alias("part"))
    placed = common.stage(placed, "shard-placed")
    # At most shards * MOST_RANGES rows.
    begin = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("begin", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    slot = F.col("begin") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "crc", "size")) - 1
    return placed.join(F.broadcast(begin), ["shard", "part"]).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
