"""Merkle manifest of a dataset: a digest tree over each group of rows, one root over the groups, a proof per row.

1. Leaves.  Every row's fields become one digest (JVM expressions); rows keep 32 bytes each from here on.
2. Order.  Leaves are range-partitioned by (group, id, digest, row key) and numbered inside their group from the
   partitions' counts, so a group or an id of any size spreads over many partitions.
3. Roots.  Blocks of ``ARITY ** HEIGHT`` aligned leaves are hashed to one node each, these nodes form blocks
   again, until one node of each group is left; the groups' nodes go through the same steps to the root.
4. Proofs, from the top down.  The path above a block is shared by its leaves and travels once per block.
   In the block, Merkle traversal hands out the authentication paths leaf by leaf: every level keeps the run of
   nodes in force and a treehash that prepares the next one; updates go to the treehash with the lowest waiting
   node first, which keeps the stacks logarithmic.  The shared upper path is appended to each.

A task holds one block (``ARITY ** height`` digests at most) and the stacks.

Defined results: a null field is ``-`` in the leaf, a null group is a group (the first), null ids come first in
their group, rows of one id are ordered by their leaf digest, so repeated rows are interchangeable; an empty table has
no rows; texts of any length are hashed whole; columns that are not asked for are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common

ARITY = 8
#: Levels of a block, which has ``ARITY ** HEIGHT`` leaves.
HEIGHT = 4
#: Bytes of a range of leaves.
RANGE_BYTES = 64 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64
_NODES = "part string, pos long, n long, node binary"
#: What the leaves of a block share: the siblings above it, and where its group stands.
_SHARED = "path binary, subroot binary, root binary, group_pos long, groups long"
_CARRIED = ("subroot", "root", "group_pos", "groups")
_PROOFS = "doc_id long, part string, position long, leaf string, subroot string, root string, path string, folded_root string"


def digest(parts: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def steps(n: int) -> int:
    """Levels between ``n`` nodes and the one that remains."""
    many = 0
    while n > 1:
        n, many = -(-n // ARITY), many + 1
    return many


class Treehash:
    """The run of nodes of one height above a range of leaves, made leaf by leaf.

    Fewer than ``ARITY`` finished nodes of each lower height wait; the last leaf of the block closes runs early.
    """

    def __init__(self, leaves: Sequence[bytes], height: int, begin: int):
        self.leaves, self.height, self.at = leaves, height, begin
        self.end = min(begin + ARITY ** (height + 1), len(leaves))
        self.waiting: list[list[bytes]] = [[] for _ in range(height)]
        self.nodes: list[bytes] = []

    def done(self) -> bool:
        return self.at >= self.end

    def tail(self) -> int:
        """Height of the lowest waiting node; the target's where none waits."""
        return next((j for j, own in enumerate(self.waiting) if own), self.height)

    def update(self) -> None:
        node = self.leaves[self.at]
        self.at += 1
        for own in self.waiting:
            own.append(node)
            if len(own) < ARITY and self.at < len(self.leaves):
                return
            node = digest(own)
            own.clear()
        self.nodes.append(node)

    def finish(self) -> list[bytes]:
        while not self.done():
            self.update()
        return self.nodes


def traverse(leaves: Sequence[bytes], height: int) -> Iterator[bytes]:
    """The siblings of each leaf in turn, level by level, left to right, up to ``height`` levels."""
    runs = [Treehash(leaves, h, 0).finish() for h in range(height)]
    coming = [Treehash(leaves, h, ARITY ** (h + 1)) for h in range(height)]
    for i in range(len(leaves)):
        yield b"".join(b"".join(run[:at] + run[at + 1 :]) for h, run in enumerate(runs) for at in (i // ARITY**h % ARITY,))
        for h in range(height):
            begin = i + 1
            if begin % ARITY ** (h + 1):
                break  # higher runs go on as well
            runs[h], coming[h] = coming[h].finish(), Treehash(leaves, h, begin + ARITY ** (h + 1))
        for _ in range(height):
            open_ = [t for t in coming if not t.done()]
            if not open_:
                break
            min(open_, key=Treehash.tail).update()


def places(pos: int, n: int) -> Iterator[tuple[int, int]]:
    """(index in its run, nodes of the run) of the node above leaf ``pos`` of ``n``, level by level."""
    while n > 1:
        yield pos % ARITY, min(ARITY, n - pos + pos % ARITY)
        pos, n = pos // ARITY, -(-n // ARITY)


def fold(node: bytes, path: bytes, *where: tuple[int, int]) -> bytes:
    """The root that a leaf and its siblings give, through one tree after the other: ``where`` has the leaf's
    position in the first tree and its size, then the same of the tree above."""
    at = 0
    for pos, n in where:
        for index, size in places(pos, n):
            cut, end = at + _HEX * index, at + _HEX * (size - 1)
            node = digest((path[at:cut], node, path[cut:end]))
            at = end
    return node


def block_height(n: int, most: int) -> int:
    """Levels of a block of a group of ``n`` nodes: ``most`` where the group has several blocks."""
    return steps(n) if n <= ARITY**most else most


def block_root(leaves: Sequence[bytes], height: int) -> bytes:
    """The node ``height`` levels above all of ``leaves``."""
    return leaves[0] if not height else digest(Treehash(leaves, height - 1, 0).finish())


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of equal keys from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] |= bool(held) and held[-1].column(k)[-1] != c[0]
        at = 0
        for start in [*np.flatnonzero(new).tolist(), b.num_rows]:
            if start > at:
                held.append(b.slice(at, start - at))
            if start < b.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            at = start
    if held:
        yield pa.Table.from_batches(held)


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _block_roots(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, "part", "block"):
        n = t.column("n")[0].as_py()
        node = block_root(_hex(t.column("node")), block_height(n, height))
        yield pa.RecordBatch.from_arrays([pa.array([t.column("part")[0].as_py()]), pa.array([t.column("block")[0].as_py()]), pa.array([-(-n // ARITY**height)]), pa.array([bytes.fromhex(node.decode())])], names=["part", "pos", "n", "node"])


def _with_shared(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[tuple[pa.Table, dict, Iterator[bytes]]]:
    """(rows of a block, what they share, their paths inside the block)."""
    for t in _groups(batches, "part", "block"):
        shared, rows = t.slice(0, 1).to_pylist()[0], t.slice(1)
        yield rows, shared, traverse(_hex(rows.column("node")), block_height(rows.column("n")[0].as_py(), height))


def _paths(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for rows, shared, inner in _with_shared(batches, height):
        many = rows.num_rows
        path = pa.array([p + shared["path"] for p in inner], pa.binary())
        one = [rows.column(c).combine_chunks() for c in ("part", "pos")]
        yield pa.RecordBatch.from_arrays([*one, path, *(pa.array([shared[c]] * many, pa.binary() if c in ("subroot", "root") else pa.int64()) for c in _CARRIED)], names=["part", "pos", "path", *_CARRIED])


def _proofs(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for rows, shared, inner in _with_shared(batches, height):
        above, pos, n = (shared["group_pos"], shared["groups"]), rows.column("pos").to_pylist(), rows.column("n")[0].as_py()
        leaves = _hex(rows.column("node"))
        claimed = [x if c is None else c.hex().encode() for x, c in zip(leaves, rows.column("claimed").to_pylist(), strict=True)]
        path = [p + shared["path"] for p in inner]
        folded = [fold(c, p, (i, n), above) for c, p, i in zip(claimed, path, pos, strict=True)]
        text = lambda parts: pa.array(parts, pa.binary()).cast(pa.string())
        fixed = [pa.repeat(pa.scalar(shared[c].hex()), len(pos)) for c in ("subroot", "root")]
        out = [rows.column("doc_id").combine_chunks(), rows.column("part").combine_chunks(), pa.array(pos), text(leaves), *fixed, text(path), text(folded)]
        t = pa.Table.from_arrays(out, names=["doc_id", "part", "position", "leaf", "subroot", "root", "path", "folded_root"])
        yield from t.to_batches(max_chunksize=1024)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hex digest of fields, each as its length in bytes, ``:`` and value, ``-`` where it is null."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(field(c.cast("string")) for c in columns)), 256)


def _numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos``, the place of a row in its part, and ``n``, the rows of the part; ``leaves`` is staged."""
    by = ["part", *order]
    dealt = leaves.repartitionByRange(*common.ranges(leaves, RANGE_BYTES), *by).sortWithinPartitions(*by)
    rows = common.stage(dealt.withColumn("seq", F.monotonically_increasing_id()), "merkle-order")
    task = F.shiftright("seq", 33)
    counts = rows.groupBy("part", task.alias("task")).agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"))
    before = Window.partitionBy("part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part and partition: for one part, as many as there are partitions.
    begin = counts.select("part", "task", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"), F.sum("rows").over(Window.partitionBy("part")).alias("n"))
    return rows.withColumn("task", task).join(begin, ["part", "task"]).withColumn("pos", F.col("seq") - F.col("first") + F.col("begin")).drop("seq", "task", "first", "begin")


def _dealt(rows: DataFrame) -> DataFrame:
    """Whole blocks to partitions, in order; the row that a block shares has ``pos`` -1."""
    return rows.repartition("part", "block").sortWithinPartitions("part", "block", "pos")


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", 3 * height))


def _climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` (part, pos, n, node) and, staged, the levels of block roots above, the last with one node a part."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while len(levels) == 1 or most > 1:
        roots = _dealt(_blocked(levels[-1].select("part", "pos", "n", "node"), height)).mapInArrow(partial(_block_roots, height=height), _NODES)
        levels.append(common.stage(roots, "merkle-roots"))
        most = -(-most // ARITY**height)
    return levels


def _joined(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Blocks of ``nodes``, each led by what it shares: the row of ``above`` for the block's root."""
    lead = above.select("part", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", *_CARRIED)
    return _dealt(_blocked(nodes, height).unionByName(lead, allowMissingColumns=True))


def _descend(levels: list[DataFrame], top: DataFrame, height: int) -> DataFrame:
    """(part, pos, path, ...) of the first level of block roots, from those of the last."""
    for nodes in reversed(levels[1:-1]):
        top = common.stage(_joined(nodes, top, height).mapInArrow(partial(_paths, height=height), f"part string, pos long, {_SHARED}"), "merkle-paths")
    return top


def proofs(df: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", id_col: str = "doc_id", claimed: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """A row for each row of ``df``: doc_id, the group, its ``position`` there, ``leaf``, ``subroot`` of the group, ``root``,
    ``path`` (the siblings' hex digests, lowest level first) and ``folded_root``, the root recomputed from the path.

    ``claimed`` replaces fields in what is folded (not in the tree), as a reader would who holds other values.
    """
    own = {f: F.col(f) for f in fields}
    leaf = leaf_digest(list(own.values()))
    other = F.unhex(leaf_digest(list((own | claimed).values()))) if claimed else F.lit(None).cast("binary")
    part = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then by bytes
    made = df.select(part.alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(leaf).alias("node"), other.alias("claimed"))
    leaves = _numbered(common.keyed(made, "row"), "doc_id", "node", "row").drop("row")
    levels = _climb(leaves, height)
    subroots = common.stage(levels[-1].select(F.lit("").alias("part"), F.col("part").alias("group"), "node"), "merkle-groups")
    groups = _numbered(subroots, "group")
    upper = _climb(groups, height)
    empty = F.lit(b"")
    top = upper[-1].select("part", "pos", empty.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root"), F.lit(0).cast("long").alias("group_pos"), F.lit(0).cast("long").alias("groups"))
    reached = _joined(groups.select("part", "pos", "n", "node"), _descend(upper, top, height), height).mapInArrow(partial(_paths, height=height), f"part string, pos long, {_SHARED}")
    # A row for each group.
    heads = groups.join(reached.select("pos", "path", "root"), "pos").select(F.col("group").alias("part"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root", F.col("pos").alias("group_pos"), F.col("n").alias("groups"))
    found = _joined(leaves, _descend(levels, common.stage(heads, "merkle-heads"), height), height).mapInArrow(partial(_proofs, height=height), _PROOFS)
    name = F.when(F.col("part") != "", F.substring("part", 2, 1 << 30)).alias(group)
    return found.select("doc_id", name, *(c for c in found.columns if c not in ("doc_id", "part")))


#: What the query's reader does to the text: A-Z in lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def manifest(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of ``documents``, a third of whose readers hold
    a text in lower case (those where 3 divides the id's crc32; none with a null id)."""
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    found = proofs(df, claimed={"text": altered})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("path", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "lang", "position")
