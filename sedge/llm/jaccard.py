"""Exact n-gram Jaccard self-join by T-occurrence search (DivideSkip), reported as components.

1. Count.  Shingle hashes of all texts are counted exactly, packed by hash range (4 bytes for each that a task
   saw once).  The ``LISTED`` most frequent ones become a frequency table; it only decides an *order* of
   shingles (unlisted ones first, then by rising count), and any fixed order gives right results, so its
   size bound costs speed at most.
2. Prefixes.  Two sets of similarity t share one of the first n - ceil(t n) + 1 shingles in any fixed
   order.  Equal sets fold into one class with their smallest doc_id.
3. Blocks.  Shingles in the prefixes of at least two classes form inverted lists, sorted by set size.
   The pairs of short lists are counted, and joined if they share as many prefix shingles as their sizes and
   places in the order ask for, which pairs that meet by chance don't; in a long list, dealt over tasks by size,
   neighbours by size are chained unless the sizes rule it out.  A linked pair shares a shingle of a long list or
   all it shares is counted, so it lies in one connected block, and long lists write no pairs out.
4. Search.  A block is cut into chunks of ``CHUNK`` classes (up to ``MOST_CHUNK`` in large blocks, so that a
   set is copied less often); each pair of chunks is one group, so a block of any size is dealt over many
   tasks.  In a group every class looks up its whole set (DivideSkip): the short inverted lists are merged
   on a heap, the L longest ones are probed by binary search for the candidates that reached T - L there,
   and the overlap decides exactly.  All links are counted, so a block of m near copies costs m^2 / 2
   comparisons.
5. Links become components; copies of a set share its component.

Defined results: a null or empty text (or one without words) has no shingle and is linked with nothing;
a text with fewer words than k has one shingle, its whole sequence; repeated rows and copies share a
component; with a null id the smallest known id of the component counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common
from sedge.llm.components import components
from sedge.llm.textkit import buffers, mix, shingle_hashes, slices, word_hashes, words

#: Entries of the frequency table at most (16 bytes each, sent to every executor).
LISTED = 1 << 22
LEAST_COUNT = 3
#: Bits of the hash ranges in which shingles are counted, at most; a shingle is known by these and 32 more.
MOST_BITS = 18
FLUSH = 1 << 20
CHUNK, MOST_CHUNK = 96, 1024
#: Counts from which on the cut of the frequency table goes by bins, sixteen to an octave.
BINNED = 1000
#: In inverted lists up to this length every pair is counted; in longer ones neighbours by size are chained.
SHORT_LIST = 64
#: Places in the order from here on are those of listed shingles, by count; before it those of the others, by hash.
LISTED_FROM = 1 << 62
#: Classes in blocks up to which their table is broadcast to find their texts; beyond it, a shuffle join.
BROADCAST_CLASSES = 1 << 20

_U = np.uint64


def _sets(batch_text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    off, raw = buffers(batch_text)
    for i, j in slices(off):
        w = words(off, raw, i, j)
        row, h = shingle_hashes(word_hashes(w), w.count, k)
        yield i, j, row, h


def _digests(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """64-bit digest of each row's set (0 for an empty one)."""
    n = np.bincount(row, minlength=rows)
    out = np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = (np.cumsum(n) - n)[full]
        out[full] = mix(np.add.reduceat(mix(h), at) + n[full].astype(_U)) ^ np.add.reduceat(mix(h ^ _U(0x5851F42D4C957F2D)), at)
    return out


def _count_cells(k: int, bits: int):
    shift, low = _U(64 - bits), _U(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) >> low, return_counts=True)
            held.clear()
            part = h >> _U(32)
            full, first = np.unique(part, return_index=True)
            cell = h.astype("<u4")
            pack = lambda x: pa.array([c.tobytes() for c in x], pa.binary())
            cells, counts = np.split(cell, first[1:]), np.split(n.astype("<u4"), first[1:])
            once, more = [c[m == 1] for c, m in zip(cells, counts, strict=True)], [m > 1 for m in counts]
            columns = [pack(once), pack([c[m] for c, m in zip(cells, more, strict=True)]), pack([c[m] for c, m in zip(counts, more, strict=True)])]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), *columns], names=["part", "once", "cells", "counts"])

        for b in batches:
            for _, _, _, h in _sets(b.column("text"), k):
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield out()
                    size = 0
        if size:
            yield out()

    return run


def _merge_cells(table: pa.Table) -> pa.Table:
    join = lambda c: np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column(c)])
    cell, back = np.unique(np.concatenate([join("once"), join("cells")]), return_inverse=True)
    once = len(back) - len(join("counts"))
    count = np.bincount(back, weights=np.concatenate([np.ones(once), join("counts")])).astype(np.int64)
    often = count >= LEAST_COUNT
    part = table.column("part")[0].as_py()
    return pa.table({"cell": pa.array((part << 32) | cell[often].astype(np.int64)), "n": pa.array(count[often])})


def frequency_table(texts: DataFrame, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits of a hash that name a shingle, those ascending, their counts) of the most frequent shingles,
    ``LISTED`` at most: all above some count, and a share by hash of those at it."""
    bits = common.hash_bits(texts, MOST_BITS)
    packed = texts.mapInArrow(_count_cells(k, bits), "part long, once binary, cells binary, counts binary")
    staged = common.stage(packed.groupBy("part").applyInArrow(_merge_cells, "cell long, n long"), "jaccard-counts")
    level = F.when(F.col("n") < BINNED, F.col("n")).otherwise(BINNED + F.floor(16 * F.log2(F.col("n") / BINNED))).cast("long")
    counted = staged.withColumn("level", level)
    # A few thousand levels at most: every count below BINNED, and the bins above it.
    by_level = sorted((r["level"], r["many"]) for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("many")).collect())
    above, room, share = 1 << 62, LISTED, 0.0
    for at, many in reversed(by_level):
        if many > room:
            share = 0.95 * room / many
            break
        above, room = at, room - many
    some = (F.col("level") == (max((x for x, _ in by_level if x < above), default=-1))) & (F.pmod(F.xxhash64("cell"), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = counted.where((F.col("level") >= above) | some).select("cell", "n").toArrow()
    common.drop(staged)
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(cell)
    return bits, cell[order].astype(_U), n[order]


class _Order:
    """Looks up the counts of listed shingles; a bit table answers for most that are not listed."""

    BITS = 24

    def __init__(self, bits: int, cells: np.ndarray, counts: np.ndarray):
        self.low, self.cells, self.counts = _U(32 - bits), cells, counts
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[self._spot(cells)] = True

    def _spot(self, cells: np.ndarray) -> np.ndarray:
        return (mix(cells) >> _U(64 - self.BITS)).astype(np.int64)

    def count(self, h: np.ndarray) -> np.ndarray:
        cell = h >> self.low
        out = np.zeros(len(h), np.int64)
        if len(self.cells):
            maybe = np.flatnonzero(self.known[self._spot(cell)])
            at = np.minimum(np.searchsorted(self.cells, cell[maybe]), len(self.cells) - 1)
            out[maybe] = np.where(self.cells[at] == cell[maybe], self.counts[at], 0)
        return out


def _ceil(n, num: int, den: int):
    return -((-n * num) // den)


def _prefixes(k: int, num: int, den: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*table.value)
        for b in batches:
            for i, j, row, h in _sets(b.column("text"), k):
                rows = j - i
                n = np.bincount(row, minlength=rows)
                p = np.where(n > 0, n - _ceil(n, num, den) + 1, 0)
                often = order.count(h)
                plain = often == 0
                before = np.cumsum(plain) - plain
                first = np.cumsum(n) - n
                rank = before - before[np.minimum(first, max(len(h) - 1, 0))][row] if len(h) else before
                take = plain & (rank < p[row])
                got = np.bincount(row[take], minlength=rows)
                short = got < p
                r, s = row[take], h[take]
                place_of = (s >> _U(2)).astype(np.int64)
                extra = np.flatnonzero(short[row] & ~plain)
                if len(extra):
                    extra = extra[np.lexsort((h[extra], often[extra], row[extra]))]
                    er = row[extra]
                    place = np.arange(len(er)) - np.searchsorted(er, er)
                    extra = extra[place < (p - got)[er]]
                    r, s, place_of = np.concatenate([r, row[extra]]), np.concatenate([s, h[extra]]), np.concatenate([place_of, LISTED_FROM + often[extra]])
                    again = np.argsort(r, kind="stable")
                    r, s, place_of = r[again], s[again], place_of[again]
                ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))]).astype(np.int32)
                last = np.zeros(rows, np.int64)
                last[n > 0] = place_of[ends[1:][n > 0] - 1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, rows) for c in ("doc_id", "code")), pa.array(n.astype(np.int64)), pa.array(_digests(row, h, rows).view(np.int64)), pa.array(last), lists], names=["doc_id", "code", "n", "set_id", "last", "prefix"])

    return run


def _whole_lists(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("s", "set_id", "n")) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of the named columns that never cut an inverted list (equal s) in two."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(b.column(c).to_numpy() for c in names)
        s = cols[0]
        cut = int(np.searchsorted(s == s[-1], True)) if s[0] != s[-1] else 0
        if held and held[-1][0][-1] != s[0] and not cut:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        if cut:
            held.append(tuple(c[:cut] for c in cols))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class Forest:
    """Union-find over 64-bit ids; the root of a tree is its smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def shared_needed(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Prefix shingles that sets of n and m shingles must share to link.

    Of the two prefixes let x's end first in the order: common shingles up to there are in both prefixes, and
    x has only n_x - p_x = ceil(t n_x) - 1 others.  So shared >= overlap needed - max(ceil(t n), ceil(t m)) + 1.
    """
    return np.maximum(1, _ceil(n + m, num, num + den) - _ceil(np.maximum(n, m), num, den) + 1)


def pair_needs(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, last_n: np.ndarray, last_m: np.ndarray, num: int, den: int) -> np.ndarray:
    """As ``shared_needed``, seen from a shared shingle that is the i-th of the one prefix and the j-th of the other;
    ``last`` are the places in the order where the prefixes end.

    A set has n - overlap needed shingles at most that the other lacks.  Up to where the first prefix ends, and up
    to a shared shingle, all common ones are in both prefixes: what these hold there beyond the shared ones is lacking.
    """
    overlap = _ceil(n + m, num, num + den)
    ends = lambda x: x - _ceil(x, num, den) + 1 - (x - overlap)
    first = np.where(last_n < last_m, ends(n), np.where(last_m < last_n, ends(m), np.minimum(ends(n), ends(m))))
    return np.maximum.reduce([shared_needed(n, m, num, den), first, i - (n - overlap), j - (m - overlap)])


def _pairs(num: int, den: int):
    """(a, b, need): the pairs of short lists, but for those that can't share as many prefix shingles as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, doc, n, i, last, c in _whole_lists(batches, ("s", "set_id", "n", "i", "last", "shared")):
            at = np.arange(len(s))
            for d in range(1, min(SHORT_LIST, len(s))):
                at = at[at + d < len(s)]
                at = at[s[at] == s[at + d]]
                if not len(at):
                    break
                x = at[n[at] * den >= n[at + d] * num]
                y = x + d
                need = pair_needs(n[x], n[y], i[x], i[y], last[x], last[y], num, den)
                fits = need <= np.minimum(c[x], c[y])
                x, y = x[fits], y[fits]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(doc[y]), pa.array(need[fits])], names=["a", "b", "need"])

    return run


_CHAINED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("s", pa.int64()), ("n", pa.int64())])


def _chain(num: int, den: int):
    """Neighbours by size in lists sorted by size, and the first and last row of the partition: a long list
    may go on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, ends, before = Forest(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, doc, n = (batch.column(c).to_numpy() for c in ("s", "set_id", "n"))
            if before is None:
                ends.append((int(doc[0]), None, False, int(s[0]), int(n[0])))
            else:
                s, doc, n = (np.append(x, y) for x, y in zip(before, (s, doc, n), strict=True))
            at = np.flatnonzero((s[:-1] == s[1:]) & (n[:-1] * den >= n[1:] * num))
            for a, b in zip(doc[at].tolist(), doc[at + 1].tolist(), strict=True):
                forest.join(a, b)
            before = s[-1:], doc[-1:], n[-1:]
        if before is None:
            return
        ends.append((int(before[1][0]), None, True, int(before[0][0]), int(before[2][0])))
        a, b = forest.edges()
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, pa.nulls(len(a), pa.bool_()), none, none], schema=_CHAINED)
        doc, void, last, s, n = zip(*ends, strict=True)
        part = pa.array([TaskContext.get().partitionId()] * len(ends), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(void, pa.int64()), part, pa.array(last), pa.array(s, pa.int64()), pa.array(n, pa.int64())], schema=_CHAINED)

    return run


def _chained(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of chained neighbours: a list of any length is dealt over partitions by (shingle, size, class), and
    where it goes on from one to the next their end rows, two a partition, are joined on the driver."""
    spark = lists.sparkSession
    order = ["s", "n", "set_id"]
    dealt = lists.repartitionByRange(*order).sortWithinPartitions(*order).select(*order)
    found = common.stage(dealt.mapInArrow(_chain(num, den), "a long, b long, part long, last boolean, s long, n long"), "jaccard-chains")
    ends = found.where("part is not null").select("part", "last", "a", "s", "n").orderBy("part", "last").collect()
    over = [(x.a, y.a) for x, y in zip(ends[1::2], ends[2::2], strict=False) if x.s == y.s and x.n * den >= y.n * num]
    return found.where("part is null").select("a", "b").unionByName(spark.createDataFrame(over, "a long, b long"))


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            first = np.array([not (x in seen or seen.add(x)) for x in b.column("set_id").to_pylist()], bool)  # of repeated rows one
            b = b.filter(pa.array(first))
            want = b.column("set_id").to_numpy()
            for i, j, row, h in _sets(b.column("text"), k):
                own = _digests(row, h, j - i).view(np.int64) == want[i:j]  # else a repeated id with another text
                edge = np.searchsorted(row, np.arange(j - i + 1))
                sets = [h[edge[x] : edge[x + 1]].tobytes() for x in range(j - i)]
                t = pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("set_id", "block", "chunks")), pa.array(sets, pa.binary())], names=["set_id", "block", "chunks", "shingles"])
                yield t.filter(pa.array(own))

    return run


def t_occurrence(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """All (i, j) with den * |intersection| >= num * |union|: i in ``left``, j in ``right``, or i < j within
    ``left`` where ``right`` is None.  The arrays hold distinct sorted shingles."""
    index = left if right is None else right
    size = np.array([len(x) for x in index])
    flat = np.concatenate(index)
    owner = np.repeat(np.arange(len(index)), size)
    order = np.argsort(flat, kind="stable")
    key, first = np.unique(flat[order], return_index=True)
    posting = owner[order]  # rising within each list
    last = np.append(first[1:], len(posting))
    found = []
    for i, q in enumerate(left):
        at = np.searchsorted(key, q)
        at = at[(at < len(key)) & (key[np.minimum(at, len(key) - 1)] == q)]
        need = int(_ceil(len(q), num, den))  # the union is no smaller than the query
        if len(at) < need:
            continue
        length = last[at] - first[at]
        by = np.argsort(length, kind="stable")
        at, length = at[by], length[by]
        aside = min(need - 1, int(need / (0.01 * np.log2(max(2, int(length[-1]))) + 1)), int((length > 4).sum()))
        cut = len(at) - aside
        near = heapq.merge(*[posting[a:b].tolist() for a, b in zip(first[at[:cut]], last[at[:cut]], strict=True)])
        merged = [(j, sum(1 for _ in g)) for j, g in groupby(near)]
        cand = np.array([j for j, n in merged if n >= need - aside and (right is not None or j > i)], np.int64)
        seen = np.array([n for j, n in merged if n >= need - aside and (right is not None or j > i)], np.int64)
        fits = (size[cand] * den >= len(q) * num) & (len(q) * den >= size[cand] * num)
        cand, total = cand[fits], seen[fits]
        for a in at[cut:]:  # binary probes of the long lists
            if not len(cand):
                break
            one = posting[first[a] : last[a]]
            p = np.minimum(np.searchsorted(one, cand), len(one) - 1)
            total = total + (one[p] == cand)
        good = den * total >= num * (len(q) + size[cand] - total)
        found += [(i, int(j)) for j in cand[good]]
    return found


def _search(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("set_id").to_numpy()
        _, one = np.unique(ids, return_index=True)  # repeated rows of one document
        table, ids = table.take(pa.array(one)), ids[one]
        chunk, lo, hi = table.column("chunk").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        a, b = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        links = []
        if lo == hi:
            links = [(a[i], a[j]) for i, j in t_occurrence([sets[x] for x in a], None, num, den)] if len(a) > 1 else []
        elif len(a) and len(b):
            links = [(a[i], b[j]) for i, j in t_occurrence([sets[x] for x in a], [sets[x] for x in b], num, den)]
        forest, many = Forest(), np.zeros(len(ids), np.int64)
        for i, j in links:
            forest.join(int(ids[i]), int(ids[j]))
            many[i] += 1
            many[j] += 1
        used = np.flatnonzero(many)
        return pa.table({"set_id": pa.array(ids[used]), "root": pa.array([forest.root(int(x)) for x in ids[used]], pa.int64()), "links": pa.array(many[used])})

    return run


def _shared_entries(classes: DataFrame) -> DataFrame:
    """(s, set_id, n, i, length): the prefix shingles that a class shares with any other, their place in its prefix
    (from 1), and how many have them."""
    entries = classes.select("set_id", "n", F.posexplode("prefix").alias("i", "s"))
    entries = entries.select("s", "set_id", (F.shiftleft("n", 32) + F.col("i") + 1).alias("n_i"))  # both in one, since all entries are shuffled
    # Lists are counted with partial sums and joined back, which adaptive execution splits where one is hot.
    lengths = entries.groupBy("s").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    return common.stage(entries.join(lengths, "s").select("s", "set_id", F.shiftright("n_i", 32).alias("n"), F.col("n_i").bitwiseAND(0xFFFFFFFF).alias("i"), "length"), "jaccard-lists")


def _members(shared: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """(set_id, block, chunks, rep) of the classes that may have a link."""
    counts = shared.groupBy("set_id").agg(F.count(F.lit(1)).alias("shared"))
    short = shared.where(F.col("length") <= SHORT_LIST).join(counts.join(reps.select("set_id", "last"), "set_id"), "set_id").select("s", "set_id", "n", "i", "last", "shared")
    pairs = short.repartition("s").sortWithinPartitions("s", "n", "set_id").mapInArrow(_pairs(num, den), "a long, b long, need long")
    edges = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")
    edges = edges.unionByName(_chained(shared.where(F.col("length") > SHORT_LIST), num, den))
    blocks = components(edges)
    sizes = blocks.groupBy("root").agg(F.count(F.lit(1)).alias("many")).select(F.col("root").alias("block"), F.ceil(F.col("many") / F.least(F.lit(max(CHUNK, MOST_CHUNK)), F.greatest(F.lit(CHUNK), F.col("many") / 64))).alias("chunks"))
    member = blocks.select(F.col("node").alias("set_id"), F.col("root").alias("block")).join(sizes, "block").join(reps.select("set_id", "rep"), "set_id")
    return common.stage(member.select("set_id", "block", "chunks", "rep"), "jaccard-members")


def _links(texts: DataFrame, member: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(set_id, root, links): the links of each class within a pair of chunks, and the smallest class they reach there."""
    small = member.count() <= BROADCAST_CLASSES
    at = [F.col("doc_id").eqNullSafe(F.col("rep.id")), F.col("code") == F.col("rep.code")]  # an id and its text, so that null or repeated ids meet nobody else's
    found = texts.join(F.broadcast(member) if small else member, at)
    sets = common.stage(found.select("set_id", "block", "chunks", "text").mapInArrow(_full_sets(k), "set_id long, block long, chunks long, shingles binary").dropDuplicates(["set_id"]), "jaccard-sets")
    dealt = sets.withColumn("chunk", F.pmod(F.xxhash64("set_id"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("block", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "set_id", "shingles")
    return common.stage(dealt.groupBy("block", "lo", "hi").applyInArrow(_search(num, den), "set_id long, root long, links long"), "jaccard-links")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, n_links (links of its set to other sets).

    Two documents link when ``den`` * |intersection| >= ``num`` * |union| of their distinct shingles.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text")).withColumn("code", F.xxhash64("text"))
    table = spark.sparkContext.broadcast(frequency_table(texts, k))
    # Each large table goes as soon as the next is written; without prefixes the rows and classes are small.
    prefixes = common.stage(texts.mapInArrow(_prefixes(k, num, den, table), "doc_id long, code long, n long, set_id long, last long, prefix array<long>"), "jaccard-prefixes")
    sets = common.stage(prefixes.select("doc_id", "n", "set_id"), "jaccard-rows")
    classes = common.stage(prefixes.where("n > 0").groupBy("set_id", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), "code")).alias("rep"), F.first("last").alias("last"), F.first("prefix").alias("prefix")), "jaccard-classes")
    common.drop(prefixes)
    shared = _shared_entries(classes)
    reps = common.stage(classes.select("set_id", "rep", "last"), "jaccard-reps")
    common.drop(classes)
    with common.scratch() as keep:
        member = keep(_members(shared, reps, num, den))
    common.drop(shared)
    with common.scratch() as keep:
        found = keep(_links(texts, member, k, num, den))
    common.drop(member)
    with common.scratch() as keep:
        roots = keep(common.stage(components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b"))), "jaccard-roots"))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    linked = roots.join(reps.select("set_id", "rep"), F.col("node") == F.col("set_id"))
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component"))
    placed = roots.join(smallest, "root").select(F.col("node").alias("set_id"), "component").join(links, "set_id", "left")
    joined = reps.select("set_id", "rep").join(placed, "set_id", "left").select("set_id", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = sets.join(joined, "set_id", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component.id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``df``, all columns kept: the one with the smallest known id.  Rows are told
    apart by a key of their own, so null and repeated ids are no obstacle; of rows alike one stays, unless
    they have no shingle."""
    key, gone_key = common.fresh(df, "near_key", "near_gone")
    rows = common.keyed(df, key)
    ids = rows.select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("id"))
    with common.scratch() as keep:
        found = jaccard_components(rows, key, text_col, **options).select("doc_id", "component_id")
        found = keep(common.stage(found.join(ids, F.col("doc_id") == F.col("row")).select("component_id", "row", "id"), "near-rows"))
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("void"), "id", "row"))["row"].alias("row"))
    gone = found.join(kept, "row", "left_anti").select(F.col("row").alias(gone_key))
    return common.without(rows, key, gone, gone_key).drop(key)
