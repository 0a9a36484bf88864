"""Largest-inner-product search with stable projections indexed by kd-trees.

Inner products become distances by one added coordinate, sqrt(M^2 - |x|^2) with M the largest norm;
queries get 0 there and norm M.  A fixed Gaussian (2-stable) matrix with orthonormalised columns projects
the D coordinates to m, ``DIMS`` or half of D at most.  Whatever the data, the share of a pair's squared
distance that the projection keeps is chi^2(m) / (chi^2(m) + chi^2(D - m)), a ratio of independent
chi-square variables; plain Gaussian columns would give chi^2(m) alone, which varies more and so stops later.

Every distinct vector is indexed (equal vectors are one entry with its ``k + 1`` smallest distinct ids and
how often each occurs, which is all that a ranking with ties by id can show).  Medians of a bounded sample
deal the entries over the cells of a top kd-tree; a cell of more than two times ``cell`` entries is dealt over
pieces by hash, and each piece has a kd-tree of its own.  Queries form blocks of neighbours.  A query
searches its own cell first; then it descends the top tree to every other cell whose box can still
hold a neighbour.  In a piece the projected neighbours are taken by rising projected distance, in growing
batches, and verified by their inner products until the stopping test holds: next projected distance^2 >=
k-th distance^2 * quantile ``SURE`` of the ratio above.  A true neighbour is passed over with probability
1 - ``SURE`` at most, so ``SURE`` is the expected recall's lower bound on any data.

Bounds: the driver gets ``SAMPLE`` projected points and a box per cell (``MOST_CELLS`` at most); a task gets one
piece and one block of queries.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or
non-finite component take no part; in a table whose largest norm has a square beyond doubles every query is held against every vector, without
projections; equal scores rank by smaller id; a table without usable vectors gives
an empty result; repeated rows are separate candidates (a query's own id is never its neighbour).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common

K = 20
DIMS = 32
SURE = 0.95
LEAF = 256
#: Entries of a cell, and queries of a block; a task holds one of each (twice as many entries at most).
CELL = 8192
BLOCK = 8192
MOST_CELLS = 8192
#: Entries sampled at most to place the cells' borders.
SAMPLE = 1 << 17
#: Queries whose projected distances are held at once, and pairs of query and box weighed at once.
TOGETHER, PAIRS = 64, 1 << 16
_NEAR = 1e-9


def stop_quantile(p: float, dims: int, full: int) -> float:
    """Quantile of chi^2(dims) / (chi^2(dims) + chi^2(full - dims)): the squared sine of an angle whose density
    is sin^(dims - 1) cos^(full - dims - 1); 1 where nothing is projected away."""
    if dims >= full:
        return 1.0
    angle = np.linspace(0, math.pi / 2, 200_001)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = (dims - 1) * np.log(np.sin(angle)) + (full - dims - 1) * np.log(np.cos(angle)) if full - dims > 1 else (dims - 1) * np.log(np.sin(angle))
    mass = np.cumsum(np.exp(np.nan_to_num(log, nan=0.0, neginf=-1e9) - np.max(log[np.isfinite(log)])))
    return float(np.sin(angle[np.searchsorted(mass, p * mass[-1])]) ** 2)


def lengths(q: np.ndarray) -> np.ndarray:
    """Norms of rows, whose squares may be too large or too small for doubles."""
    power = np.frexp(np.abs(q).max(axis=1))[1]
    q = np.ldexp(q, -power[:, None])
    return np.ldexp(np.sqrt((q * q).sum(axis=1)), power)


class Space(NamedTuple):
    """What all tasks share: the added coordinate's scale, the projection and the stopping test."""

    most: float
    matrix: np.ndarray
    quantile: float
    k: int
    #: The largest norm's square is too large or too small for doubles: no distances, every vector is verified.
    plain: bool = False

    def points(self, x: np.ndarray) -> np.ndarray:
        """Projections of entries (rows) after the added coordinate."""
        if self.plain:
            return np.zeros((len(x), self.matrix.shape[1]))
        last = np.sqrt(np.maximum(self.most * self.most - (x * x).sum(axis=1), 0))
        return np.column_stack([x, last]) @ self.matrix

    def spots(self, q: np.ndarray) -> np.ndarray:
        """Projections of queries, scaled to the largest norm."""
        if self.plain:
            return np.zeros((len(q), self.matrix.shape[1]))
        return (q / lengths(q)[:, None] * self.most) @ self.matrix[:-1]

    def limits(self, bars: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared projected distances from which on nothing need be verified: |x - q|^2 is
        2 M^2 - 2 M <x, q> / |q| in the space of the added coordinate."""
        if self.plain:
            return np.full(np.broadcast(bars, norms).shape, np.inf)[()]
        return self.quantile * np.maximum(0.0, 2 * self.most * self.most - 2 * self.most * bars / norms) * (1 + _NEAR) + _NEAR * self.most * self.most


def space(most: float, dims: int, k: int, sure: float) -> Space:
    full = dims + 1
    m = min(DIMS, max(1, full // 2))
    matrix = np.linalg.qr(np.random.default_rng(11).standard_normal((full, m)))[0]
    plain = not 1e-280 < most * most < 1e300
    return Space(1.0 if plain else most, matrix, stop_quantile(sure, m, full), k, plain)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles from equally long binary values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros((0, 0))
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return np.frombuffer(raw.tobytes(), "<f8").reshape(len(column), -1)


class Tree:
    """A kd-tree by rank (equal points split too); leaves are slices of ``order`` with boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        stack = [(0, len(points))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= leaf:
                self.leaves.append((lo, hi))
                continue
            own = points[self.order[lo:hi]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
            stack += [(lo, lo + mid), (lo + mid, hi)]
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in self.leaves])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in self.leaves])


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes (rows, or one point to many)."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed the same way whatever the number of rows; where parts pass doubles, of scaled vectors, so that
    the sum is what it would be without a bound, cut to doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        got = (x * q).sum(axis=1)
        wide = np.flatnonzero(~np.isfinite(got))
        if len(wide):
            got[wide] = np.ldexp((np.ldexp(x[wide], -600) * np.ldexp(q, -600)).sum(axis=1), 1200)
    return got


def _verify(x: np.ndarray, ids: np.ndarray, far: np.ndarray, vec: np.ndarray, norm: float, floor: float, at: Space) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, scores, how many were verified) of the k + 1 best entries of score ``floor`` at least: entries
    are taken by rising projected distance ``far``, in batches, until the stopping test holds."""
    keep, slack = at.k + 1, 0.0 if at.plain else _NEAR * at.most * norm
    bar, limit = floor, np.inf if floor == -np.inf else at.limits(floor, norm)
    left = np.flatnonzero(far < limit)
    best, value, seen, step = np.zeros(0, np.int64), np.zeros(0), 0, 4 * keep
    while len(left):
        now, left = left, left[:0]
        if len(now) > 2 * step:
            part = np.argpartition(far[now], step)
            now, left = now[part[:step]], now[part[step:]]
        got = scores(x[now], vec) if at.plain else x[now] @ vec
        seen += len(now)
        good = got >= bar - slack
        best, value = np.concatenate([best, now[good]]), np.concatenate([value, got[good]])
        if len(value) >= keep:
            bar = max(bar, np.partition(value, len(value) - keep)[len(value) - keep])
            good = value >= bar - slack
            best, value = best[good], value[good]
            limit = min(limit, at.limits(bar, norm))
            left = left[far[left] < limit]
        step *= 4
    value = scores(x[best], vec)
    top = np.lexsort((ids[best], -value))[:keep]
    top = top[value[top] >= floor]
    return best[top], value[top], seen


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, at: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query number, entry id, score) of what each query finds, and how many entries each verified."""
    points = at.points(x)
    tree = Tree(points)
    x, ids, points = x[tree.order], ids[tree.order], points[tree.order].astype(np.float32)
    square = (points * points).sum(axis=1)
    spots, norms = at.spots(q), lengths(q)
    limits = np.where(np.isneginf(floors), np.inf, at.limits(np.where(np.isneginf(floors), 0, floors), norms))
    # Single precision loses this much of a squared distance between points of norm M.
    loose = 1e-5 * at.most * at.most
    rows, found, value, seen = [], [], [], np.zeros(len(q), np.int64)
    for lo in range(0, len(q), TOGETHER):
        own = np.arange(lo, min(lo + TOGETHER, len(q)))
        reach = np.zeros(len(tree.leaves), bool)
        for i in own:
            reach |= box_distance(spots[i], tree.low, tree.high) < limits[i]
        if not reach.any():
            continue
        part = np.concatenate([np.arange(a, b) for (a, b), r in zip(tree.leaves, reach, strict=True) if r])
        near = spots[own].astype(np.float32)
        far = square[part] + (near * near).sum(axis=1)[:, None] - 2 * (near @ points[part].T) - np.float32(loose)
        sub = x[part]
        for i, d in zip(own, far, strict=True):
            best, got, seen[i] = _verify(sub, ids[part], d, q[i], norms[i], floors[i], at)
            rows.append(np.full(len(best), i))
            found.append(ids[part][best])
            value.append(got)
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return join(rows, np.int64), join(found, np.int64), join(value, np.float64), seen


_FOUND = "ask long, entry long, score double"


def _search_piece(at: Space):
    def run(data: pa.Table, asks: pa.Table) -> pa.Table:
        if not data.num_rows or not asks.num_rows:
            return pa.table({"ask": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        data = data.sort_by("entry")
        ids, ask = data.column("entry").to_numpy(), asks.column("entry").to_numpy()
        floors = asks.column("floor").fill_null(-math.inf).to_numpy()
        row, entry, score, _ = search(_vectors(data.column("v")), ids, _vectors(asks.column("v")), floors, at)
        return pa.table({"ask": ask[row], "entry": entry, "score": score})

    return run


def _borders(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, border) of the inner nodes of a full binary top tree in heap order."""
    axes, borders = np.zeros(cells - 1, np.int64), np.zeros(cells - 1)
    groups = {0: sample}
    for i in range(cells - 1):
        own = groups.pop(i)
        if len(own):
            axes[i] = np.argmax(own.max(axis=0) - own.min(axis=0))
            borders[i] = np.median(own[:, axes[i]])
        groups[2 * i + 1], groups[2 * i + 2] = own[own[:, axes[i]] < borders[i]], own[own[:, axes[i]] >= borders[i]]
    return axes, borders


def _cell_of(points: np.ndarray, nodes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    axes, borders = nodes
    at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
    for _ in range((len(axes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[rows, axes[at]] >= borders[at])
    return at - len(axes)


def _project(at: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = at.points(_vectors(b.column("v"))).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in p], pa.binary())], names=["point"])

    return run


def _deal(at: Space, nodes: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("v"))
                p = at.points(x)
                point = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
                cells = [pa.array(_cell_of(c, nodes)) for c in (p, at.spots(x))]
                yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("v"), b.column("asking"), *cells, point], names=["entry", "v", "asking", "cell", "home", "point"])

    return run


class Boxes:
    """Bounding boxes of the top tree's nodes in heap order; those of empty cells are reached by nothing."""

    def __init__(self, cells: int, cell: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.low = np.full((2 * cells - 1, low.shape[1]), np.inf)
        self.high = np.full((2 * cells - 1, low.shape[1]), -np.inf)
        self.first = cells - 1
        self.low[cell + self.first], self.high[cell + self.first] = low, high
        for i in range(cells - 2, -1, -1):
            self.low[i] = np.minimum(self.low[2 * i + 1], self.low[2 * i + 2])
            self.high[i] = np.maximum(self.high[2 * i + 1], self.high[2 * i + 2])

    def reach(self, spots: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells nearer than the rows' limits, by descent from the root."""
        row, node = np.arange(len(spots)), np.zeros(len(spots), np.int64)
        while True:
            good = np.zeros(len(row), bool)
            for lo in range(0, len(row), PAIRS):
                r, n = row[lo : lo + PAIRS], node[lo : lo + PAIRS]
                full = np.isfinite(self.low[n, 0])
                good[lo : lo + PAIRS][full] = box_distance(spots[r[full]], self.low[n[full]], self.high[n[full]]) < limits[r[full]]
            row, node = row[good], node[good]
            if not len(row) or node[0] >= self.first:
                return row, node - self.first
            row, node = np.repeat(row, 2), np.column_stack([2 * node + 1, 2 * node + 2]).ravel()


def _others(at: Space, boxes: Boxes):
    """Rows of (query, other cell that it must search)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(lo, TOGETHER)
                q = _vectors(b.column("v"))
                floors = b.column("floor").fill_null(-math.inf).to_numpy(zero_copy_only=False)
                open_ = np.isneginf(floors)
                limits = np.where(open_, np.inf, at.limits(np.where(open_, 0, floors), lengths(q)))
                row, cell = boxes.reach(at.spots(q), limits)
                away = cell != b.column("home").to_numpy()[row]
                row, cell = row[away], cell[away]
                for i in range(0, len(row), 4096):
                    t = b.take(pa.array(row[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([t.column(c) for c in ("entry", "v", "floor", "block")] + [pa.array(cell[i : i + 4096])], names=["entry", "v", "floor", "block", "cell"])

    return run


def _pack_vectors(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column("vector").flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, dims)
            flat = flat + 0.0  # one zero
            with np.errstate(over="ignore"):
                square = (flat * flat).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array(square)], names=["id", "v", "square"])

    return run


def _blocks(homes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(home cell, first block, blocks): neighbouring cells share a block of about ``most`` queries, a cell with more has several."""
    out, block, fill = [], 0, 0
    for home in sorted(homes):
        n = homes[home]
        pieces = -(-n // most)
        if fill and fill + n > most:
            block, fill = block + 1, 0
        out.append((home, block, pieces))
        if pieces > 1:
            block, fill = block + pieces, 0
        else:
            fill += n
    return out


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, sure: float = SURE, dims: int | None = None, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    void = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vector = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists(vector, lambda x: x != 0)
    rows = df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    if dims is None:
        common_size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
        if common_size is None:
            return void
        dims = common_size["d"]
    rows = common.stage(rows.where(F.size("vector") == dims).mapInArrow(_pack_vectors(dims), "id long, v binary, square double"), "ann-rows")
    # The k + 1 smallest distinct ids of each distinct vector, so that k are left without a query's own, and how
    # many rows each has (k at most); Spark cuts to those before the window's shuffle (WindowGroupLimit).
    first = rows.groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("m")).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = first.groupBy("v").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list(F.struct("id", "m"))).alias("ids"))
    asking = rows.where(F.col("id") % every == 0).select("v").distinct().withColumn("asking", F.lit(True))
    entries = common.stage(entries.join(asking, "v", "left").withColumn("asking", F.coalesce("asking", F.lit(False))), "ann-entries")
    most = math.sqrt(rows.agg(F.max("square")).first()[0] or 0.0)
    count = entries.count()
    if not count:
        return void
    at = space(most, dims, k, sure)
    cells = min(MOST_CELLS, 1 << max(0, math.ceil(math.log2(max(1, count / cell)))))
    sample = entries.where(F.pmod(F.xxhash64("entry"), F.lit(-(-2 * count // SAMPLE))) == 0).orderBy("entry").limit(SAMPLE).select("v")
    points = sample.mapInArrow(_project(at), "point binary").toArrow().column("point") if cells > 1 else []
    nodes = _borders(np.array([np.frombuffer(p.as_buffer(), "<f4") for p in points], np.float64).reshape(-1, at.matrix.shape[1]), cells)
    dealt = common.stage(entries.select("entry", "v", "asking").mapInArrow(_deal(at, nodes), "entry long, v binary, asking boolean, cell long, home long, point array<double>"), "ann-cells")
    m = range(at.matrix.shape[1])
    lows, highs = ([fn(F.col("point")[d]).alias(f"{n}{d}") for d in m] for fn, n in ((F.min, "l"), (F.max, "h")))
    found = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *lows, *highs).toArrow()  # MOST_CELLS rows at most
    low, high = (np.column_stack([found.column(f"{n}{d}").to_numpy() for d in m]) for n in "lh")
    boxes = Boxes(cells, found.column("cell").to_numpy(), low, high)
    pieces = [(c, -(-n // (2 * cell))) for c, n in zip(found.column("cell").to_pylist(), found.column("n").to_pylist(), strict=True)]
    pieces = F.broadcast(spark.createDataFrame(pieces, "cell long, pieces long"))  # MOST_CELLS rows at most
    homes = {r["home"]: r["count"] for r in dealt.where("asking").groupBy("home").count().collect()}  # as many
    homes = F.broadcast(spark.createDataFrame(_blocks(homes, block), "home long, first long, blocks long"))

    data = dealt.select("cell", "entry", "v").join(pieces, "cell").select("cell", F.pmod(F.xxhash64("entry"), "pieces").alias("piece"), "entry", "v")
    asks = dealt.where("asking").join(homes, "home").select("entry", "v", "home", (F.col("first") + F.pmod(F.xxhash64("entry"), "blocks")).alias("block"))

    def look(asked: DataFrame) -> DataFrame:
        """Each query of ``asked`` in all pieces of its cell, a task for each piece and block."""
        group = ["cell", "piece", "block"]
        spread = asked.join(pieces, "cell").select("entry", "v", "floor", "block", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        wanted = asked.select(F.col("cell").alias("at"), F.col("block").alias("of")).distinct()
        copies = data.join(wanted, F.col("cell") == F.col("at")).select(*(F.col(a).alias(b) for a, b in (("cell", "to_cell"), ("piece", "to_piece"), ("of", "to_block"), ("entry", "entry"), ("v", "v"))))
        return copies.groupBy("to_cell", "to_piece", "to_block").cogroup(spread.groupBy(*group)).applyInArrow(_search_piece(at), _FOUND)

    # A query's home is where its scaled self would lie, which is its neighbourhood though perhaps not its cell.
    begun = common.stage(look(asks.select("entry", "v", "block", F.col("home").alias("cell"), F.lit(None).cast("double").alias("floor"))), "ann-first")
    if cells > 1:
        ranked = begun.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "entry"))).where(F.col("n") == k + 1)
        floor = ranked.select(F.col("ask").alias("entry"), F.col("score").alias("floor"))
        others = asks.join(floor, "entry", "left").select("entry", "v", "floor", "block", "home").mapInArrow(_others(at, boxes), "entry long, v binary, floor double, block long, cell long")
        begun = begun.unionByName(look(common.stage(others, "ann-others")))
    found = begun.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "entry"))).where(F.col("n") <= k + 1).drop("n")
    found = found.join(entries.select("entry", "ids"), "entry").select("ask", "score", F.inline("ids"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = found.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score", "m"))).alias("list"))  # k + 1 ids a query
    queries = rows.where(F.col("id") % every == 0).join(entries.select("v", "entry"), "v").select(F.col("id").alias("query_id"), F.col("entry").alias("ask"))
    own_out = F.filter("list", lambda x: x["id"] != F.col("query_id"))
    each_row = F.flatten(F.transform(own_out, lambda x: F.array_repeat(x, x["m"])))
    listed = queries.distinct().join(lists, "ask").select("query_id", F.posexplode(F.slice(each_row, 1, k)).alias("p", "x"))
    return listed.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
