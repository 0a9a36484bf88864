"""Exact top-k search by inner product over M-trees.

Vectors are quantised to integers.  With the coordinate sqrt(M^2 - |x|^2) added (M the largest norm; 0 for queries) the
inner product orders as a Euclidean distance does: d(q, x)^2 = |q|^2 + M^2 - 2 <q, x>, so metric bounds apply.

1. Routing objects.  A sampled vector per ``CELL`` entries (``MOST_CELLS`` at most); every distinct vector goes to the nearest
   one's cell, and a cell of more than two times ``CELL`` entries is dealt over pieces by hash.
2. Pages.  Each piece becomes an M-tree, bulk loaded: entries are assigned to sampled routing objects until at most
   ``PAGE`` are left.  Nodes are rows of a table - routing object, covering radius, distance to the parent's routing object - and leaf
   pages hold their entries with the distances to the page's routing object.
3. Search.  A query first searches the cell whose lower bound d(q, c) - r is least, then all other cells whose bound
   its k-th score does not rule out.  In a tree it proceeds best first: nodes wait in a heap by lower bound; before a child's
   or an entry's distance is computed, the stored parent distance rules it out where |d(q, p) - d(p, x)| is already too large.

Every bound has room for rounding, so nothing that belongs to the result is passed over.  Where inner products can pass what
doubles hold exactly, the best candidates are computed again with whole numbers of any size.

Bounded: the driver gets a routing object per cell, a task one piece's pages and a block of queries.  On vectors without
clusters the bounds rule little out: the work is then quadratic in the table, with a small constant.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of different length
meet as if the shorter ended in zeros, so an empty vector scores 0; equal scores rank by smaller id; repeated rows are candidates
of their own, and a query's own id is never its neighbour; a null id is none; scores beyond 64 bits are the nearest
64-bit number and rank as that; a table without usable vectors gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common
from sedge.llm.ann import _blocks, _vectors

K = 5
#: Entries of a leaf page and children of an inner node at most.
PAGE = 512
#: Entries of a cell, and queries of a block; a task holds one of each (twice as many entries at most).
CELL = 8192
BLOCK = 8192
MOST_CELLS = 8192
#: Share of the largest distance that bounds give way for rounding.
_ROOM = 1e-6
_LIMIT = 2**63
_PAGES = "cell long, piece long, node long, parent long, leaf boolean, radius double, up double, router binary, entries binary, vectors binary, away binary"
_FOUND = "ask long, entry long, score long, computed long"


class Scale(NamedTuple):
    """Quantised vectors are held as doubles times 2 ** -shift, which puts the largest norm, ``most``, at 1 at most; ``exact`` where
    doubles hold every inner product of the integers."""

    most: float
    shift: int
    width: int
    exact: bool


def quantise(x: np.ndarray, shift: int) -> np.ndarray:
    """floor(256 x) * 2 ** -shift; from 2 ** 45 on, 256 x has no fraction."""
    large = np.abs(x) >= 2.0**45
    return np.where(large, np.ldexp(x, 8 - shift), np.ldexp(np.floor(np.ldexp(np.where(large, 0, x), 8)), -shift)) + 0.0


def whole(x: np.ndarray) -> list[int]:
    """floor(256 x) as whole numbers of any size."""
    return [int(v) << 8 if abs(v) >= 2.0**45 else math.floor(v * 256) for v in x.tolist()]


def exact_score(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product of two quantised vectors, cut to 64 bits."""
    got = sum(i * j for i, j in zip(whole(a), whole(b), strict=False))
    return max(-_LIMIT, min(_LIMIT - 1, got))


class Tree(NamedTuple):
    """Nodes in order of creation, the root first."""

    parent: list[int]
    leaf: list[bool]
    radius: list[float]
    up: list[float]
    router: list[np.ndarray]
    members: list[np.ndarray]
    away: list[np.ndarray]


def _distances(x: np.ndarray, last: np.ndarray, at: int) -> np.ndarray:
    """Distances between entries and entry ``at``, the added coordinate in ``last``."""
    gap = x - x[at]
    return np.sqrt((gap * gap).sum(axis=1) + (last - last[at]) ** 2)


def build(x: np.ndarray, most: float, page: int = PAGE) -> Tree:
    """Bulk load: entries go to the nearest of some of them, until a page holds what is left."""
    last = np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))
    tree = Tree([], [], [], [], [], [], [])
    rng = np.random.default_rng(len(x))
    centre = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    waiting = [(-1, centre, np.arange(len(x)))]
    while waiting:
        parent, own, rows = waiting.pop()  # rows ascend
        node, away = len(tree.parent), _distances(x[rows], last[rows], int(np.searchsorted(rows, own)))
        tree.parent.append(parent)
        tree.radius.append(float(away.max()))
        up = 0.0 if parent < 0 else float(np.sqrt(((x[own] - tree.router[parent][:-1]) ** 2).sum() + (last[own] - tree.router[parent][-1]) ** 2))
        tree.up.append(up)
        tree.router.append(np.append(x[own], last[own]))
        tree.leaf.append(len(rows) <= page)
        tree.members.append(rows if len(rows) <= page else rows[:0])
        tree.away.append(away if len(rows) <= page else away[:0])
        if len(rows) <= page:
            continue
        many = min(page, -(-len(rows) // (page // 2)))
        seeds = rng.choice(rows, many, replace=False)
        # The nearest: with the added coordinate all norms are equal, so that of the largest inner product.
        near = np.argmax(x[rows] @ x[seeds].T + last[rows, None] * last[seeds], axis=1)
        near[np.searchsorted(rows, seeds)] = np.arange(many)
        groups = [rows[near == i] for i in range(many)]
        if max(map(len, groups)) == len(rows):
            groups = np.array_split(rows, many)  # nothing told the entries apart
            seeds = np.array([g[0] for g in groups])
        waiting += [(node, int(s), g) for s, g in zip(seeds, groups, strict=True) if len(g)]
    return tree


def _page_rows(t: pa.Table, at: Scale, page: int) -> pa.Table:
    """M-tree nodes of one piece as rows; each page holds its entries' numbers and vectors."""
    t = t.sort_by("entry")
    ids, raw = t.column("entry").to_numpy(), _vectors(t.column("v"))
    tree = build(quantise(raw, at.shift), at.most, page)
    many = len(tree.parent)
    same = lambda c: pa.array([t.column(c)[0].as_py()] * many, pa.int64())
    blob = lambda parts, kind: pa.array([np.ascontiguousarray(p, kind).tobytes() for p in parts], pa.binary())
    columns = [
        same("cell"), same("piece"), pa.array(range(many), pa.int64()), pa.array(tree.parent, pa.int64()), pa.array(tree.leaf), pa.array(tree.radius), pa.array(tree.up),
        blob(tree.router, "<f8"), blob([ids[m] for m in tree.members], "<i8"), blob([raw[m] for m in tree.members], "<f8"), blob(tree.away, "<f8"),
    ]
    return pa.table(columns, names=[c.split()[0] for c in _PAGES.split(", ")])


class Pages:
    """The pages of a piece, as they are read for a search."""

    def __init__(self, rows: pa.Table, at: Scale):
        rows = rows.sort_by("node")
        self.at = at
        self.radius, self.up = rows.column("radius").to_numpy(), rows.column("up").to_numpy()
        self.router = np.array([np.frombuffer(b.as_buffer(), "<f8") for b in rows.column("router")])
        self.children: list[list[int]] = [[] for _ in range(len(self.radius))]
        for node, parent in enumerate(rows.column("parent").to_pylist()):
            if parent >= 0:
                self.children[parent].append(node)
        self.children = [np.array(c, np.int64) for c in self.children]
        read = lambda c, kind: [np.frombuffer(b.as_buffer(), kind) for b in rows.column(c)]
        self.ids, self.away = read("entries", "<i8"), read("away", "<f8")
        self.raw = [v.reshape(len(i), -1) if len(i) else v.reshape(0, 0) for i, v in zip(self.ids, read("vectors", "<f8"), strict=True)]
        self.vectors = [quantise(v, at.shift) for v in self.raw]

    def search(self, raw: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, list[int], int]:
        """(entries, their scores, distances computed): the ``k`` best, ties by smaller entry, of scaled score ``floor`` at least."""
        at = self.at
        q = quantise(raw, at.shift)
        square = float(q @ q)
        room = _ROOM * (at.most + math.sqrt(square))
        far = lambda bar: math.sqrt(max(0.0, square + at.most**2 - 2 * bar)) + room if bar > -math.inf else math.inf
        bar, best, node_of, spot = floor, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        limit, computed = far(bar), 1
        near = math.sqrt(max(0.0, square + at.most**2 - 2 * float(self.router[0][:-1] @ q)))
        heap = [(max(0.0, near - self.radius[0]), 0, near)]
        while heap:
            bound, node, own = heapq.heappop(heap)
            if bound > limit:
                break
            if len(self.children[node]):
                children = self.children[node]
                children = children[np.abs(own - self.up[children]) - self.radius[children] <= limit]
                computed += len(children)
                away = np.sqrt(np.maximum(0.0, square + at.most**2 - 2 * (self.router[children, :-1] @ q)))
                bounds = np.maximum(0.0, away - self.radius[children])
                for i in np.flatnonzero(bounds <= limit):
                    heapq.heappush(heap, (float(bounds[i]), int(children[i]), float(away[i])))
                continue
            some = np.flatnonzero(np.abs(own - self.away[node]) <= limit)
            computed += len(some)
            score = self.vectors[node][some] @ q
            good = score >= bar - room * room
            best, spot = np.concatenate([best, score[good]]), np.concatenate([spot, some[good]])
            node_of = np.concatenate([node_of, np.full(int(good.sum()), node)])
            if len(best) >= k:
                last = float(np.partition(best, len(best) - k)[len(best) - k])
                if last > bar:
                    bar = last
                    limit = far(bar)
                good = best >= bar - room * room
                best, spot, node_of = best[good], spot[good], node_of[good]
        ids = np.array([self.ids[n][s] for n, s in zip(node_of, spot, strict=True)], np.int64)
        if at.exact:
            scores = [int(s) for s in np.ldexp(best, 2 * at.shift).tolist()]
        else:
            scores = [exact_score(self.raw[n][s], raw) for n, s in zip(node_of, spot, strict=True)]
        keep = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[keep], [scores[i] for i in keep], computed


def _search(pages: pa.Table, asks: pa.Table, at: Scale, k: int) -> pa.Table:
    if not pages.num_rows or not asks.num_rows:
        return pa.table({"ask": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "computed": pa.array([], pa.int64())})
    tree, ask, entry, score, computed = Pages(pages, at), [], [], [], []
    for own, raw, floor in zip(asks.column("entry").to_pylist(), _vectors(asks.column("v")), asks.column("floor").to_pylist(), strict=True):
        # A cut score says nothing exact; the room of the search covers the rest.
        low = -math.inf if floor is None or abs(floor) >= _LIMIT - 1 else math.ldexp(float(floor), -2 * at.shift)
        ids, got, n = tree.search(raw, k, low)
        ask += [own] * len(ids)
        entry += ids.tolist()
        score += got
        computed += [n] * len(ids)
    return pa.table({"ask": pa.array(ask, pa.int64()), "entry": pa.array(entry, pa.int64()), "score": pa.array(score, pa.int64()), "computed": pa.array(computed, pa.int64())})


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Vectors as ``width`` doubles each, zeros at the end."""
    for b in batches:
        column = b.column("vector")
        size = np.diff(column.offsets.to_numpy())
        flat = np.zeros((b.num_rows, width))
        flat[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        flat += 0.0  # one zero
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "v"])


def _powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest component of each batch as a power of two."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frexp(np.abs(_vectors(b.column("v"))).max())[1])], pa.int32())], names=["power"])


def _norms(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """The largest squared norm of each batch."""
    for b in batches:
        if b.num_rows:
            x = quantise(_vectors(b.column("v")), shift)
            yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max())])], names=["square"])


def _deal(batches: Iterator[pa.RecordBatch], routers: np.ndarray, at: Scale) -> Iterator[pa.RecordBatch]:
    """Adds each entry's cell, that of its nearest routing object, and the distance to it."""
    size = (routers * routers).sum(axis=1)
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            t = b.slice(lo, 1024)
            x = quantise(_vectors(t.column("v")), at.shift)
            square = (x * x).sum(axis=1)
            lifted = np.column_stack([x, np.sqrt(np.maximum(at.most**2 - square, 0))])
            cell = np.argmin(size - 2 * (lifted @ routers.T), axis=1)
            away = np.sqrt(((lifted - routers[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([t.column("entry"), t.column("v"), t.column("asking"), pa.array(cell), pa.array(away)], names=["entry", "v", "asking", "cell", "away"])


def _bounds(q: np.ndarray, routers: np.ndarray, radii: np.ndarray, at: Scale) -> tuple[np.ndarray, np.ndarray]:
    """(lower bound of the distance to each cell's entries, |q|^2) of queries."""
    square = (q * q).sum(axis=1)
    away = np.sqrt(np.maximum(0.0, square[:, None] + at.most**2 - 2 * (q @ routers[:, :-1].T)))
    return np.maximum(0.0, away - radii), square


def _homes(batches: Iterator[pa.RecordBatch], routers: np.ndarray, radii: np.ndarray, at: Scale) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            t = b.slice(lo, 256)
            bound, _ = _bounds(quantise(_vectors(t.column("v")), at.shift), routers, radii, at)
            yield pa.RecordBatch.from_arrays([t.column("entry"), t.column("v"), pa.array(np.argmin(bound, axis=1))], names=["entry", "v", "home"])


def _others(batches: Iterator[pa.RecordBatch], routers: np.ndarray, radii: np.ndarray, at: Scale) -> Iterator[pa.RecordBatch]:
    """(query, other cell) where the query's k-th score leaves the cell in."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            t = b.slice(lo, 256)
            bound, square = _bounds(quantise(_vectors(t.column("v")), at.shift), routers, radii, at)
            floor = t.column("floor").fill_null(-_LIMIT).to_numpy(zero_copy_only=False)
            known = np.abs(floor.astype(float)) < float(_LIMIT)
            bar = np.ldexp(floor.astype(float), -2 * at.shift)
            limit = np.where(known, np.sqrt(np.maximum(0.0, square + at.most**2 - 2 * bar)) + _ROOM * (at.most + np.sqrt(square)), np.inf)
            row, cell = np.nonzero((bound <= limit[:, None]) & np.isfinite(radii))
            away = cell != t.column("home").to_numpy()[row]
            took = t.take(pa.array(row[away]))
            for i in range(0, took.num_rows, 4096):
                s = took.slice(i, 4096)
                yield pa.RecordBatch.from_arrays([s.column(c) for c in ("entry", "v", "floor", "block")] + [pa.array(cell[away][i : i + 4096])], names=["entry", "v", "floor", "block", "cell"])


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = K, cell: int = CELL, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score, computed: the ``k`` largest inner products of each row whose id is divisible by
    ``every``; ``computed`` is the number of distances of the tree in which the neighbour was found."""
    spark = df.sparkSession
    void = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, computed long")
    vector = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return void
    width = max(1, width)
    rows = common.stage(rows.mapInArrow(partial(_pack, width=width), "id long, v binary"), "mtree-rows")
    power = 8 + rows.mapInArrow(_powers, "power int").agg(F.max("power")).first()[0]  # integers are below 2 ** power
    shift = power + math.ceil(math.log2(width + 1) / 2)
    most = math.sqrt(rows.mapInArrow(partial(_norms, shift=shift), "square double").agg(F.max("square")).first()[0])
    # Exact where every partial sum, width * 2 ** (2 * power) at most, is a whole number that doubles hold.
    at = Scale(most, shift, width, 2 * power + math.log2(width) <= 53)

    # The k + 1 smallest distinct ids of each distinct vector, and how many rows each has (k at most).
    first = rows.groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("m")).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = first.groupBy("v").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list(F.struct("id", "m"))).alias("ids"))
    asking = rows.where(F.col("id") % every == 0).select("v").distinct().withColumn("asking", F.lit(True))
    entries = common.stage(entries.join(asking, "v", "left").withColumn("asking", F.coalesce("asking", F.lit(False))), "mtree-entries")
    count = entries.count()
    cells = max(1, min(MOST_CELLS, count // cell))
    drawn = entries.orderBy(F.xxhash64("entry"), "entry").limit(cells).select("v").toArrow().column("v")
    x = quantise(_vectors(drawn), shift)
    routers = np.column_stack([x, np.sqrt(np.maximum(at.most**2 - (x * x).sum(axis=1), 0))])
    dealt = common.stage(entries.select("entry", "v", "asking").mapInArrow(partial(_deal, routers=routers, at=at), "entry long, v binary, asking boolean, cell long, away double"), "mtree-cells")
    found = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).toArrow()  # MOST_CELLS rows at most
    radii = np.full(len(routers), -np.inf)  # an empty cell is infinitely far
    radii[found.column("cell").to_numpy()] = found.column("radius").to_numpy() + _ROOM * at.most
    sizes = [(c, -(-n // (2 * cell))) for c, n in zip(found.column("cell").to_pylist(), found.column("n").to_pylist(), strict=True)]
    pieces = F.broadcast(spark.createDataFrame(sizes, "cell long, pieces long"))  # as many
    placed = dealt.select("cell", "entry", "v").join(pieces, "cell").select("cell", F.pmod(F.xxhash64("entry"), "pieces").alias("piece"), "entry", "v")
    pages = common.stage(placed.groupBy("cell", "piece").applyInArrow(lambda t: _page_rows(t, at, page), _PAGES), "mtree-pages")

    shared = {"routers": routers, "radii": radii, "at": at}
    asks = common.stage(dealt.where("asking").select("entry", "v").mapInArrow(partial(_homes, **shared), "entry long, v binary, home long"), "mtree-asks")
    homes = {r["home"]: r["count"] for r in asks.groupBy("home").count().collect()}  # MOST_CELLS rows at most
    homes = F.broadcast(spark.createDataFrame(_blocks(homes, block), "home long, first long, blocks long"))
    asks = asks.join(homes, "home").select("entry", "v", "home", (F.col("first") + F.pmod(F.xxhash64("entry"), "blocks")).alias("block"))

    def look(asked: DataFrame) -> DataFrame:
        """Each query of ``asked`` in all trees of its cell, a task for each tree and block."""
        spread = asked.join(pieces, "cell").select("entry", "v", "floor", "block", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        wanted = asked.select(F.col("cell").alias("at"), F.col("block").alias("of")).distinct()
        copies = pages.join(wanted, F.col("cell") == F.col("at")).withColumnsRenamed({"cell": "to_cell", "piece": "to_piece", "of": "to_block"}).drop("at")
        return copies.groupBy("to_cell", "to_piece", "to_block").cogroup(spread.groupBy("cell", "piece", "block")).applyInArrow(lambda tree, asked: _search(tree, asked, at, k + 1), _FOUND)

    begun = common.stage(look(asks.select("entry", "v", "block", F.col("home").alias("cell"), F.lit(None).cast("long").alias("floor"))), "mtree-first")
    if cells > 1:
        ranked = begun.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "entry"))).where(F.col("n") == k + 1)
        floor = ranked.select(F.col("ask").alias("entry"), F.col("score").alias("floor"))
        others = asks.join(floor, "entry", "left").select("entry", "v", "floor", "block", "home").mapInArrow(partial(_others, **shared), "entry long, v binary, floor long, block long, cell long")
        begun = begun.unionByName(look(common.stage(others, "mtree-others")))
    best = begun.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "entry"))).where(F.col("n") <= k + 1).drop("n")
    best = best.join(entries.select("entry", "ids"), "entry").select("ask", "score", "computed", F.inline("ids"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = best.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score", "m", "computed"))).alias("list"))  # k + 1 ids a query
    queries = rows.where(F.col("id") % every == 0).join(entries.select("v", "entry"), "v").select(F.col("id").alias("query_id"), F.col("entry").alias("ask"))
    own_out = F.filter("list", lambda x: x["id"] != F.col("query_id"))
    each_row = F.flatten(F.transform(own_out, lambda x: F.array_repeat(x, x["m"])))
    listed = queries.distinct().join(lists, "ask").select("query_id", F.posexplode(F.slice(each_row, 1, k)).alias("p", "x"))
    return listed.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"), F.col("x.computed").alias("computed"))
