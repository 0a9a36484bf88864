"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from sedge.llm import mtree

DDL = "vec_id long, embedding array<double>"


def whole(v):
    return [math.floor(256 * x) if abs(x) < 2**40 else int(x) * 256 for x in v]


def brute(rows, every, k):
    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for query, q in {(i, tuple(v)) for i, v in good if i % every == 0}:
        pairs = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=False)))), i) for i, v in good if i != query]
        out |= {(query, rank, i, -s) for rank, (s, i) in enumerate(sorted(pairs)[:k], 1)}
    return out


def found(spark, rows, every, k, **options):
    return [tuple(r)[:4] for r in mtree.top_k(spark.createDataFrame(rows, DDL).repartition(3), every=every, k=k, **options).collect()]


def clustered(n, dims, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dims))
    return centres[rng.integers(0, 8, n)] + 0.05 * rng.standard_normal((n, dims))


@pytest.mark.parametrize(("cell", "page"), [(8192, 64), (60, 8)])
def test_top_k(spark, cell, page):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(700, 12))]
    rows += [(700 + i, rows[7][1]) for i in range(40)] + [(7, rows[7][1])] * 3 + [(50, rows[50][1])] * 30  # ties and repeats
    rows += [(None, [1.0] * 12), (900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (950, []), (951, [9.0]), (1000, [2.0] * 20), (1050, [0.0] * 12)]
    got = found(spark, rows, 50, 5, cell=cell, page=page)
    want = brute(rows, 50, 5)
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("large", [1e4, 3e12, 1e200, 1.7e308])
def test_numbers_beyond_doubles(spark, large):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-9, 9, 3) + rng.integers(0, 512, 3) / 512).tolist()) for i in range(60)]
    rows += [(60, [large, -large, 1.0]), (61, [large, 1.0, 1.0]), (62, [-large, 0.001, 3.0]), (63, [large, 1.0, 1.0]), (64, [0.0, 0.0, -0.0])]
    assert set(found(spark, rows, 2, 5)) == brute(rows, 2, 5)


def test_few_and_none(spark):
    assert set(found(spark, [(0, [1.0]), (1, [0.5])], 1, 5)) == {(0, 1, 1, 32768), (1, 1, 0, 32768)}
    assert found(spark, [(0, [1.0])], 1, 5) == [] and found(spark, [], 1, 5) == [] and found(spark, [(0, None)], 1, 5) == []
    clash = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [2.0], 2, "y")], f"{DDL}, entry long, V string")
    assert [tuple(r)[:4] for r in mtree.top_k(clash, every=2).collect()] == [(0, 1, 1, 131072)]


def test_bounds_spare_distances():
    """On clustered vectors most distances are never computed, and the result is the same."""
    x = clustered(4000, 16)
    raw = x.copy()
    power = 8 + int(np.frexp(np.abs(x).max())[1])
    shift = power + 3
    q = mtree.quantise(x, shift)
    at = mtree.Scale(float(np.sqrt((q * q).sum(axis=1).max())), shift, 16, True)
    import pyarrow as pa

    table = pa.table({"cell": [0] * len(x), "piece": [0] * len(x), "entry": range(len(x)), "v": [r.tobytes() for r in raw]})
    pages = mtree.Pages(mtree._page_rows(table, at, 32), at)
    ints = np.floor(256 * x).astype(np.int64)
    spent = []
    for i in range(0, 4000, 100):
        ids, scores, computed = pages.search(raw[i], 6, -math.inf)
        full = ints @ ints[i]
        order = np.lexsort((np.arange(len(x)), -full))[:6]
        assert ids.tolist() == order.tolist() and scores == full[order].tolist()
        spent.append(computed)
    assert np.mean(spent) < 0.35 * len(x)


def test_tree_invariants():
    x = clustered(900, 6)
    x[100:300] = x[100]  # equal entries
    most = float(np.sqrt((x * x).sum(axis=1).max()))
    tree = mtree.build(x, most, 16)
    lifted = np.column_stack([x, np.sqrt(np.maximum(most**2 - (x * x).sum(axis=1), 0))])
    held = np.concatenate(tree.members)
    assert sorted(held.tolist()) == list(range(900)) and max(map(len, tree.members)) <= 16
    for node in range(len(tree.parent)):
        rows, up = tree.members[node], node
        np.testing.assert_allclose(np.sqrt(((lifted[rows] - tree.router[node]) ** 2).sum(axis=1)), tree.away[node], atol=1e-9)
        while up >= 0:  # inside all covering radii above
            assert (np.sqrt(((lifted[rows] - tree.router[up]) ** 2).sum(axis=1)) <= tree.radius[up] + 1e-9).all()
            up = tree.parent[up]
        if tree.parent[node] >= 0:
            assert math.isclose(tree.up[node], np.sqrt(((tree.router[node] - tree.router[tree.parent[node]]) ** 2).sum()), abs_tol=1e-9)
