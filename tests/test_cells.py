"""Vector search over stored cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.engine import Engine
from sedge.operators import cells, search
from sedge.schema import IndexSpec


def clustered(n, dim, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return centres[rng.integers(0, groups, n)] + 0.35 * rng.standard_normal((n, dim))


@pytest.fixture(scope="module")
def rows():
    made = [(f"v{i:04}", x.tolist()) for i, x in enumerate(clustered(3000, 16, 40))]
    return [*made, ("zero", [0.0] * 16), ("none", None), ("short", [1.0])]


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    return cells.Cells(spark, f"file://{tmp_path_factory.mktemp('cells')}/v", "id").build(df, "embedding", 16, rows=75)


def top(df, k):
    return [r.id for r in df.orderBy(F.desc("score"), "id").limit(k).collect()]


def test_exact_search_equals_a_scan(spark, rows, stored):
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    for q in (rows[5][1], clustered(1, 16, 1, 9)[0].tolist(), [0.0] * 16):
        want = search.top(search.vector_search(df, q, "id", "embedding"), "id", 10).collect()
        assert top(stored.search(q, 10, exact=True), 10) == [r.id for r in want]
        assert top(cells.scan(df, q, "id", "embedding", 10), 10) == [r.id for r in want]
        got = {r.id: r.score for r in stored.search(q, 10, exact=True).collect()}
        assert all(got[r.id] == pytest.approx(r.score, abs=1.1e-6) for r in want)


def test_recall_and_files_read(spark, rows, stored, scanned):
    """Eight of some forty cells give nine of ten true neighbours, from a part of the files."""
    files = len(stored.spark.read.parquet(f"{stored.at}/vectors").inputFiles())
    x = np.array([r[1] for r in rows[:3000]])
    units = x / np.sqrt((x * x).sum(axis=1))[:, None]
    hits, read = 0, []
    for i in range(0, 3000, 300):
        found = stored.search(rows[i][1], 10)
        read.append(scanned(found, "numFiles")[0])
        true = {rows[j][0] for j in np.argsort(-(units @ units[i]), kind="stable")[:10]}
        hits += len(true & set(top(found, 10)))
    assert hits / 100 >= 0.9 and max(read) <= 0.4 * files


def test_every_vector_is_stored_once(spark, rows, stored):
    kept = spark.read.parquet(f"{stored.at}/vectors")
    assert kept.count() == 3001 and kept.select("key").distinct().count() == 3001
    assert kept.where(F.col("cell") == cells.FLAT).select("key").collect()[0][0] == "zero"


def test_lloyd_steps_lower_the_spread(spark, rows):
    df = spark.createDataFrame(rows[:3000], "key string, vector array<double>")
    x = np.array([r[1] for r in rows[:3000]])
    units = x / np.sqrt((x * x).sum(axis=1))[:, None]
    spread = lambda c: ((units - c[cells._nearest(units, c)]) ** 2).sum()
    assert spread(cells.fit(df, 16, 20, steps=4)) < 0.8 * spread(cells.fit(df, 16, 20, steps=0))


def test_engine_reads_cells(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/idx", IndexSpec(dim=4))
    data = [(f"m{i}", "doc", f"d{i}", "text", x.tolist()) for i, x in enumerate(clustered(60, 4, 3))]
    engine.create(spark.createDataFrame(data, "id string, doc_type string, doc_id string, content string, embedding array<float>"))
    asks = [data[3][4], data[17][4]]
    plain = [[(r.id, r.score) for r in engine.vector(q, k=5).collect()] for q in asks]
    engine.index()
    assert "vectors" in str(engine._near(engine.records(), asks[0], None, 5, 8, False).inputFiles())
    assert [[(r.id, r.score) for r in engine.vector(q, k=5, exact=True).collect()] for q in asks] == plain
    assert [r.id for r in engine.vector(asks[0], k=2, filter="doc_id = d3").collect()] == ["m3"]


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id string, embedding array<float>")
    made = cells.Cells(spark, f"file://{tmp_path}/v", "id").build(none, "embedding", 3)
    assert made.ready() and made.search([1.0, 0.0, 0.0], 5).count() == 0
