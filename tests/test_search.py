import math

import pytest
from pyspark.sql import functions as F

from sedge.operators import search


def ranks(spark, rows):
    return spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(rows)], "doc_id string, score double, rank long")


def test_rrf_hand_case(spark):
    kw, vec = ranks(spark, [("a", 0.8), ("b", 0.7), ("c", 0.6)]), ranks(spark, [("b", 0.95), ("d", 0.5)])
    got = [(r.doc_id, r.score) for r in search.fuse_rrf(kw, vec, "doc_id", 4).collect()]
    assert [g[0] for g in got] == ["b", "a", "d", "c"]
    assert [g[1] for g in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62, 1 / 63], abs=1e-11)


def test_rank_is_consumed_by_rows_without_key(spark):
    kw = ranks(spark, [(None, 0.9), ("a", 0.8), ("a", 0.7)])
    got = search.fuse_rrf(kw, ranks(spark, []), "doc_id", 5).collect()
    assert len(got) == 1 and got[0].score == pytest.approx(1 / 62, abs=1e-11)


def test_weighted_hand_case(spark):
    kw = ranks(spark, [("a", 0.8), ("b", None)])
    vec = ranks(spark, [("c", -1.0), ("b", 0.5)]).where("doc_id <> 'x'")
    got = {r.doc_id: r.score for r in search.fuse_weighted(kw, vec, "doc_id", 5, (0.5, 0.5)).collect()}
    assert got == pytest.approx({"a": 0.4, "b": 0.5, "c": 0.5})


def test_bm25_against_formula(spark):
    docs = spark.createDataFrame([(1, "Cat cat dog"), (2, "dog"), (3, "bird, bird!"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, "CAT bird cat").collect()}
    n, avg = 4, (3 + 1 + 2 + 0) / 4
    idf = math.log(1 + (n - 1 + 0.5) / (1 + 0.5))
    want = {i: round(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * length / avg)), 6) for i, length in ((1, 3), (3, 2))}
    assert got == pytest.approx(want)
    stored = search.bm25_postings(search.postings(docs, "doc_id", "text"), search.corpus_stats(docs.na.fill(""), "text"), "CAT bird")
    assert {r.doc_id: r.score for r in stored.collect()} == pytest.approx(want)
    assert search.bm25(docs, " ,. ").count() == 0


def test_typeahead_prefix(spark):
    docs = spark.createDataFrame([(1, "public procurement"), (2, "public"), (3, "private")], "doc_id long, text string")
    assert {r.doc_id for r in search.bm25(docs, "proc", prefix_last=True).collect()} == {1}
    assert {r.doc_id for r in search.bm25(docs, "p", prefix_last=True).collect()} == {1, 2, 3}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id long, v array<float>")
    got = {r.id: r.score for r in search.vector_search(df, [3.0, 0.0], "id", "v").collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5}
    assert {r.score for r in search.vector_search(df, [0.0, 0.0], "id", "v").collect()} == {0.5}
    assert [r.id for r in search.top(search.vector_search(df, [3.0, 0.0], "id", "v"), "id", 2, 1).collect()] == [2, 3]


def test_branch_cap(spark):
    hits = spark.range(80).select(F.col("id"), (F.col("id") / 2).alias("score"))
    got = search.ranked(hits, [F.desc("score"), F.asc("id")]).collect()
    assert len(got) == 50 and {r["rank"] for r in got} == set(range(50))
