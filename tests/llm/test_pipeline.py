"""The pipeline against brute force, and the SQL of this subpackage against DuckDB."""

from collections import Counter

import duckdb
import numpy as np
import zlib

import corpus_pipeline
from sedge import storage
from sedge.llm import mixing, oracles, packing, quality, queries
from test_small import brute_components, brute_dedup


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert len(names) == 5
    good = stages[names[0]](spark, docs, sf_dir)
    assert good.columns == docs.columns and set(good.collect()) == set(docs.join(quality.classify(docs).where("kept").select("doc_id"), "doc_id", "left_semi").collect())
    rows = sorted(good.collect())
    deduped = sorted(stages[names[1]](spark, good, sf_dir).collect())
    keep = brute_dedup([r.text for r in rows])
    assert deduped == [r for i, r in enumerate(rows) if keep[i][0] == i]
    near = sorted(stages[names[2]](spark, spark.createDataFrame(deduped, docs.schema), sf_dir).collect())
    comp = brute_components([r.text for r in deduped], 5, 80, 100)
    assert near == [r for i, r in enumerate(deduped) if comp[i][1] == i]
    mixed = stages[names[3]](spark, spark.createDataFrame(near, docs.schema), sf_dir)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near}
    # Mixing: each document as often as its plan says, so each source's words come near its target.
    plan = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(near, docs.schema)).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(abs(copies[i] - r.taken / r.size) < 1 for i, r in plan.items() if r.size)
    # Packing: all tokens of every copy, each in one piece.
    ids = packing.encode([r.text for r in near], packing.default_vocabulary())
    tokens = {r.doc_id: len(x) // 2 + 1 for r, x in zip(near, ids, strict=True)}
    packed, filled = Counter(), Counter()
    for p in stages[names[4]](spark, mixed, sf_dir).collect():
        packed[p.doc_id] += p.length
        filled[p.sequence_id] += p.length
    assert packed == {i: n * tokens[i] for i, n in copies.items()}
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())


CLASHES = "norm head code range shard row n key curve pattern set_id near_key mix_key keep_key keep_sha piece"


def test_stages_on_awkward_tables(spark, sf_dir):
    """Empty tables, nulls in any column, repeated ids and rows, ties, empty and very long texts, and columns
    named like helpers."""
    names = CLASHES.split()
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    plain = "Plain words of an ordinary sentence stand here, number {} of them. "
    rows = [(1, plain.format(1)), (1, plain.format(1)), (1, plain.format(2) * 3), (None, plain.format(3)), (None, None), (2, None), (3, ""), (3, plain.format(4)), (None, plain.format(5) * 4000)]
    rows = [(i, t, "en", None if n % 3 else "s", None, *("x" for _ in names)) for n, (i, t) in enumerate(rows)]
    for df in (spark.createDataFrame(rows, ddl), spark.createDataFrame([], ddl)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.schema.names == df.schema.names
            kept = [tuple(r) for r in out.collect()]
            assert set(kept) <= {tuple(r) for r in df.collect()}
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect()} == {r.doc_id for r in df.collect()}
    # No stage loses the only copy of a text: of the rows with words, each text stays through both dedups.
    df = spark.createDataFrame(rows, ddl)
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        assert {r.text for r in stage(spark, df, sf_dir).collect() if r.text} == {r[1] for r in rows if r[1]}


def test_stages_leave_small_tables(spark, sf_dir, tmp_path, monkeypatch):
    """What the Jaccard join stages goes, and so does what a stage of the pipeline stages, once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, run, left in (
        ("near", lambda: corpus_pipeline.near_stage(spark, docs, sf_dir), {"gone", "keyed", "near-rows"}),
        ("all", lambda: corpus_pipeline.run(spark, sf_dir), {"mixing-sources-to-target-weights", "pack-tokens"}),
    ):
        monkeypatch.setattr(storage, "shared_dir", lambda spark, name=name: f"file://{tmp_path}/{name}")
        out = run()
        assert {p.name.removeprefix("sedge-").rsplit("-", 1)[0] for p in (tmp_path / name).iterdir()} == left
        assert 0 < out.count() == out.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for p in out[:50]:
        ids = np.append(np.frombuffer(packing.encode([texts[p.doc_id]], packing.default_vocabulary())[0], "<u2"), 2).astype("<u4")
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in oracles.ORACLES.items():
        df = queries.QUERIES[name](spark, sf_dir)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        want = sorted(tuple(str(r[columns.index(c)]) for c in order) for r in result.fetchall())
        assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == want
