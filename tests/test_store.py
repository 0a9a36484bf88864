import pytest
from pyspark.sql import functions as F

from sedge import storage
from sedge.errors import Conflict, NotFound
from sedge.operators import payload, store, usage


def test_upsert(spark):
    old = spark.createDataFrame([("a", "d1", 1), ("b", "d1", 2), ("c", "d2", 3)], "id string, doc_id string, v int")
    new = spark.createDataFrame([("a", "d1", 9, 1), ("a", "d1", 10, 2), ("z", "d3", 4, 1)], "id string, doc_id string, v int, seq int")
    got = {r.id: r.v for r in store.upsert(old, new, "id", order="seq").collect()}
    assert got == {"a": 10, "b": 2, "c": 3, "z": 4}
    whole = {r.id for r in store.upsert(old, new, "id", order="seq", replace_by="doc_id").collect()}
    assert whole == {"a", "c", "z"}
    assert store.upsert(old, new.limit(0).drop("seq")).count() == 3


def test_put_is_idempotent(spark):
    files = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "")], "path string, content string")
    none = spark.createDataFrame([], "silo string, cid string")
    first = {r.path: r for r in store.put_blobs(none, files, "s").collect()}
    assert [first[p].existed for p in "123"] == [False, True, False] and first["3"].size_bytes == 0
    again = store.put_blobs(spark.createDataFrame(list(first.values())), files, "s").collect()
    assert all(r.existed for r in again)


def test_delete_plan(spark):
    cid = "ab" * 16
    rows = spark.createDataFrame([("d-doc", "doc", "d", [cid, "nope"]), ("d-chunk-1", "chunk", "d", []), ("e", "doc", cid, [])], "id string, doc_type string, doc_id string, blob_cids array<string>")
    got = {r.doc_id: r for r in store.delete_plan(rows, "doc_id").collect()}
    assert (got["d"].records, got["d"].chunks, got["d"].cids) == (2, 1, [cid])
    assert got[cid].cids == [cid]  # falls back to the id
    left = store.delete(rows, "doc_id", spark.createDataFrame([("d",)], "doc_id string")).collect()
    assert [r.id for r in left] == ["e"]


def test_collect_cids(spark):
    a, b, c = "a1" * 16, "b2" * 16, "c3" * 32
    record = f'{{"blob_cids":["{a}","short"],"ingest":{{"blob_cids":["{b}"]}},"structured":{{"assets":{{"primary_blob":"{c}","note":"{"d4" * 16}"}},"list":["{a}"]}}}}'
    got = spark.createDataFrame([(record,)], "r string").select(store.collect_cids(F.col("r")).alias("c")).first()["c"]
    assert sorted(got) == sorted([a, b, c])


def test_get_missing(spark):
    with pytest.raises(NotFound):
        store.get(spark.range(3), "id", 7)


def test_retention(spark):
    days = spark.sql("select sequence(timestamp_ntz'2024-01-01 06:00:00', timestamp_ntz'2024-12-31 06:00:00', interval 12 hours) s").select(F.explode("s").alias("ts")).withColumn("id", F.monotonically_increasing_id())
    kept = [str(r.ts)[:10] for r in store.retention(days, "ts", "id").orderBy("ts").collect()]
    assert kept[-7:] == [f"2024-12-{d}" for d in range(25, 32)]
    assert {"2024-07-31", "2024-11-30", "2024-12-22", "2024-12-15"} <= set(kept) and len(kept) == 7 + 2 + 5


def test_replace_and_back_up(spark, tmp_path):
    path, root = f"file://{tmp_path}/t", f"file://{tmp_path}/backups"
    storage.replace_table(spark.range(5), path)
    assert store.back_up(spark, {"t": path}, root, "t-20240101T000000") == 1
    with pytest.raises(FileExistsError):
        store.back_up(spark, {"t": path}, root, "t-20240101T000000")
    old = storage.read_table(spark, path)
    version = storage.current(spark, path)
    storage.replace_table(old.where("id > 2"), path, expected=version)
    assert storage.read_table(spark, path).count() == 2 and old.count() == 5  # readers keep their version
    assert storage.read_table(spark, path, number=0).count() == 5
    with pytest.raises(Conflict):
        storage.replace_table(spark.range(1), path, expected=version)
    assert storage.read_table(spark, path).count() == 2
    assert store.backed_up(spark, root, "t-20240101T000000", "t").count() == 5
    with pytest.raises(NotFound):
        store.manifest(spark, root, "none")


DECISION = {
    "panel": "array(named_struct('name', 'N', 'role', 'chair'))",
    "decision": "named_struct('date', '2025-08-31', 'result', 'upheld')",
    "parties": "named_struct('contracting_authority', 'a', 'appellant', 'b', 'awardee', cast(null as string), 'interested_bidders', array('x'))",
    "procurement": "named_struct('subject', 's', 'procedure_type', 'open', 'tender_id', cast(null as string), 'cpv_codes', array('72222300', '39120000-3'))",
    "costs": "array(named_struct('amount', 3600.0D, 'currency', 'PLN'))",
    "statutes_cited": "array(named_struct('article', '1'))",
    "issues": "array(named_struct('issue_key', 'low_price', 'confidence', 90))",
    "identifiers": "named_struct('kio_docket', array('KIO 1'), 'saos_id', cast(null as string))",
    "chunks": "array(named_struct('position', 1, 'section', cast(null as string), 'body', 'b'), named_struct('position', 2, 'section', 's', 'body', 'c'))",
    "summary_short": "'s'",
}


def decision(spark, **other):
    return spark.range(1).select(F.lit("d1").alias("doc_id"), *[F.expr(v).alias(k) for k, v in (DECISION | other).items()])


def test_valid_decision(spark):
    assert decision(spark).select(payload.violations().alias("v")).first()["v"] == []


def test_violations_are_all_reported(spark):
    bad = decision(
        spark,
        panel="cast(null as array<struct<name: string, role: string>>)",
        decision="named_struct('date', '2025-8-31', 'result', 'unknown')",
        parties="named_struct('contracting_authority', ' ', 'appellant', 'b')",
        procurement="named_struct('cpv_codes', array('72222300', '7222'))",
        costs="array(named_struct('amount', -1.0D, 'currency', 'pln'))",
        statutes_cited="array(named_struct('article', ''))",
        issues="array(named_struct('issue_key', 'x', 'confidence', 101))",
        chunks="array(named_struct('position', 1, 'section', ' ', 'body', ''), named_struct('position', 3, 'section', 's', 'body', 'c'))",
        summary_short="''",
    )
    got = " | ".join(bad.select(payload.violations().alias("v")).first()["v"])
    for part in ("panel", "decision.date", "decision.result", "contracting_authority", "cpv_codes[1]", "costs[0].amount", "costs[0].currency", "statutes_cited[0]", "issues[0]", "chunks[0].section", "chunks[0].body", "chunks[1].position must be 2", "summary_short"):
        assert part in got, part


def test_records(spark):
    docs = payload.doc_records(decision(spark), "main").first()
    assert docs.id == "main-d1-doc" and docs.panel_names == ["N"] and docs.procurement_cpv_codes == ["72222300", "39120000-3"]
    chunks = payload.chunk_records(decision(spark), "main").orderBy("ord").collect()
    assert [c.id for c in chunks] == ["main-d1-chunk-1", "main-d1-chunk-2"] and chunks[1].decision.result == "upheld"


def test_vectors_and_zero_rule(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("nan")])], "id int, v array<float>")
    assert {r.id: r.problem for r in payload.check_vectors(df, "v", 2).collect()} == {1: None, 2: "dimension", 3: "missing", 4: "not finite"}
    z = spark.createDataFrame([(" ",), ("x",)], "t string").select(payload.zero_vector(F.col("t"), F.array(F.lit(1.0).cast("float")), 2).alias("z")).collect()
    assert [r.z for r in z] == [[0.0, 0.0], [1.0]]


def test_coverage_boundaries(spark):
    docs = spark.createDataFrame([(1, "a " * 20), (2, "a " * 20), (3, ""), (4, "a b")], "doc_id int, text string")
    chunks = spark.createDataFrame([(1, "a " * 17), (2, "a " * 16), (3, "x")], "doc_id int, body string")
    got = {r.doc_id: r.covered for r in payload.coverage(docs, chunks, "doc_id", "text", "body").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_sequence(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 3, 1)], "d int, p int, o int")
    assert {r.d: r.broken for r in payload.chunk_sequence(rows, "d", "p", "o").collect()} == {1: 0, 2: 1}


def test_usage(spark):
    df = spark.sql("select map('text', 40L, 'image', 2L) input, map('text', 21L) output, 4L thoughts, 50L cache_creation")
    r = usage.totals(df).first()
    assert (r.input_total, r.output_total, r.total, r.effective_input) == (42, 21, 67, 0)
    empty = usage.totals(spark.sql("select cast(null as map<string,bigint>) input, map() output, cast(null as long) thoughts, cast(null as long) cache_creation").withColumn("output", F.col("output").cast("map<string,bigint>"))).first()
    assert empty.total == 0
    merged = spark.sql("select map('a', 1L) x, map('a', 2L, 'b', 3L) y").select(usage.merge_maps(F.col("x"), F.col("y")).alias("m")).first()["m"]
    assert merged == {"a": 3, "b": 3}
