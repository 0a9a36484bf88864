import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sedge import storage
from sedge.engine import Engine
from sedge.errors import Conflict, Duplicate, InvalidParameter, NotFound
from sedge.schema import IndexSpec, decision_schema, job_schema, prompt_schema


@pytest.fixture
def engine(spark, tmp_path):
    now = [100.0]
    e = Engine(spark, f"file://{tmp_path}/idx", IndexSpec(dim=2), embed=lambda q: [1.0, float(len(q))], clock=lambda: now[0])
    rows = [("m-a-doc", "doc", "a", "public procurement law", [1.0, 0.0], []), ("m-b-doc", "doc", "b", "public works", [0.0, 1.0], []), ("m-b-chunk-1", "chunk", "b", "works", None, [])]
    e.create(spark.createDataFrame(rows, "id string, doc_type string, doc_id string, content string, embedding array<float>, blob_cids array<string>"))
    e.now = now
    return e


def test_search(engine):
    assert [r.id for r in engine.keyword("public works", fields=["doc_id"]).collect()][0] == "m-b-doc"
    assert [r.id for r in engine.vector([1.0, 0.0], k=1).collect()] == ["m-a-doc"]
    assert engine.keyword("public", filter='doc_type = "doc" AND doc_id = a').count() == 1
    got = engine.hybrid("public", vector=[1.0, 0.0]).collect()
    assert {r.doc_id for r in got} == {"a", "b"} and got[0].doc_id == "b"  # equal sums: better keyword rank
    assert engine.hybrid("public", vector=[1.0, 0.0], fusion="weighted").count() == 2
    assert engine.vector("").count() == 2  # a blank query is the zero vector
    for call in (lambda: engine.keyword("x", limit=0), lambda: engine.keyword("x", limit=101), lambda: engine.vector([1.0]), lambda: engine.hybrid("x", fusion="no"), lambda: engine.typeahead("x"), lambda: engine.keyword("x", filter="content = 1")):
        with pytest.raises(InvalidParameter):
            call()


def test_typeahead_cache(engine):
    assert engine.typeahead("publ")[1] is False
    rows, hit = engine.typeahead(" PUBL ".strip().lower())
    assert hit and {r.doc_id for r in rows} == {"a", "b"}
    engine.now[0] += 3
    assert engine.typeahead("publ")[1] is False


def test_records(engine, spark):
    assert engine.get("m-a-doc").count() == 1
    with pytest.raises(NotFound):
        engine.get("nope")
    with pytest.raises(Duplicate):
        engine.create(engine.records())
    assert engine.find(filter="doc_id = b", sort=["doc_id:asc"]).count() == 2
    stats = engine.stats().first()
    assert (stats.vectors, stats.docs_with_vectors, stats.searchable) == (2, 2, ["content", "doc_id"])
    assert stats.size_bytes > 0 and stats.embedder == "gemini-embedding-001 (kind: userProvided, dims: 2, float32)"
    assert {r.kind: r.records for r in engine.breakdown().collect()} == {"doc": 2, "chunk": 1}
    new = engine.records().where("id = 'm-a-doc'").withColumn("content", F.lit("changed"))
    engine.upsert(new)
    assert engine.get("m-a-doc").first().content == "changed" and engine.records().count() == 3
    assert engine.delete("b", dry_run=True).first().records == 2 and engine.records().count() == 3
    target = engine.root + "-backups"
    backup = engine.backup(target)
    engine.delete("b")
    assert engine.records().count() == 1 and engine.delete("zzz") is None
    engine.recover(target, backup, force=True)
    assert engine.records().count() == 3
    token = engine.confirmation_token()
    with pytest.raises(InvalidParameter):
        engine.purge("wrong", token)
    engine.purge(token, token)
    with pytest.raises(NotFound):
        engine.records()


def test_jobs(engine, spark):
    one = spark.createDataFrame([("j", "Pending", 0, 0, False, 0, 3, None, None)], "job_id string, status string, created_at_ms long, updated_at_ms long, stale boolean, retry_count int, max_retries int, last_error string, next_retry_at_ms long")
    engine.enqueue(one)
    with pytest.raises(Duplicate):
        engine.enqueue(one)
    assert engine.reap(10**12, dry_run=True).first().outcome == "requeued"
    engine.reap(10**12)
    assert engine._table("jobs").first().retry_count == 1


def test_schemas():
    assert len(decision_schema()) == 10 and "next_retry_at_ms" in job_schema().names
    assert prompt_schema()["properties"]["decision"]["properties"]["result"]["enum"][1] == "upheld"
    assert IndexSpec.from_json(IndexSpec(dim=3).to_json()) == IndexSpec(dim=3)


def test_stored_postings(engine):
    """Scores from postings equal those of a scan, with and without a filter, and lapse with the next change."""
    scan = [(r.id, r.score) for r in engine.keyword("public works").collect()]
    some = [(r.id, r.score) for r in engine.keyword("public", filter="doc_id = b").collect()]
    ahead = [tuple(r) for r in engine.typeahead("public wo")[0]]
    engine.index()
    engine.now[0] += 3
    stored = engine.keyword("public works")
    assert [(r.id, r.score) for r in stored.collect()] == scan and "postings" in str(engine._scores(engine.records(), "public", None).inputFiles())
    assert [(r.id, r.score) for r in engine.keyword("public", filter="doc_id = b").collect()] == some
    assert [tuple(r) for r in engine.typeahead("public wo")[0]] == ahead
    engine.upsert(engine.records().where("id = 'm-b-doc'").withColumn("content", F.lit("other")))
    assert [r.id for r in engine.keyword("works").collect()] == ["m-b-chunk-1"]


def test_single_flight(engine, monkeypatch):
    """Equal requests at one time run once; a failure reaches all of them and is not kept."""
    runs, gate = [], threading.Event()

    def slow(q, filter, limit):
        runs.append(q)
        gate.wait(10)
        if len(runs) == 1:
            raise OSError("down")
        return ["row"]

    monkeypatch.setattr(engine, "_suggest", slow)
    with ThreadPoolExecutor(5) as pool:
        asked = [pool.submit(engine.typeahead, "publ") for _ in range(5)]
        while not engine._flights:
            time.sleep(0.01)
        time.sleep(0.2)
        gate.set()
        assert all(isinstance(a.exception(), OSError) for a in asked) and len(runs) == 1
        assert sorted(a.result()[1] for a in [pool.submit(engine.typeahead, "publ") for _ in range(5)]) == [False, True, True, True, True]
    assert len(runs) == 2


def test_delete_with_blobs(engine, spark):
    a, b = "a1" * 32, "b2" * 32
    cids = F.when(F.col("doc_id") == "a", F.array(F.lit(a))).when(F.col("doc_type") == "doc", F.array(F.lit(a), F.lit(b))).otherwise(F.col("blob_cids"))
    engine.upsert(engine.records().withColumn("blob_cids", cids))
    storage.replace_table(spark.createDataFrame([("s", a, 1), ("s", b, 2)], "silo string, cid string, size_bytes int"), engine.path("blobs"))
    target = engine.root + "-kept"
    backup = engine.backup(target)
    assert engine.verify(target, backup) == {"records": (0, 0), "blobs": (0, 0)}
    assert engine.delete("b", blobs=True).first().cids == [a, b]
    assert [r.cid for r in engine._table("blobs").collect()] == [a]  # the other document still needs it
    assert engine.verify(target, backup) == {"records": (0, 2), "blobs": (0, 1)}
    plan = engine.recover(target, backup, dry_run=True).collect()
    assert {r.action: r.records for r in plan} == {"add": 2, "keep": 1} and plan[0].bytes == engine.backups(target).first().bytes > 0
    assert [r.name for r in engine.backups(target).collect()] == [backup]
    engine.recover(target, backup, force=True)
    assert engine.records().count() == 3 and engine._table("blobs").count() == 2


def test_two_writers(engine):
    version = engine._version("records")
    engine.upsert(engine.records().where("id = 'm-a-doc'").withColumn("content", F.lit("first")))
    with pytest.raises(Conflict):
        engine._replace("records", engine.records(), version)
    assert engine.get("m-a-doc").first().content == "first"


def test_blobs_of_other_silos_stay(engine, spark):
    a, b = "a1" * 32, "b2" * 32
    engine.upsert(engine.records().where("doc_type = 'doc'").withColumn("blob_cids", F.array(F.when(F.col("doc_id") == "a", F.lit(a)).otherwise(F.lit(b)))))
    storage.replace_table(spark.createDataFrame([("s", b, 1), ("t", b, 2), ("s", a, 3)], "silo string, cid string, size_bytes int"), engine.path("blobs"))
    with pytest.raises(InvalidParameter):
        engine.delete("b", blobs=True)  # whose blob is meant?
    engine.silo = "s"
    engine.delete("b", blobs=True)
    assert {(r.silo, r.cid) for r in engine._table("blobs").collect()} == {("t", b), ("s", a)}


def test_a_change_rewrites_its_buckets(engine, spark):
    """One row in: one bucket's directory is new, all others are the files that they were; the same for a deletion."""
    many = spark.range(500).selectExpr("concat('r', id) id", "'doc' doc_type", "concat('d', id div 2) doc_id", "'text' content", "cast(null as array<float>) embedding", "cast(array() as array<string>) blob_cids")
    engine.create(many, force=True)
    before = set(storage.directories(spark, engine.path("records")))
    assert len(before) == 64
    one = many.where("id = 'r7'").withColumn("content", F.lit("first")).unionByName(many.where("id = 'r7'").withColumn("content", F.lit("last")))
    engine.upsert(one.coalesce(1))
    after = set(storage.directories(spark, engine.path("records")))
    assert len(after - before) == 1 and len(after) == 64
    assert engine.records().count() == 500 and engine.get("r7").first().content == "last"  # of a repeated key the later row
    engine.delete("d9")
    gone = set(storage.directories(spark, engine.path("records")))
    assert 1 <= len(gone - after) <= 2 and engine.records().count() == 498
    engine.upsert(many.limit(0))
    assert set(storage.directories(spark, engine.path("records"))) == gone
    engine.upsert(many.where("id = 'r0'"), replace_by="doc_id")  # takes r1, in another bucket, away
    assert {r.id for r in engine.records().where("doc_id = 'd0'").collect()} == {"r0"}


def test_backups_share_their_data(engine, spark):
    target = engine.root + "-many"
    first = engine.backup(target)
    files = lambda: set(spark.read.parquet(f"{target}/units/*/*/*").inputFiles())
    held = files()
    engine.now[0] += 60
    second = engine.backup(target)
    assert files() == held and second != first  # nothing changed: a manifest alone
    engine.upsert(engine.records().where("id = 'm-a-doc'").withColumn("content", F.lit("changed")))
    engine.now[0] += 86_400
    third = engine.backup(target)
    assert len({f.rsplit("/", 1)[0] for f in files() - held}) == 1  # one bucket
    assert engine.verify(target, third) == {"records": (0, 0)} and engine.verify(target, first) == {"records": (1, 1)}
    assert engine.retain(target, daily=2, weekly=0, monthly=0) == 1
    assert [r.name for r in engine.backups(target).collect()] == [third, second] and files() >= held
    engine.retain(target, daily=1, weekly=0, monthly=0)
    engine.recover(target, third, force=True)
    assert engine.get("m-a-doc").first().content == "changed"
    fs, at = storage.file_system(spark, f"{target}/units")
    fs.delete(at, True)
    with pytest.raises(OSError):
        engine.verify(target, third)


def test_two_sessions_write(engine, spark):
    """Two sessions change one version: the second to commit gets Conflict, and its data are gone."""
    other = Engine(spark.newSession(), engine.root, engine.spec)
    rows = [e.records().where("id = 'm-a-doc'").withColumn("content", F.lit(text)) for e, text in ((engine, "one"), (other, "two"))]
    version = engine._version("records")
    change = lambda e, new: storage.change_buckets(e.spark, e.path("records"), new.select("id"), lambda part: part.where("id <> 'm-a-doc'").unionByName(new), version)
    change(engine, rows[0])
    with pytest.raises(Conflict):
        change(other, rows[1])
    assert other.get("m-a-doc").first().content == "one"
    assert storage.write_once(spark, f"{engine.root}/marker", "x") and not storage.write_once(other.spark, f"{engine.root}/marker", "y")
    state = storage.state(spark, engine.path("records"))
    lost = state._replace(number=state.number, parts={})
    with pytest.raises(Conflict):  # the same number again
        storage._commit(spark, engine.path("records"), state, lost, ["v-none"])
