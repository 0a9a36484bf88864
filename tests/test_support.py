import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sedge import config, retry, sinks
from sedge.errors import InvalidParameter
from sedge.functions import glyphs
from sedge.operators import payload, usage
from sedge.schema import DECISION_DDL, decision_schema, job_schema
from sedge.sources import portal
from sedge.streaming import batches, progress


def test_config_layers(tmp_path):
    a, b = tmp_path / "a.toml", tmp_path / "b.toml"
    a.write_text('silo = "x"\n[search]\nlimit = 5\n')
    b.write_text("[search]\nk = 7\n")
    got = config.load(files=[a, tmp_path / "missing.toml"], override=b, env={"SEDGE__SEARCH__LIMIT": "9", "SEDGE__STORAGE__ROOT": "r", "OTHER": "1"})
    assert (got["silo"], got["search"]["limit"], got["search"]["k"], got["search"]["fusion"], got["storage"]["root"]) == ("x", 9, 7, "rrf", "r")
    with pytest.raises(FileNotFoundError):
        config.load(files=[], override=tmp_path / "missing.toml", env={})
    assert config.DEFAULTS["search"]["limit"] == 20


def test_retry():
    calls, slept = [], []

    def f():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert retry.call(f, retry.EMBED, sleep=slept.append) == "ok" and len(slept) == 2
    with pytest.raises(ValueError):
        retry.call(lambda: (_ for _ in ()).throw(ValueError), retry.EMBED, sleep=slept.append)
    delays = list(retry.SCRAPE.delays(random.Random(1)))
    assert len(delays) == 5 and max(delays) <= 5 and delays[0] == pytest.approx(0.25, rel=0.11)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ab1", b"x", None), ("cd2", b"y", "{}")], "doc_id string, content binary, details string")
    assert [r.value for r in sinks.json_lines(df.drop("content")).collect()] == ['{"doc_id":"ab1"}', '{"doc_id":"cd2","details":"{}"}']
    path = str(tmp_path / "p")
    sinks.stage_payloads(df, path)
    one = sinks.load_payload(spark, path, "cd2")
    assert one.first().details == "{}" and "PartitionFilters: [isnotnull(prefix" in one._jdf.queryExecution().executedPlan().toString()
    assert sinks.without_payloads(df, one).count() == 1
    docs, chunks = spark.createDataFrame([(1, "a b 3")], "d int, t string"), spark.createDataFrame([(1, "a b", 1)], "d int, b string, o int")
    audited = usage.audit(docs, chunks, "d", "t", "b", "o")
    sinks.write_audit(audited, str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "tsv")).first().value.endswith("\t33.3\tfail")
    sinks.write_json(df.drop("content"), str(tmp_path / "json"))


class Fake:
    def __init__(self):
        self.keys, self.now = [], "Running"

    def submit(self, name, keys):
        self.keys = list(keys)
        return f"batch {name}"

    def state(self, job):
        return self.now

    def fetch(self, job):
        return [batches.Answer(k, '{"summary_short":"s"}' if i else None, None if i else "blocked") for i, k in enumerate(self.keys)]


def test_batches(spark):
    rows = [{"job_id": f"j{i}", "status": "Pending", "generation_mode": "Batch" if i < 3 else "Sync"} for i in range(5)]
    jobs = spark.createDataFrame([tuple(r.get(f.name) for f in job_schema()) for r in rows], job_schema())
    provider = Fake()
    sent = batches.submit(jobs, provider, 1000, limit=2)
    assert sent.dtypes == jobs.dtypes and [(r.job_id, r.status, r.submitted_batch_count) for r in sent.orderBy("job_id").collect()] == [("j0", "Generating", 2), ("j1", "Generating", 2)]
    assert batches.fetch(sent, provider, 2000).count() == 0
    provider.now = "Succeeded"
    got = batches.parse_replies(batches.fetch(sent, provider, 2000), DECISION_DDL).orderBy("job_id").collect()
    assert [(r.status, r.error) for r in got] == [("Failed", "blocked"), ("Generated", None)] and got[1].decision.summary_short == "s"
    provider.now = "Failed"
    assert {r.error for r in batches.fetch(sent, provider, 2000).collect()} == {"provider job failed"}
    assert batches.submit(jobs.where("status = 'Failed'"), provider, 0).count() == 0
    with pytest.raises(InvalidParameter):
        batches.submit(jobs, provider, 0, limit=33)


def test_payload_prefix_is_text(spark, tmp_path):
    df = spark.createDataFrame([("07ab", "x"), ("0712", "y"), ("1200", "z")], "doc_id string, details string")
    sinks.stage_payloads(df, str(tmp_path / "p"))
    assert [sinks.load_payload(spark, str(tmp_path / "p"), d).first().details for d in ("07ab", "0712", "1200")] == ["x", "y", "z"]


def test_batch_inputs(spark):
    ddl = "doc_id string, display_name string, mime_type string, content binary, text string"
    good = spark.createDataFrame([("d", "n", "application/pdf", b"\x00\xff", "t")], ddl)
    batches.check_inputs(good)
    body = json.loads(batches.request(good, "rules").first().body)
    assert body["user"]["file"] == {"kind": "file", "name": "n", "mime_type": "application/pdf", "data": "AP8="}
    assert body["generation"] == {"response_mime_type": "application/json", "candidate_count": 1, "temperature": 0.0} and body["system"] == "rules"
    for bad in (good.limit(0), good.withColumn("text", F.lit(" ")), good.withColumn("content", F.lit(b"")), spark.range(33).crossJoin(good).drop("id")):
        with pytest.raises(InvalidParameter):
            batches.check_inputs(bad)


def test_finalize(spark):
    schema = decision_schema()
    chunks = [{"position": i, "section": "facts", "body": f"body {i}"} for i in (1, 2)]
    good = {"decision": {"date": "2024-01-31", "result": "upheld"}, "panel": [{"name": "N", "role": "chair"}], "parties": {"contracting_authority": "A", "appellant": "B"}, "summary_short": "s", "chunks": chunks}
    bad = good | {"chunks": []}
    replies = {"j1": json.dumps(good), "j2": json.dumps(bad), "j3": "no json", "j4": json.dumps(good)}
    rows = [{"job_id": k, "doc_id": f"d{k}", "status": "Generated", "content_hash": "other" if k == "j4" else None, "reply": v} for k, v in replies.items()]
    ddl = StructType([*job_schema().fields, StructField("reply", StringType())])
    fetched = spark.createDataFrame([tuple(r.get(f.name) for f in ddl) for r in rows], ddl)
    parsed = fetched.withColumn("decision", payload.parse_reply(F.lit(None).cast("string"), F.array("reply"), schema)["decision"])
    old = spark.createDataFrame([("main-dj1-chunk-9", "chunk", "dj1", "gone", None), ("main-dj2-doc", "doc", "dj2", "stays", None)], "id string, doc_type string, doc_id string, content string, embedding array<float>")
    jobs, records = batches.finalize(parsed, old, schema, "main", 2, lambda texts: [[1.0, float(len(t))] for t in texts], 5)
    state = {r.job_id: (r.status, r.error) for r in jobs.collect()}
    assert state["j1"] == ("Generated", None) and state["j2"][1].startswith("chunks needs") and state["j3"] == ("Failed", "the reply is no such JSON") and "mismatch" in state["j4"][1]
    one = jobs.where("job_id = 'j1'").first()
    assert one.chunk_count == 2 and len(one.content_hash) == 64
    got = {r.id: r for r in records.collect()}
    assert set(got) == {"main-dj1-doc", "main-dj1-chunk-1", "main-dj1-chunk-2", "main-dj2-doc"} and got["main-dj1-chunk-2"].embedding == [1.0, 6.0]


def test_embedding_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else " " if i == 5 else f"t{i}") for i in range(100)], "i int, t string").coalesce(1)
    got = payload.embed_texts(df, "t", lambda texts: [[float(len(texts)), float(x[1:])] for x in texts], 2).collect()
    assert all(r.embedding == ([0.0, 0.0] if r.i in (3, 5) else [r.embedding[0], float(r.i)]) and r.embedding[0] <= 32 for r in got)
    with pytest.raises(Exception, match="vectors"):
        payload.embed_texts(df, "t", lambda texts: [[1.0]] * len(texts), 2).collect()


def test_ocr_budget():
    payload.check_ocr_budget(64, 1024, 2, 8, 16)
    for bad in ((65, 1, 1, 1, 1), (1, 1025, 1, 1, 1), (1, 1, 0, 1, 1), (1, 1, 2, 9, 16)):
        with pytest.raises(InvalidParameter):
            payload.check_ocr_budget(*bad)


def test_glyphs():
    def line(text, x, y, h=10.0, step=5.0):
        return [{"ch": c, "left": x + i * step, "right": x + i * step + 4, "top": y + h, "bottom": y, "baseline": y} for i, c in enumerate(text)]

    page = line("ab", 0, 0) + line("cd", 40, 0) + line("next", 0, -12) + line("par", 0, -40) + [{"ch": "\n", "left": 0, "right": 0, "top": 0, "bottom": 0, "baseline": 0}, {"ch": "\r", "left": 0, "right": 0, "top": 0, "bottom": 0, "baseline": 0}] + line("x", 0, -90)
    assert glyphs.render(page) == "ab cd\nnext\n\npar\nx" and glyphs.render([]) == glyphs.render(None) == ""
    assert glyphs.upper_median([3.0, 1.0, float("nan"), 2.0, 4.0]) == 3.0


def test_sentence_records(spark):
    df = spark.createDataFrame([("a", "First one. Second one."), ("b", None)], "d string, t string")
    got = payload.sentence_records(df, "main", "d", "t").orderBy("ord").collect()
    assert [(r.id, r.content, r.embedding) for r in got] == [("main-a-chunk-1", "First one.", None), ("main-a-chunk-2", "Second one.", None)]


def test_sources_by_page(spark):
    asked = []

    def fetch(page):
        asked.append(page)
        return '<input id="resultCounts" value="10,23"><div class="search-list-item"></div>'

    assert [p.value[:2] for p in portal._PortalReader(fetch, None, None).partitions()] == [(1, 1), (2, 2), (3, 3)] and asked == [1]
    assert [p.value[0] for p in portal._PortalReader(fetch, 2, None).partitions()] == [1, 2] and portal.page_counts("") == (0, None)

    class Fetch:
        @staticmethod
        def page(page, until):
            rows = [(f"{page}-{i}", f"20{18 + i}-06-01", until) for i in range(3)]
            return [r for r in rows if r[1] <= until]

    spark.dataSource.register(portal.JudgmentSource.use(Fetch.page))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("judgments").option("pages", 2).load()
        assert df.count() == 6 and df.where("judgment_date <= '2019-12-31'").count() == 4
        assert {r.body for r in df.where("judgment_date <= '2019-12-31'").collect()} == {"2019-12-31"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_progress(spark, tmp_path):
    spark.range(6).withColumn("existed", F.col("id") < 2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, existed boolean").parquet(str(tmp_path / "in"))
    seen = progress.Progress()
    spark.streams.addListener(seen)
    progress.observed(stream, "existed").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for _ in range(100):
        if seen.finished:
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(seen)
    assert seen.totals == {"discovered": 6, "skipped": 2}
