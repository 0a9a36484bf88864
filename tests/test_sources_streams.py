import pytest
from pyspark.sql import functions as F

from sedge.errors import InvalidParameter
from sedge.sources import files, portal
from sedge.streaming import ingest, states

PAGE = """<html><input id="resultCounts" value="1, 28860"><div class="search-list-item"><div><a class="link-details" href="/Home/Details/42/"></a></div>
<p><label>Sygnatura</label> Sygnatura: ABC 12/20</p><p><label>Rodzaj dokumentu</label>: wyrok </p></div></html>"""


def test_result_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, '<div class="search-list-item"></div>'), (3, None)], "page int, html string")
    got = {r.page: r for r in portal.result_items(df, "html").collect()}
    assert (got[1].doc_id, got[1].docket, got[1].decision_type, got[1].total_available) == ("42", "ABC 12/20", "wyrok", 28860)
    assert got[2].error and got[2].doc_id is None and got[3].error is None


def test_api(spark):
    body = '{"items":[{"id":7,"courtCases":[{"caseNumber":null},{"caseNumber":"X 1"}]},{"id":8,"courtCases":[]}],"info":{"totalResults":2}}'
    got = portal.api_tasks(spark.createDataFrame([(body,)], "b string"), "b").orderBy("doc_id").collect()
    assert [(r.doc_id, r.case_number, r.total) for r in got] == [("saos-7", "X 1", 2), ("saos-8", None, 2)]
    detail = portal.api_details(spark.createDataFrame([('{"data":{"judgmentDate":"2020-01-02","source":{}}}',)], "b string"), "b").first()
    assert detail.error == "no judgment id"


@pytest.mark.parametrize(("limit", "total", "want"), [(50, None, 50), (None, 28860, 28860), (100, 75, 75), (None, None, None)])
def test_discovery_target(spark, limit, total, want):
    assert spark.range(1).select(portal.discovery_target(F.lit(limit).cast("long"), F.lit(total).cast("long")).alias("t")).first()["t"] == want


def test_portal_source(spark):
    spark.dataSource.register(portal.PortalSource.use(lambda page: f"<p>{page}</p>"))
    df = spark.read.format("portal").option("pages", 3).load()
    assert df.rdd.getNumPartitions() == 3 and sorted((r.page, r.html) for r in df.collect()) == [(1, "<p>1</p>"), (2, "<p>2</p>"), (3, "<p>3</p>")]


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"1"), ("b.PNG", b"22"), ("c.txt", b"x"), ("d.bin", b"q"), ("d.json", b"{}")):
        (tmp_path / name).write_bytes(data)
    df = files.scan(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in df.collect()} == {"a.pdf": "application/pdf", "b.PNG": "image/png"}
    good, bad = files.size_guard(df, 1)
    assert good.count() == 1 and bad.first().reason == "too large"
    assert files.size_guard(df.withColumn("length", F.lit(0)))[1].first().reason == "empty"
    assert files.recent(df, 1).count() == 1
    assert [(r.stem, r.details) for r in files.pair_by_stem(spark, str(tmp_path)).collect()] == [("d", "{}")]
    got = files.count_pages(files.scan(spark, str(tmp_path)), lambda c: 3 if len(c) == 1 else 1 / 0).first()
    assert (got.files, got.failed, got.pages) == (2, 1, 3)
    with pytest.raises(InvalidParameter):
        files.file_limit(0)
    assert files.file_limit(None, 5) == 5


def test_sample_is_reproducible(spark):
    df = spark.range(1000)
    a, b = ([r.id for r in files.sample(df, "id", 20, s).collect()] for s in (1, 1))
    assert a == b and a != [r.id for r in files.sample(df, "id", 20, 2).collect()]


def test_stream_ingest_replays(spark, tmp_path):
    source, target = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.createDataFrame([("a",), ("b",), ("a",)], "text string").write.parquet(source)
    assert ingest.ingest(spark, source, "text", target).count() == 2
    spark.createDataFrame([("b",), ("c",)], "text string").write.mode("append").parquet(source)
    assert ingest.ingest(spark, source, "text", target, files_per_trigger=1).count() == 3
    assert ingest.ingest(spark, source, "text", target).count() == 3


def test_dedup_stream_and_states(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.sql("select 'j1' job_id, 'Pending' status, 1L at_ms, timestamp_ntz'2024-01-01 00:00:00' ts union all select 'j1', 'Generating', 2L, timestamp_ntz'2024-01-01 00:01:00' union all select 'j2', 'Failed', 1L, timestamp_ntz'2024-01-01 00:02:00'").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for name, df, mode in (("dd", ingest.dedup_stream(stream, "job_id", "ts"), "append"), ("st", states.track(stream.drop("ts")), "update")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("dd").count() == 2
    assert {r.job_id: (r.status, r.events) for r in spark.table("st").collect()} == {"j1": ("Generating", 2), "j2": ("Failed", 1)}
