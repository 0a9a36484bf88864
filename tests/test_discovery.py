"""Discovery as a stream: admission, end, restart, content stored once."""

import sys

import pytest
from pyspark import cloudpickle

from sedge.sources import portal
from sedge.streaming import discovery

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this module


def page(items, total=None, broken=False):
    rows = "".join(f'<div class="search-list-item"><div>{"" if broken else f"<a class=link-details href=/Home/Details/{i}></a>"}</div><p><label>Sygnatura</label> ABC {i}/20</p></div>' for i in items)
    return (f'<input id="resultCounts" value="1, {total}">' if total is not None else "") + rows


class Site:
    """A portal of ``n`` documents that writes down which pages are asked for."""

    def __init__(self, log, n, counter=True, broken=()):
        self.log, self.n, self.counter, self.broken = str(log), n, counter, broken

    def __call__(self, number):
        with open(self.log, "a") as f:
            f.write(f"{number}\n")
        items = range((number - 1) * 10 + 1, min(self.n, number * 10) + 1)
        return page(items, self.n if self.counter and number == 1 else None, number in self.broken)

    def asked(self):
        with open(self.log) as f:
            return [int(x) for x in f]


def work(doc_id, href):
    if doc_id == "13":
        raise OSError("gone")
    return f"content {int(doc_id) % 20}".encode()


def test_discovery_runs_to_the_first_empty_page(spark, tmp_path):
    site = Site(tmp_path / "log", 34, counter=False)
    spark.dataSource.register(portal.PortalSource.use(site))
    target = f"file://{tmp_path}/out"
    got = discovery.discover(spark, "portal", work, target, workers=3, max_pages=2)
    assert got == {"discovered": 34, "stored": 20, "skipped": 13, "rejected": 1}
    assert site.asked() == [1, 2, 3, 4, 5]  # each once; page 5 is empty
    events = spark.read.parquet(f"{target}/events").orderBy("ordinal").collect()
    assert [r.ordinal for r in events] == [i for i in range(1, 35) if i != 13] and events[0].docket == "ABC 1/20"
    assert sorted({r.batch for r in events}) == [0, 1]  # two pages a batch
    reject = spark.read.parquet(f"{target}/rejects").collect()
    assert [(r.doc_id, r.stage, r.message) for r in reject] == [("13", "fetch", "OSError: gone")]
    assert {bytes(r.content) for r in spark.read.parquet(f"{target}/store").collect()} == {f"content {i}".encode() for i in range(20)}
    # The same checkpoint again: nothing is asked for, nothing is stored twice.
    assert discovery.discover(spark, "portal", work, target, workers=3, max_pages=2) == got and site.asked() == [1, 2, 3, 4, 5]


def test_restart_goes_on_behind_the_last_batch(spark, tmp_path):
    """A failure in the third page's fetch ends the run; the next one asks for no finished page."""
    site, target = Site(tmp_path / "log", 47), f"file://{tmp_path}/out"

    class Flaky(Site):
        def __call__(self, number):
            if number == 3 and not (tmp_path / "up").exists():
                raise OSError("portal down")
            return super().__call__(number)

    flaky = Flaky(site.log, 47)
    spark.dataSource.register(portal.PortalSource.use(flaky))
    with pytest.raises(Exception, match="portal down"):
        discovery.discover(spark, "portal", work, target, max_pages=1)
    assert site.asked() == [1, 2]
    (tmp_path / "up").write_text("")
    got = discovery.discover(spark, "portal", work, target, max_pages=1)
    assert site.asked() == [1, 2, 3, 4, 5]  # the counter tells that there is no page 6
    assert got == {"discovered": 47, "stored": 20, "skipped": 26, "rejected": 1}


def test_limit_and_unreadable_pages(spark, tmp_path):
    site, target = Site(tmp_path / "log", 100, broken=(2,)), f"file://{tmp_path}/out"
    spark.dataSource.register(portal.PortalSource.use(site))
    got = discovery.discover(spark, "portal", work, target, limit=25, max_pages=5)
    assert site.asked() == [1, 2, 3] and got["rejected"] == 1 and got["stored"] + got["skipped"] == 15
    assert spark.read.parquet(f"{target}/rejects").first().stage == "page"


def test_pages_as_a_table(spark, tmp_path):
    for counter, asked in ((True, [1, 2, 3, 4]), (False, [1, 2, 3, 4, 5])):
        site = Site(tmp_path / f"log{counter}", 34, counter)
        spark.dataSource.register(portal.PortalSource.use(site))
        df = spark.read.format("portal").load()
        assert sorted((r.page, r.seen) for r in df.collect()) == [(1, 0), (2, 10), (3, 20), (4, 30)]
        assert sorted(site.asked()) in (asked, sorted([1, *asked]))  # page 1 once per planning
    got = discovery.tasks(spark.read.format("portal").option("limit", 12).load())
    assert sorted(r.ordinal for r in got.collect()) == list(range(1, 13))


def test_judgments_by_total_or_to_the_empty_page(spark):
    rows = lambda p, until: [(f"j{p}-{i}", "2020-01-01", until) for i in range(100 if p < 2 else 7 if p == 2 else 0)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for total, parts in ((lambda until: 207, 3), (None, 1)):
            spark.dataSource.register(portal.JudgmentSource.use(rows, total))
            df = spark.read.format("judgments").load()
            assert df.count() == 207 and df.rdd.getNumPartitions() == parts
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
