import pytest

from sedge.errors import Duplicate
from sedge.operators import jobs as jb

NOW = 10**12
OLD = NOW - jb.PENDING_AGE_MS


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("a", "Pending", OLD, 0, None),
        ("b", "Pending", OLD + 1, 0, None),
        ("c", "Pending", OLD, 0, NOW + 1),
        ("d", "Generating", NOW - jb.GENERATING_AGE_MS, 3, NOW),
        ("e", "Failed", OLD, 0, None),
        ("f", "Pending", OLD, 2, None),
    ]
    full = [(j, s, u - 5, u, False, r, 3, None, n) for j, s, u, r, n in rows]
    return spark.createDataFrame(full, "job_id string, status string, created_at_ms long, updated_at_ms long, stale boolean, retry_count int, max_retries int, last_error string, next_retry_at_ms long")


def test_stale_boundaries(table):
    assert [r.job_id for r in jb.stale(table, "Pending", jb.PENDING_AGE_MS, NOW).orderBy("job_id").collect()] == ["a", "f"]
    assert [r.job_id for r in jb.ready(table, "Pending", NOW, limit=2).collect()] == ["a", "b"]


@pytest.mark.parametrize(("action", "outcomes"), [("both", {"a": "requeued", "d": "failed", "f": "requeued"}), ("requeue", {"a": "requeued", "d": "skipped", "f": "requeued"}), ("fail", {"a": "failed", "d": "failed", "f": "failed"})])
def test_reap(table, action, outcomes):
    got = {r.job_id: r for r in jb.reap(table, NOW, action).collect()}
    assert {k: v.outcome for k, v in got.items()} == outcomes
    if action == "both":
        assert (got["a"].status, got["a"].retry_count, got["a"].next_retry_at_ms) == ("Pending", 1, NOW + 300_000)
        assert got["f"].next_retry_at_ms == NOW + 1_200_000 and got["a"].stale
        assert (got["d"].status, got["d"].retry_count) == ("Failed", 3)
        assert {r.outcome: r.jobs for r in jb.reap_report(jb.reap(table, NOW)).collect()} == {"requeued": 2, "failed": 1}


def test_stats(table):
    got = {r.status: (r.jobs, r.oldest_created_ms) for r in jb.stats(table).collect()}
    assert got == {"Pending": (4, OLD - 5), "Generating": (1, NOW - jb.GENERATING_AGE_MS - 5), "Failed": (1, OLD - 5)}
    assert jb.oldest(table, "Generated").first().oldest_created_ms is None


def test_enqueue(spark, table):
    new = spark.createDataFrame([("a", 1), ("x", 2), ("x", 1)], "job_id string, created_at_ms long")
    accepted, rejected = jb.enqueue(table, new)
    assert [(r.job_id, r.created_at_ms) for r in accepted.collect()] == [("x", 1)] and rejected.count() == 2
    with pytest.raises(Duplicate):
        jb.enqueue_strict(table, new)


def test_latest(spark):
    e = spark.createDataFrame([(1, 1, "Pending"), (1, 3, "Generated"), (1, 2, "Generating"), (2, 1, "Pending")], "k int, t int, s string")
    assert {r.k: r.s for r in jb.latest(e, "k", ["t"], "s").collect()} == {1: "Generated", 2: "Pending"}
