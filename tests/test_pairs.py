"""Payload pairs: all of a job or none."""

import pytest
from pyspark.sql import functions as F

from sedge.sources import pairs


def offered(spark, n):
    return spark.range(n).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.col("id").cast("string").cast("binary").alias("content"), F.format_string('{"n":%d}', "id").alias("details"))


def test_pairs(spark, tmp_path):
    spark.dataSource.register(pairs.PairSink)
    path = f"file://{tmp_path}/out"
    offered(spark, 20).repartition(4).write.format("pairs").mode("append").save(path)
    got = {r.doc_id: (bytes(r.content), r.details) for r in pairs.load_pairs(spark, path).collect()}
    assert got == {f"d{i}": (str(i).encode(), f'{{"n":{i}}}') for i in range(20)}
    folders = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(folders) == 1 and folders[0].startswith("job-")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(pairs.PairSink)
    path = f"file://{tmp_path}/out"
    offered(spark, 3).write.format("pairs").mode("append").save(path)
    bad = offered(spark, 40).withColumn("doc_id", F.when(F.col("doc_id") == "d39", "a/b").otherwise(F.concat(F.lit("x"), "doc_id")))
    with pytest.raises(Exception, match="cannot name a file"):
        bad.repartition(4).write.format("pairs").mode("append").save(path)
    assert {r.doc_id for r in pairs.load_pairs(spark, path).collect()} == {"d0", "d1", "d2"}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
