"""Connected components of an undirected graph by alternating large-star and small-star rounds
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014).

Rounds are joins and aggregations only, so no neighbourhood is gathered in one task; every round is
written to the shared folder, which cuts lineage.  The method settles in O(log^2 n) rounds; ``MOST_ROUNDS`` is
far beyond that for any table that can be stored, and an error tells if it is ever reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node it reaches."""
    edges = common.stage(edges, "cc-edges")  # read twice, here and at the end
    nodes_alone = edges.where("a = b").select(F.col("a").alias("node"))
    e = common.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        last, e = e, common.stage(small.select("x.hi", "x.lo").where("hi <> lo").distinct(), "cc")
        common.drop(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: not settled after {MOST_ROUNDS} rounds")
    roots = e.select("lo").distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).unionByName(
        nodes_alone.distinct().join(e, F.col("node") == F.col("hi"), "left_anti").join(roots, F.col("node") == F.col("lo"), "left_anti").select("node", F.col("node").alias("root"))
    )
