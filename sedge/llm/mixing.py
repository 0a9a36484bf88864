"""Mixing sources to target weights by Sainte-Laguë apportionment - DataFrame functions only.

1. Sizes in words per document; totals per source (pre-aggregated before the shuffle).
2. Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating; they share the words of
   all sources.  A target stops at ``most`` times its source's size and the excess is reshared by
   weight until none is above: the water level is found in closed form from sources sorted by
   cap / weight.
3. The total is cut into equal blocks of tokens, apportioned to the sources by highest quotients
   target / (2k + 1), then within each source to its shards by size in the same way.  A block has
   ``block`` words, or fewer so that the least target has ``LEAST_BLOCKS`` of them: a source's words come
   within a hundredth of its target or to the word.  Rounding share to nearest leaves as many seats to give
   or take as half the parties at most, and the divisor's bounds say how many of them a party can
   get, so about three quotients a party are formed in all.
4. In a shard, documents lie in seeded order and are cut into runs of ``block`` words; whole passes over the
   shard come first, the rest are the runs of smallest seeded hash, the last one in part.

A source of any size is dealt over shards of about ``shard_words`` (at most ``MOST_SHARDS``), so a
hot source makes many groups.  Only a table of a few numbers per source passes through one task (the
targets need running sums over all sources).  Defined results: null text has size 0 and takes 0; a source without
words has target 0; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common

BLOCK = 128
LEAST_BLOCKS = 128
SHARD_WORDS = 1 << 17
MOST_SHARDS = 1 << 17
MOST_TIMES = 3
SEED = "mix"
#: Sources up to which their table (a few numbers a row) is broadcast; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 20_000


def _apportion(shares: DataFrame, key: str, within: list[str], seats: str) -> DataFrame:
    """Sainte-Laguë: ``shares`` has (within..., key, votes, all_votes, ``seats``); adds ``quota``.

    Every party starts at its rounded share; the seats missing (or too many) are given to the highest
    next quotients (taken from the lowest last ones).  With P parties and V votes the divisor of the result
    lies between V / (seats + P / 2) and V / (seats - P / 2), so a party of v votes gains or loses
    v P / 2V + 2 seats at most: no more of its quotients are formed.
    """
    w = Window.partitionBy(*within)
    bound = F.col("votes") / F.col("all_votes") * F.count(F.lit(1)).over(w) / 2 + 2
    start = shares.withColumn("start", F.when(F.col("all_votes") > 0, F.floor(F.col("votes") / F.col("all_votes") * F.col(seats) + 0.5)).otherwise(0).cast("long"))
    start = start.withColumn("gap", F.col(seats) - F.sum("start").over(w)).withColumn("most", F.when(F.col("votes") > 0, F.ceil(bound)).otherwise(0))
    most = F.least(F.abs("gap"), "most")
    step = start.where((F.col("gap") != 0) & (F.col("most") > 0)).select(*within, key, "votes", "gap", "start", F.explode(F.sequence(F.lit(1).cast("long"), most)).alias("k"))
    quotient = F.when(F.col("gap") > 0, -F.col("votes") / (2 * (F.col("start") + F.col("k")) - 1)).otherwise(F.col("votes") / (2 * (F.col("start") - F.col("k")) + 1))
    step = step.where((F.col("gap") > 0) & (F.col("votes") > 0) | (F.col("gap") < 0) & (F.col("k") <= F.col("start"))).withColumn("q", quotient)
    step = step.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy("q", key, "k"))).where(F.col("place") <= F.abs("gap"))
    moved = step.groupBy(*within, key).agg(F.sum(F.signum("gap")).cast("long").alias("moved"))
    return start.join(moved, [*within, key], "left").withColumn("quota", F.col("start") + F.coalesce("moved", F.lit(0))).drop("start", "gap", "moved", "most")


def source_targets(sizes: DataFrame, most: int = MOST_TIMES) -> DataFrame:
    """One row per source: source, rank, source_size, all_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy(F.lit(0))  # a row per source
    per = per.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))))
    per = per.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("all_size", F.sum("source_size").over(whole))
    per = per.withColumn("cap", most * F.col("source_size"))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    big = "decimal(38,0)"
    per = per.withColumn("full", F.col("cap").cast(big) * left.cast("decimal(18,0)") <= (F.col("all_size") - before).cast(big) * F.col("weight").cast("decimal(18,0)"))
    per = per.withColumn("rest", F.col("all_size") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    per = per.withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("rest") * F.col("weight") / F.col("rest_weight"))
    return per.select("source", "rank", "source_size", "all_size", target.alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_words: int = SHARD_WORDS, most: int = MOST_TIMES, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, size, source_size, target, taken; with ``row_col``, which numbers the rows,
    also row and n, the place in the shard."""
    row = ["row"] if row_col else []
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD)), F.lit(0)).cast("long")
    sizes = common.stage(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *[F.col(row_col).alias(r) for r in row]), "mix-sizes")
    targets = common.stage(source_targets(sizes, most).withColumn("shards", F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    least = targets.where("target > 0").agg(F.min("target")).first()[0] or 0
    unit = min(block, max(1, int(least // LEAST_BLOCKS)))
    seats = F.floor(F.col("all_size") / unit + 0.5).cast("long")
    by_source = _apportion(targets.withColumn("one", F.lit(0)).withColumn("votes", F.col("target")).withColumn("all_votes", F.col("all_size")).withColumn("seats", seats), "rank", ["one"], "seats")
    by_source = by_source.select("rank", F.col("quota").alias("source_quota"))
    code = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    named = targets.select(F.col("source").alias("named"), "rank", "shards", "source_size", "target")
    rows = sizes.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("named"))).withColumn("code", code)
    rows = rows.withColumn("shard", F.conv(F.substring("code", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shards = rows.groupBy("rank", "shard", "source_size").agg(F.sum("size").alias("shard_size")).join(by_source, "rank")
    shards = _apportion(shards.withColumn("votes", F.col("shard_size").cast("double")).withColumn("all_votes", F.col("source_size")), "shard", ["rank"], "source_quota")
    words = F.least(F.col("quota") * unit, most * F.col("shard_size"))
    shards = shards.select("rank", "shard", "shard_size", words.alias("words"))

    group = ["rank", "shard"]
    laid = rows.join(shards, group).withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("code", "doc_id", "size", *row)))
    laid = laid.withColumn("begin", F.sum("size").over(Window.partitionBy(*group).orderBy("n")) - F.col("size"))
    laid = laid.withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long"))
    laid = laid.withColumn("rest", F.col("words") - F.col("passes") * F.col("shard_size"))
    first, last = F.floor(F.col("begin") / block), F.floor(F.greatest(F.col("begin") + F.col("size") - 1, F.col("begin")) / block)
    cut = laid.withColumn("k", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("part", F.least(F.col("begin") + F.col("size"), (F.col("k") + 1) * block) - F.greatest(F.col("begin"), F.col("k") * block))
    cut = cut.withColumn("lot", F.md5(F.concat_ws("-", F.lit(seed), "rank", "shard", "k")))
    drawn = Window.partitionBy(*group).orderBy("lot", "k", "n").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.greatest(F.lit(0), F.least(F.col("part"), F.col("rest") - F.coalesce(F.sum("part").over(drawn), F.lit(0))))
    cut = cut.withColumn("more", taken)
    out = cut.groupBy(*group, "n", "doc_id", "size", "source_size", "target", "passes", *row).agg(F.sum("more").alias("more"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("more")).cast("long").alias("taken"), *row, *(["n"] if row else []))


def repeat_rows(df: DataFrame, **options) -> DataFrame:
    """``df`` with each document as often as the mix takes it, rounded down to whole texts with the
    remainder settled by a seeded draw (so a source's words come near its target); columns unchanged.
    Rows are told apart by a key of their own, and rows that share an id (or have none) draw apart."""
    key, plan_key, times = common.fresh(df, "mix_key", "mix_plan", "mix_times")
    rows = common.keyed(df, key)
    lot = F.concat_ws("-", F.lit("draw"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n")
    draw = F.conv(F.substring(F.md5(lot), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    plan = mix(rows, row_col=key, **options).select(F.col("row").alias(plan_key), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(0).cast("int").alias(times))
    joined = rows.join(plan.where(F.col(times) > 0), F.col(key) == F.col(plan_key))
    copy = common.fresh(joined, "mix_copy")[0]
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in df.columns])
