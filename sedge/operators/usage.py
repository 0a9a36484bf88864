"""Token usage: totals over maps by modality, key-wise merging, audits of chunks against sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import text as tx

# Words of a ruling's head.
HEADS = ("Sygn. akt", "WYROK")
MAPS = ("input", "output", "cache", "tool")


def total_of(usage: Column) -> Column:
    return F.aggregate(F.map_values(F.coalesce(usage, F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))


def totals(df: DataFrame) -> DataFrame:
    """Adds input_total, output_total, total (with thoughts) and effective_input."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = df.withColumn("input_total", total_of(F.col("input"))).withColumn("output_total", total_of(F.col("output")))
    return out.withColumn("total", F.col("input_total") + F.col("output_total") + n("thoughts")).withColumn("effective_input", F.greatest(F.col("input_total") - n("cache_creation"), F.lit(0)))


def merge(df: DataFrame, key: str, usage: str) -> DataFrame:
    """(key, modality, tokens): maps added key by key, partially before the shuffle."""
    return df.select(key, F.explode(usage).alias("modality", "n")).groupBy(key, "modality").agg(F.sum("n").alias("tokens"))


def merge_maps(left: Column, right: Column) -> Column:
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def audit(docs: DataFrame, chunks: DataFrame, doc: str, text: str, body: str, order: str) -> DataFrame:
    """Counters of each source against its chunks joined by blank lines."""
    parts = chunks.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("b")))).alias("p"))
    parts = parts.select(doc, F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("joined"), F.size("p").alias("chunks"))
    both = docs.select(doc, F.col(text).alias("source")).join(parts, doc, "left").withColumn("joined", F.coalesce("joined", F.lit(""))).withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    counters = {"tokens": tx.count_tokens, "chars": lambda c: F.length(c).cast("long"), "digits": tx.count_digits, "statutes": tx.count_statutes}
    cols = [f(F.col(side)).alias(f"{which}_{name}") for name, f in counters.items() for which, side in (("source", "source"), ("chunk", "joined"))]
    head = F.lit(False)
    for word in HEADS:
        head = head | F.col("joined").contains(word)
    out = both.select(doc, "chunks", *cols, head.alias("header_in_chunks"))
    return out.withColumn("drift_pct", F.round(tx.drift(F.col("source_tokens"), F.col("chunk_tokens")).cast("double"), 3))


def audit_tsv(audited: DataFrame) -> DataFrame:
    """The audit as text lines: tab separated, drift with one decimal, status ok or fail."""
    status = F.when(F.abs("drift_pct") <= 15, "ok").otherwise("fail")
    flag = lambda c: F.when(F.col(c), "yes").otherwise("no") if dict(audited.dtypes)[c] == "boolean" else F.col(c).cast("string")
    cells = [flag(c) for c in audited.columns if c != "drift_pct"]
    return audited.select(F.concat_ws("\t", *cells, F.format_string("%.1f", "drift_pct"), status).alias("value"))
