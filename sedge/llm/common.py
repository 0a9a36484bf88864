"""Shared plumbing: staging tables in the cluster's shared folder, and partition counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.storage import drop, scratch, stage

#: ``[^\x20\x09-\x0D]+`` for Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: What exact equality ignores.
BLANK = r"[\x20\x09-\x0D]+"


def ranges(staged: DataFrame, each: int) -> tuple[int, ...]:
    """Partitions for a staged table, of ``each`` bytes of its files, where that makes more than the session's
    number; else nothing, so that adaptive execution can join small ones."""
    size = int(str(staged._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    many = -(-size // each)
    return (many,) if many > int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()


def hash_bits(texts: DataFrame, most: int) -> int:
    """Bits of a hash that deal what is counted in ``texts`` over groups: 10, more from a GB of text on."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(10, math.ceil(math.log2(max(1, size / 2**30))) + 10))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    made = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        made.append(w)
    return made


def keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a number of its own for each row, written down so that it stays the same."""
    return stage(df.withColumn(key, F.monotonically_increasing_id()), "keyed")


#: Rows of ids up to which a table of ids is broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1 << 20


def without(df: DataFrame, id_col: str, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose id is not among ``gone[key]``; a null id is an id like others."""
    gone = stage(gone, "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return df.join(side, F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left_anti")
