"""Text clean-up, counters and tests as Column functions; NFKC and sentences as Arrow-backed UDFs."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

# Patterns of the clean-up steps and counters.
CONTROL = r"[\p{Cc}&&[^\t\n\r]]"
PAGE_NUMBER = r"(?U)\n\s*\d+\s*(?:/\s*\d+)?\s*\n"
HYPHEN_BREAK = r"(?U)(\w+)-\s*\n\s*(\w+)"
MISSING_SPACE = "(\\p{Ll})([A-ZŁŚĆŻŹÓĘĄŃ])([ąćęłńóśżź])"
STATUTE_CUE = r"(?i)(art\.|ust\.|§|dz\.?\s*u\.)"
NOISE = r"(?U)^[0-9\s.,\-_:;]+$"
#: Texts that are Python objects together while they are split.
SPLIT = 64


@pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def remove_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_NUMBER, "\n")


def join_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, HYPHEN_BREAK, "$1$2")


def insert_spaces(c: Column) -> Column:
    return F.regexp_replace(c, MISSING_SPACE, "$1 $2$3")


def cleanup(c: Column, normalise: bool = True, page_numbers: bool = True, hyphens: bool = True, spaces: bool = True) -> Column:
    """Control characters go, then NFKC, page numbers, hyphen breaks, missing spaces, white space."""
    c = F.regexp_replace(c, CONTROL, "")
    for wanted, step in ((normalise, nfkc), (page_numbers, remove_page_numbers), (hyphens, join_hyphens), (spaces, insert_spaces)):
        c = step(c) if wanted else c
    return collapse(c)


def count_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+")).cast("long")


def count_digits(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[0-9]")).cast("long")


def count_statutes(c: Column) -> Column:
    return F.regexp_count(c, F.lit(STATUTE_CUE)).cast("long")


def drift(source: Column, chunk: Column) -> Column:
    """Percentage by which the chunks fall short of the source, in single precision; 0 for an empty source."""
    return F.when(source == 0, F.lit(0.0).cast("float")).otherwise(((source - chunk).cast("float") * F.lit(100.0).cast("float") / source.cast("float")).cast("float"))


def is_numeric_noise(c: Column) -> Column:
    return c.rlike(NOISE) & c.rlike("[0-9]")


def search_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def normalize_query(c: Column) -> Column:
    return F.lower(collapse(c))


def _split(text: pa.Array) -> pa.Array:
    from sedge.functions.segmenter import split

    each = [None if t is None else split(t) for t in text.to_pylist()]
    ends = np.cumsum([0, *(len(x or ()) for x in each)])
    order = pa.array([i for x in each if x for i in range(len(x))], pa.int32())
    flat = pa.StructArray.from_arrays([order, pa.array([s for x in each if x for s in x], pa.string())], ["ord", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([x is None for x in each], pa.bool_()))


@arrow_udf(T.ArrayType(T.StructType().add("ord", T.IntegerType()).add("text", T.StringType())))
def sentences(text: pa.Array) -> pa.Array:
    """Sentences with their order; Python objects of ``SPLIT`` texts at a time, all others are Arrow columns."""
    parts = [_split(text.slice(i, SPLIT)) for i in range(0, len(text), SPLIT)]
    return pa.concat_arrays(parts) if parts else _split(text)
