"""Projection of dotted paths out of JSON records or typed rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedge.functions.scalars import finite


MOST_NUMERIC = 6


def json_paths(path: str) -> list[str]:
    """JSON paths that a dotted path can mean, in order: a numeric segment is an array's position or an
    object's key.  None where a segment is empty or has quotes of both kinds."""
    parts = path.strip().split(".")
    if any(not p or "'" in p and '"' in p for p in parts) or sum(p.isdecimal() for p in parts) > MOST_NUMERIC:
        return []
    quoted = [f'["{p}"]' if "'" in p else f"['{p}']" for p in parts]
    ways = [(f"[{int(p)}]", q) if p.isascii() and p.isdecimal() else (q,) for p, q in zip(parts, quoted, strict=True)]
    return ["$" + "".join(w) for w in product(*ways)]


def extract(record: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where it is missing."""
    found = [F.try_variant_get(F.try_parse_json(record), p, "string") for p in json_paths(path)]
    return F.coalesce(*found, F.lit(None).cast("string"))


def project_json(df: DataFrame, record: str, fields: Sequence[str]) -> DataFrame:
    """Adds ``projected``: a JSON object keyed by the paths, with values as they are, nested ones too, and
    missing ones left out; no fields: the record."""
    fields = list(dict.fromkeys(f.strip() for f in fields if f.strip()))
    if not fields:
        return df.withColumn("projected", F.col(record))
    parsed = F.try_parse_json(F.col(record))
    values = [F.coalesce(*[F.try_variant_get(parsed, p, "variant") for p in paths]).alias(f) for f in fields if (paths := json_paths(f))]
    return df.withColumn("projected", F.to_json(F.struct(*values), {"ignoreNullFields": "true"}) if values else F.lit("{}"))


def _has(schema: StructType, path: str) -> bool:
    """Whether a dotted path of struct fields (or a column of that very name) exists."""
    if path in schema.names:
        return True
    head, _, rest = path.partition(".")
    kind = schema[head].dataType if head in schema.names else None
    return bool(rest) and isinstance(kind, StructType) and _has(kind, rest)


def rows(df: DataFrame, fields: Sequence[str], score: str | None = "score", base: Sequence[str] = ("id", "doc_type", "doc_id")) -> DataFrame:
    """Result rows: the fields that exist, then base columns that were not asked for, then the finite score."""
    fields = [f for f in dict.fromkeys(f.strip() for f in fields if f.strip()) if _has(df.schema, f)] if any(f.strip() for f in fields) else [c for c in df.columns if c != score]
    missing = [c for c in base if c in df.columns and c not in fields]
    out = [F.col(f"`{f}`" if f in df.columns else f).alias(f) for f in (*fields, *missing) if f != score]
    return df.select(*out, *([finite(F.col(score)).alias(score)] if score and score in df.columns else []))
