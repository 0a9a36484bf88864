"""Content ids and record ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

# The three definitions of a valid content id.
STORED_CID = "^[0-9a-f]{2,}$"
DELETABLE_CID = "^[0-9a-f]{32,128}$"
HEX = "^[0-9a-f]+$"


def content_id(content: Column) -> Column:
    """64 hex digits of the bytes (SHA-256, computed in the JVM)."""
    return F.sha2(content.cast("binary"), 256)


@pandas_udf(StringType())
def blake3_id(content: pd.Series) -> pd.Series:
    """The same shape of id by BLAKE3, where ids must match stores that were filled with it."""
    from sedge.functions.blake3 import blake3

    return content.map(lambda c: None if c is None else blake3(bytes(c)))


def is_cid(c: Column) -> Column:
    return c.rlike(STORED_CID)


def normalize_cids(cids: Column) -> Column:
    """Trimmed, lower case, hex only, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(cids, lambda x: F.lower(F.trim(x))), lambda x: x.rlike(HEX)))


def doc_record_id(silo: Column, doc: Column) -> Column:
    return F.concat_ws("-", silo, doc, F.lit("doc"))


def chunk_record_id(silo: Column, doc: Column, position: Column) -> Column:
    return F.concat_ws("-", silo, doc, F.lit("chunk"), position.cast("string"))


def blob_key(silo: Column, cid: Column, root: str = "") -> Column:
    parts = [F.lit(root.strip("/"))] if root.strip("/") else []
    return F.concat_ws("/", *parts, F.lit("blobs"), silo, F.substring(cid, 1, 2), cid)


def without_empty(value: Column, kind: DataType) -> Column:
    """``value`` with empty arrays, and structs of nothing but nulls, made null at any depth."""
    if isinstance(kind, ArrayType):
        inner = F.transform(value, lambda x: without_empty(x, kind.elementType)) if isinstance(kind.elementType, ArrayType | StructType) else value
        return F.when(F.size(value) > 0, inner)
    if isinstance(kind, StructType) and kind.fields:
        fields = [(without_empty(value[f.name], f.dataType).alias(f.name), f.name) for f in kind]
        made = F.struct(*[c for c, _ in fields])
        return F.when(F.coalesce(*[F.when(c.isNotNull(), True) for c, _ in fields]), made)
    return value


def content_hash(decision: Column, kind: DataType) -> Column:
    """Hash of a decision's JSON, of type ``kind``, with empty fields left out."""
    return F.sha2(F.to_json(without_empty(decision, kind), {"ignoreNullFields": "true"}), 256)


def check_blob_size(content: Column, most: int) -> Column:
    """Null where content is within a store's limit, else what is wrong."""
    size = F.octet_length(content.cast("binary"))
    return F.when(size > most, F.concat(F.lit("blob of "), size.cast("string"), F.lit(f" bytes exceeds {most}")))
