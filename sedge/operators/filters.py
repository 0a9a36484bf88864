"""Filter expressions, sort specifications and parameter checks, all settled before a plan is built.

Grammar: ``= != > >= < <= AND OR NOT ( ) IN [a, b] EXISTS IS NULL`` with double-quoted, single-quoted or
bare values.  The result is a Column (never SQL text), so the Parquet reader prunes with it.  Equality on
an array column means membership.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.errors import InvalidParameter

_TOKEN = re.compile(r"""\s*(?:(?P<op>!=|>=|<=|=|>|<|\(|\)|\[|\]|,)|"(?P<dq>(?:\\.|[^"\\])*)"|'(?P<sq>(?:\\.|[^'\\])*)'|(?P<word>[^\s()\[\],=<>!"']+))""")
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidParameter("filter", f"unexpected character at {at}")
        kind = m.lastgroup
        value = m.group(kind)
        out.append(("value", re.sub(r"\\(.)", r"\1", value)) if kind in ("dq", "sq") else (kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, df: DataFrame, allowed: Sequence[str] | None):
        self.tokens, self.at, self.df, self.allowed = _tokens(text), 0, df, allowed

    def peek(self, *words: str) -> bool:
        if self.at >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at]
        return kind != "value" and value.upper() in words

    def take(self, *words: str) -> str:
        if not self.peek(*words):
            raise InvalidParameter("filter", f"expected {' or '.join(words)}")
        self.at += 1
        return self.tokens[self.at - 1][1].upper()

    def value(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "op":
            raise InvalidParameter("filter", "a value is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def field(self) -> tuple[Column, T.DataType]:
        name = self.value()
        if self.allowed is not None and name not in self.allowed:
            raise InvalidParameter("filter", f"field {name} can't be filtered")
        kind: T.DataType = self.df.schema
        column = None
        for part in name.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                raise InvalidParameter("filter", f"unknown field {name}")
            kind = kind[part].dataType
            column = F.col(f"`{part}`") if column is None else column.getField(part)
        return column, kind

    def literal(self, kind: T.DataType) -> Column:
        text = self.value()
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(kind, T.NumericType):
            try:
                number = float(text)
            except ValueError:
                raise InvalidParameter("filter", f"{text} is no number") from None
            return F.lit(int(text) if re.fullmatch(r"-?\d+", text) else number)
        return F.lit(text).cast(kind)

    def comparison(self) -> Column:
        column, kind = self.field()
        many = isinstance(kind, T.ArrayType)
        if self.peek("EXISTS"):
            self.take("EXISTS")
            return column.isNotNull()
        if self.peek("IS"):
            self.take("IS")
            wanted = self.peek("NOT") and bool(self.take("NOT"))
            self.take("NULL")
            return column.isNotNull() if wanted else column.isNull()
        if self.peek("IN", "NOT"):
            negated = self.peek("NOT") and bool(self.take("NOT"))
            self.take("IN")
            self.take("[")
            values = []
            while not self.peek("]"):
                values.append(self.literal(kind))
                if not self.peek("]"):
                    self.take(",")
            self.take("]")
            found = F.arrays_overlap(column, F.array(*values)) if many else column.isin(*values)
            return ~found if negated else found
        op = self.take(*_COMPARE)
        value = self.literal(kind)
        if many and op in ("=", "!="):
            found = F.array_contains(column, value)
            return found if op == "=" else ~found
        return F.exists(column, lambda x: _COMPARE[op](x, value)) if many else _COMPARE[op](column, value)

    def unary(self) -> Column:
        if self.peek("NOT"):
            self.take("NOT")
            return ~self.unary()
        if self.peek("("):
            self.take("(")
            inside = self.either()
            self.take(")")
            return inside
        return self.comparison()

    def both(self) -> Column:
        left = self.unary()
        while self.peek("AND"):
            self.take("AND")
            left = left & self.unary()
        return left

    def either(self) -> Column:
        left = self.both()
        while self.peek("OR"):
            self.take("OR")
            left = left | self.both()
        return left


def parse_filter(text: str | None, df: DataFrame, allowed: Sequence[str] | None = None) -> Column | None:
    """The filter as a Column; None for blank text."""
    if text is None or not text.strip():
        return None
    parser = _Parser(text, df, allowed)
    out = parser.either()
    if parser.at < len(parser.tokens):
        raise InvalidParameter("filter", "something follows the expression")
    return out


def apply_filter(df: DataFrame, text: str | None, allowed: Sequence[str] | None = None) -> DataFrame:
    condition = parse_filter(text, df, allowed)
    return df if condition is None else df.where(condition)


def parse_sort(specs: Sequence[str], df: DataFrame, allowed: Sequence[str] | None = None) -> list[Column]:
    """``field:asc`` and ``field:desc`` as sort columns, nulls last; blanks are skipped."""
    out = []
    for spec in (s.strip() for s in specs):
        if not spec:
            continue
        name, _, way = spec.rpartition(":")
        if not name or way.lower() not in ("asc", "desc"):
            raise InvalidParameter("sort", f"{spec} is not field:asc or field:desc")
        if name not in df.columns or (allowed is not None and name not in allowed):
            raise InvalidParameter("sort", f"field {name} can't be sorted")
        out.append(F.asc_nulls_last(name) if way.lower() == "asc" else F.desc_nulls_last(name))
    return out


def ensure_range(field: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise InvalidParameter(field, f"must be {low} to {high}")
    return value


def ensure_list(field: str, values: Sequence[str], most: int, longest: int = 128) -> list[str]:
    values = [v.strip() for v in values if v.strip()]
    if len(values) > most or any(len(v.encode()) > longest for v in values):
        raise InvalidParameter(field, f"{most} values of {longest} bytes at most")
    return values


def ensure_text(field: str, value: str, least: int) -> str:
    value = value.strip()
    if len(value) < least:
        raise InvalidParameter(field, f"needs {least} characters")
    return value


def normalize_weights(keyword: float, vector: float) -> tuple[float, float]:
    """Weights that sum to 1, normalised in single precision."""
    for name, w in (("keyword_weight", keyword), ("vector_weight", vector)):
        if not math.isfinite(w) or not 0 <= w <= 1:
            raise InvalidParameter(name, "must be 0 to 1")
    k, v = np.float32(keyword), np.float32(vector)
    if k + v <= np.finfo(np.float32).eps:
        raise InvalidParameter("weights", "must not both be 0")
    return float(k / (k + v)), float(v / (k + v))


def index_name(name: str) -> str:
    name = name.strip().lower()
    if not name or "/" in name or "\\" in name:
        raise InvalidParameter("index", "not a name")
    return name
