"""Document processors as table functions: preprocess, chunk and postprocess, called laterally on a table.

A processor is any object with the three methods of ``Processor``; ``table_function`` makes a Python table function of it, whose ``analyze``
checks its argument and names its columns when the query is planned.  Each document is one call, so processors see whole
documents; Spark deals the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from sedge.errors import InvalidParameter

#: Columns of a chunk: place in the document from 0, section or null, text.
CHUNK = StructType().add("ord", IntegerType()).add("section", StringType()).add("content", StringType())
_BLANK = re.compile(r"[ \t\n\f\r]+")


class Chunk(NamedTuple):
    section: str | None
    content: str


class Processor(Protocol):
    def preprocess(self, text: str) -> str: ...

    def chunk(self, text: str) -> Sequence[Chunk]: ...

    def postprocess(self, chunks: Sequence[Chunk]) -> Sequence[Chunk]: ...


class Windows:
    """Windows of ``size`` words, each sharing ``overlap`` words with the one before."""

    def __init__(self, size: int, overlap: int = 0):
        if not 0 <= overlap < size:
            raise InvalidParameter("overlap", "must be less than the size")
        self.size, self.step = size, size - overlap

    def preprocess(self, text: str) -> str:
        return _BLANK.sub(" ", text).strip(" ")

    def chunk(self, text: str) -> Sequence[Chunk]:
        words = text.split(" ") if text else []
        many = 0 if not words else 1 + max(0, -(-(len(words) - self.size) // self.step))
        return [Chunk(None, " ".join(words[i * self.step : i * self.step + self.size])) for i in range(many)]

    def postprocess(self, chunks: Sequence[Chunk]) -> Sequence[Chunk]:
        return chunks


class Sentences:
    """Sentences, numbered; those that are only digits and punctuation go."""

    def preprocess(self, text: str) -> str:
        return text.strip()

    def chunk(self, text: str) -> Sequence[Chunk]:
        from sedge.functions.segmenter import split

        return [Chunk("body", s) for s in split(text)]

    def postprocess(self, chunks: Sequence[Chunk]) -> Sequence[Chunk]:
        return [c for c in chunks if not re.fullmatch(r"[0-9\s.,\-_:;]+", c.content)]


def table_function(processor: Processor):
    """``processor`` as a table function of one text: (ord, section, content) of its chunks; a null text has none."""

    class Process:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError(f"a processor takes a text, not {text.dataType.simpleString()}")
            return AnalyzeResult(schema=CHUNK)

        def eval(self, text: str | None) -> Iterator[tuple]:
            if text is None:
                return
            chunks = processor.postprocess(processor.chunk(processor.preprocess(text)))
            yield from ((i, c.section, c.content) for i, c in enumerate(chunks))

    return udtf(Process, useArrow=True)


def process(df: DataFrame, text: str, processor: Processor) -> DataFrame:
    """The rows of ``df`` without ``text``, once for each chunk, with ``ord``, ``section`` and ``content``."""
    rest = [c for c in df.columns if c != text]
    return df.lateralJoin(table_function(processor)(F.col(text).outer())).select(*rest, "ord", "section", "content")
