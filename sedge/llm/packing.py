"""Packing documents into training sequences along a space-filling curve.

Every document is tokenised once; its hashed bag of tokens is projected to a few dimensions (a fixed
random table per hash bucket), squashed to a grid and given its Hilbert index.  A range sort by
(Hilbert index, doc_id) brings similar documents together - in as many ranges as the staged tokens' bytes
ask for - and each partition is cut into sequences of ``length`` tokens in one streaming pass.  What is left at a partition's end is cut into sequences of
powers of two, so no sequence needs padding.

Tokenising goes word by word: the tokenizer drops white space and never joins across it, so the ids of
a text are the ids of its white-space words in order, and it lower-cases, so plain ASCII texts are lowered before.
Each Python worker keeps the ids of up to ``CACHE_WORDS`` words; texts for which the split could differ (information separators) are encoded
whole.

Defined results: a null text counts as empty; an empty document is its end token alone; repeated rows
and equal texts are separate documents; an empty table gives no piece; a null id packs like any other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common

LENGTH = 4096
END_ID = 2
DIMS, BITS, BUCKETS = 4, 12, 4096
CACHE_WORDS = 700_000
#: Bytes of staged tokens in a range of the curve.
RANGE_BYTES = 32 << 20

_ODD = re.compile("[\x1c-\x1f]")
_workers: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str):
    """This worker's tokenizer and its cache of word ids (little-endian unsigned 16 bit)."""
    if path not in _workers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _workers[path] = (Tokenizer.from_file(path), {})
    return _workers[path]


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as unsigned 16 bit integers (end token not included)."""
    tok, cache = _encoder(path)
    split = [(t.lower() if t.isascii() else t).split() if not _ODD.search(t) else None for t in texts]
    fresh = list(set().union(*(ws for ws in split if ws)).difference(cache))
    for i in range(0, len(fresh), 512):
        part = fresh[i : i + 512]
        made = tok.encode(" ".join(part), add_special_tokens=False)
        begin = np.fromiter((a for a, _ in made.offsets), np.int64, len(made.ids))
        stop = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        ids, ends = np.asarray(made.ids, "<u2").tobytes(), 2 * np.append(0, np.searchsorted(begin, stop))
        cache.update(zip(part, map(ids.__getitem__, map(slice, ends[:-1].tolist(), ends[1:].tolist())), strict=True))
    whole = lambda t: np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes()
    out = [whole(t) if ws is None else b"".join(map(cache.__getitem__, ws)) for t, ws in zip(texts, split, strict=True)]
    for w in fresh[max(0, len(fresh) - max(0, len(cache) - CACHE_WORDS)) :]:
        del cache[w]
    return out


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows of ``grid``), by undoing the curve's reflections and
    exchanges bit plane by bit plane (Skilling 2004)."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    table = np.random.default_rng(7).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    ids = np.arange(1 << 16, dtype=np.uint64)
    return table[((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS]


def _keys(parts: list[bytes], table: np.ndarray) -> np.ndarray:
    count = np.array([len(p) // 2 for p in parts])
    full = np.flatnonzero(count)
    mean = np.zeros((len(parts), DIMS))
    if len(full):
        ids = np.frombuffer(b"".join(parts), "<u2")
        at = np.cumsum(count[full]) - count[full]
        for d in range(DIMS):
            mean[full, d] = np.add.reduceat(table[ids, d].astype(np.float64), at) / count[full]
    side = (1 << BITS) - 1
    return hilbert(np.floor((0.5 + 0.5 * np.tanh(mean / 0.15)) * side))


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _projection()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = encode(part.column("text").to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_keys(ids, table)), pa.array(ids, pa.binary())], names=["doc_id", "curve", "ids"])

    return run


class _Packer:
    """Cuts a stream of documents into sequences; ``pieces`` gathers (doc, start, length, crc, doc tokens, sequence, offset)."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.fill, self.open, self.pieces = length, first, 0, [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            take = min(self.length - self.fill, total - start)
            self.open.append((doc, start, ids[start : start + take], total))
            self.fill += take
            start += take
            if self.fill == self.length:
                self._flush()

    def _flush(self) -> None:
        offset = 0
        for doc, start, ids, total in self.open:
            self.pieces.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.open, self.fill = [], 0

    def end(self) -> None:
        """The rest, as sequences whose lengths are powers of two."""
        rest, left = self.open, self.fill
        self.open, self.fill = [], 0
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            while want:
                doc, start, ids, total = rest.pop(0)
                if len(ids) > want:
                    rest.insert(0, (doc, start + want, ids[want:], total))
                    ids = ids[:want]
                self.open.append((doc, start, ids, total))
                want -= len(ids)
            self._flush()


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4")

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.pieces, strict=True)) or [[]] * len(_PIECES)
            packer.pieces = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_PIECES)

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                packer.add(doc, np.concatenate([np.frombuffer(ids.as_buffer(), "<u2").astype("<u4"), end]))
                if len(packer.pieces) > 20_000:
                    yield out()
        packer.end()
        yield out()

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The vocabulary must have fewer than 65,536 ids.  ``sequence_id`` is the partition's number in the
    upper bits and a counter below.
    """
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    tokens = common.stage(rows.mapInArrow(_tokenise(path), "doc_id long, curve long, ids binary"), "pack-tokens")
    order = ["curve", "doc_id"]
    dealt = tokens.repartitionByRange(*common.ranges(tokens, RANGE_BYTES), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return dealt.mapInArrow(_pack(length, end_id), ", ".join(f"`{n}` long" for n in _PIECES.names))
