"""Token counts by dynamic programming over a trie of the distinct words.

A word is segmented into vocabulary pieces of highest total score (unigram model, Viterbi forward pass).
All distinct new words of a slice go into one trie, built level by level with numpy: a node stands for a
prefix, so its best score and token count are computed once for all words that share it; a word's count
is read at its terminal node.  Counts of words are kept per task in a sorted table of bounded size and
recomputed when it is full.

Scores: the vocabulary file orders its pieces by merge priority and holds no probabilities, so a piece of
rank r gets the Zipf log-probability -log(r + 1) - log(sum of 1 / (rank + 1)); a character that no piece
covers costs one byte piece per UTF-8 byte, each ``BYTE_PENALTY`` below the least score.  Equal scores
prefer fewer tokens.  Each word carries the word-boundary mark in front; runs of white space are one
boundary.

Defined results: a null or empty text has 0 words and 0 tokens; repeated rows are counted alike; a null
id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common
from sedge.llm.textkit import buffers, mix, slices, word_hashes, words

MARK = "▁"
BYTE_PENALTY = 10.0
KNOWN_WORDS = 2_000_000
#: Longer words are segmented one by one instead of level by level.
LONG = 200
_B = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def scores(path: str) -> dict[str, float]:
    """Score of each ordinary piece of a sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rank = np.arange(len(plain))
    score = -np.log(rank + 1.0) - np.log((1.0 / (rank + 1.0)).sum())
    return {sp.id_to_piece(i): float(s) for i, s in zip(plain, score, strict=True)}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


@cache
def _table(path: str) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(hashes ascending, scores, longest piece, cost of one byte)."""
    s = scores(path)
    keys = np.zeros(len(s), np.uint64)
    for i, p in enumerate(s):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in _codes(p):
                h = h * _B + mix(np.array([c + 1], np.uint64))[0]
        keys[i] = h
    order = np.argsort(keys)
    value = np.fromiter(s.values(), float)
    return keys[order], value[order], max(map(len, s)), float(value.min()) - BYTE_PENALTY


def _utf8_length(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


def _one_word(word: str, path: str) -> int:
    """Plain forward pass of one (long) word."""
    s, (_, _, longest, byte) = scores(path), _table(path)
    text = MARK + word
    best, count = [0.0], [0]
    for d in range(1, len(text) + 1):
        many = len(text[d - 1].encode())
        top = (-np.inf, 0)
        for n in range(1, min(longest, d) + 1):
            value = s.get(text[d - n : d])
            if value is None and n == 1:
                value, tokens = many * byte, many
            elif value is None:
                continue
            else:
                tokens = 1
            got = (best[d - n] + value, -(count[d - n] + tokens))
            top = max(top, got)
        best.append(top[0])
        count.append(-top[1])
    return count[-1]


def _trie_counts(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, path: str) -> np.ndarray:
    """Token counts of words (code point slices of ``flat``), the boundary mark included."""
    keys, value, longest, byte = _table(path)

    def piece(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, value[at], -np.inf)

    out = np.zeros(len(begin), np.int64)
    live = np.arange(len(begin))
    node = np.zeros(len(begin), np.int64)  # this level's node of each live word
    # Per level: hash of the prefix, best score, count and parent of each node.
    levels = [(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    power = [np.uint64(1)]
    depth = 0
    with np.errstate(over="ignore"):
        while len(live):
            char = np.full(len(live), ord(MARK), np.uint32) if not depth else flat[begin[live] + depth - 1]
            own, node = np.unique((node << 21) | char, return_inverse=True)
            parent, code = own >> 21, (own & 0x1FFFFF).astype(np.uint64)
            depth += 1
            h = levels[-1][0][parent] * _B + mix(code + np.uint64(1))
            power.append(power[-1] * _B)
            best, count = np.full(len(own), -np.inf), np.zeros(len(own), np.int64)
            up = parent
            for n in range(1, min(longest, depth) + 1):
                past, best_at, count_at, parent_at = levels[-n]
                gain = piece(h - past[up] * power[n])
                tokens = np.ones(len(own), np.int64)
                if n == 1:
                    miss = gain == -np.inf
                    many = _utf8_length(code)
                    gain, tokens = np.where(miss, many * byte, gain), np.where(miss, many, 1)
                total, sum_tokens = best_at[up] + gain, count_at[up] + tokens
                better = (total > best) | (total == best) & (total > -np.inf) & (sum_tokens < count)
                best, count = np.where(better, total, best), np.where(better, sum_tokens, count)
                up = parent_at[up]
            levels.append((h, best, count, parent))
            if len(levels) > longest:
                levels.pop(0)
                # hashes of dropped levels are never asked for again
            done = length[live] == depth - 1
            out[live[done]] = count[node[done]]
            live, node = live[~done], node[~done]
    return out


class WordCounts:
    """Token counts of words by hash: a sorted table, extended with what each slice brings."""

    def __init__(self, path: str):
        self.path = path
        self.hash = np.zeros(0, np.uint64)
        self.count = np.zeros(0, np.int64)

    def of(self, w, h: np.ndarray) -> np.ndarray:
        """Token count of each word of a slice."""
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        got = np.zeros(len(own), np.int64)
        known = np.zeros(len(own), bool)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
            known = self.hash[at] == own
            got[known] = self.count[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            got[new] = self._count(w, first[new])
            if len(self.hash) + len(new) > KNOWN_WORDS:
                self.hash, self.count = own, got
            else:
                both, n = np.concatenate([self.hash, own[new]]), np.concatenate([self.count, got[new]])
                order = np.argsort(both, kind="stable")
                self.hash, self.count = both[order], n[order]
        return got[back]

    def _count(self, w, at: np.ndarray) -> np.ndarray:
        raw = w.data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
        length = np.array([len(t) for t in texts])
        out = np.zeros(len(texts), np.int64)
        short = np.flatnonzero(length <= LONG)
        if len(short):
            flat = _codes("".join([texts[i] for i in short]))
            n = length[short]
            out[short] = _trie_counts(flat, np.cumsum(n) - n, n, self.path)
        for i in np.flatnonzero(length > LONG):
            out[i] = _one_word(texts[i], self.path)
        return out


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordCounts(path)
        for b in batches:
            off, raw = buffers(b.column("text"))
            for i, j in slices(off, 2 << 20):
                w = words(off, raw, i, j, lower=False)
                n = table.of(w, word_hashes(w)) if len(w.start) else np.zeros(0, np.int64)
                tokens = np.bincount(w.row, weights=n, minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(w.count.astype(np.int64)), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_tokens."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_count_tokens(vocabulary or default_vocabulary()), "doc_id long, n_words long, n_tokens long")
