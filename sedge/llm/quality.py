"""Quality classification from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  A pass over all documents
counts the vote patterns (a table bounded by 3 ** labellers); expectation-maximisation on those counts
estimates the labellers' accuracies and the class share without any human label.  Posteriors of a
bounded hash sample (``SAMPLE`` distinct texts at most; copies count once, so that no hot text fills it) then
train a linear scorer over hashed word-form features by Newton steps; the scorer decides on every document.

The scorer generalises what the labellers see: its features are forms of single words (first and last
character classes, case, length, repetition), so a text is judged by all its words.

Defined results: a null text counts as empty; a text without words scores 0 (rejected: nothing to learn
from); repeated rows are judged alike; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common
from sedge.llm.textkit import Words, buffers, mix, slices, word_hashes, words

LABELLERS = ("pipes", "symbols", "bangs", "capitals", "repeats", "variety", "wordlike", "sentences")
SAMPLE = 8000
BUCKETS = 512
STEPS, SHRINK, SCALE = 12, 0.5, 10.0
THRESHOLD = 0.5
EM_STEPS = 60

# Byte classes: 0 other symbol, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 full stop or comma, 6 bar, 7 mark.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[ord("."), ord(",")]] = 5
_CLASS[ord("|")] = 6
_CLASS[[ord("!"), ord("?")]] = 7


class Forms:
    """Word forms of a slice: everything that labellers and scorer look at."""

    def __init__(self, w: Words):
        self.w, n = w, len(w.start)
        self.rows = len(w.count)
        kind = _CLASS[w.data]
        self.length = w.end - w.start
        if not n:
            z = np.zeros(0, np.int64)
            self.first = self.last = self.before = self.lower = self.upper = self.plain = z
            self.repeat = z.astype(bool)
            self.hash = z.astype(np.uint64)
            return
        sums = lambda c: (lambda s: s[w.end] - s[w.start])(np.append(0, np.cumsum(kind == c)))
        self.first, self.last = kind[w.start], kind[w.end - 1]
        self.before = np.where(self.length > 1, kind[np.maximum(w.end - 2, 0)], 8)
        self.lower, self.upper = sums(1), sums(2)
        self.plain = self.lower + self.upper + sums(4) + (self.last == 5)
        self.hash = word_hashes(w)
        self.repeat = np.zeros(n, bool)
        self.repeat[1:] = (self.hash[1:] == self.hash[:-1]) & (w.row[1:] == w.row[:-1])

    def share(self, of: np.ndarray) -> np.ndarray:
        """Share of each row's words for which ``of`` holds."""
        return np.bincount(self.w.row, weights=of, minlength=self.rows) / np.maximum(self.w.count, 1)

    def votes(self) -> np.ndarray:
        """(rows, labellers): 1 good, 0 bad, 2 nothing."""
        n = self.w.count
        own = np.unique(mix(self.hash + mix(self.w.row.astype(np.uint64))), return_index=True)[1] if len(self.hash) else np.zeros(0, np.int64)
        variety = np.bincount(self.w.row[own], minlength=self.rows) / np.maximum(n, 1)
        pipes = self.share((self.first == 6) & (self.length == 1))
        symbols = self.share((self.last == 0) & (self.before == 0))
        bangs = self.share((self.last == 7) & (self.before == 7))
        capitals = self.share((self.upper > 1) & (self.lower == 0))
        repeats, wordlike = self.share(self.repeat), self.share(self.plain == self.length)
        ends = self.share(self.last == 5)
        vote = lambda bad, good: np.where(n == 0, 2, np.where(bad, 0, np.where(good, 1, 2)))
        return np.column_stack([
            vote(pipes > 0.1, pipes < 0.02), vote(symbols > 0.2, symbols < 0.05), vote(bangs > 0.2, bangs < 0.05), vote((capitals > 0.5) & (n > 3), capitals < 0.1),
            vote(repeats > 0.2, repeats < 0.1), vote((variety < 0.35) & (n >= 50), (variety > 0.5) & (n >= 20)), vote(wordlike < 0.6, wordlike > 0.9), vote((ends == 0) & (n >= 60), (ends > 0.01) & (ends < 0.6)),
        ])

    def vectors(self, rows: np.ndarray | None = None) -> np.ndarray:
        """(rows, BUCKETS): shares of hashed word forms, of all rows or of some."""
        many = np.arange(self.rows) if rows is None else rows
        out = np.zeros((len(many), BUCKETS), np.float32)
        place = np.full(self.rows, -1)
        place[many] = np.arange(len(many))
        at = np.flatnonzero(place[self.w.row] >= 0) if rows is not None else slice(None)
        row = place[self.w.row[at]]
        if len(row):
            first, last, before, lower, upper = (x[at] for x in (self.first, self.last, self.before, self.lower, self.upper))
            case = np.where(lower > 0, np.where(upper > 0, 1, 0), np.where(upper > 1, 2, 3))
            form = (((first * 9 + last) * 9 + before) * 4 + case) * 4 + np.minimum(np.log2(self.length[at]).astype(np.int64), 3)
            for code in (form, case * 10 + self.repeat[at] + _SECOND, last * 9 + before + _THIRD):
                out += np.bincount(row * BUCKETS + _BUCKET[code], minlength=out.size).reshape(out.shape)
        return out / np.maximum(self.w.count[many], 1)[:, None]


# Buckets of the three kinds of form codes, each kind from an offset of its own.
_SECOND, _THIRD = 100_000, 200_000
_BUCKET = (mix(np.arange(_THIRD + 100).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Forms]]:
    off, raw = buffers(column)
    for i, j in slices(off):
        yield i, j, Forms(words(off, raw, i, j, lower=False))


_POWERS = 3 ** np.arange(len(LABELLERS))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, f in _slices(b.column("text")):
            pick = np.flatnonzero(b.column("sampled").slice(i, j - i).to_numpy(zero_copy_only=False))
            vectors = f.vectors(pick).astype("<f4")
            sample = np.full(j - i, None, object)
            sample[pick] = [v.tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([pa.array(f.votes() @ _POWERS), pa.array(sample, pa.binary())], names=["pattern", "vector"])


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """P(good) of each vote pattern (rows of ``votes``, seen ``n`` times).

    Each labeller has two accuracies: how often a vote it casts is right on good and on bad documents (a
    labeller for one kind of junk misses the others, so the two differ).  Labellers err independently;
    abstaining says nothing.  Starts from suspicion: a document with a vote for bad is rather bad.
    """
    good, bad = (votes == 1).astype(float), (votes == 0).astype(float)
    p = np.where(bad.sum(axis=1) > 0, 0.2, 0.95)
    for _ in range(steps):
        share = np.clip((p @ n + 8) / (n.sum() + 10), 0.05, 0.95)
        on_good = np.clip(((p * n) @ good + 1) / ((p * n) @ (good + bad) + 1.1), 0.5, 0.999)
        on_bad = np.clip((((1 - p) * n) @ bad + 0.1) / (((1 - p) * n) @ (good + bad) + 1), 0.01, 0.999)
        z = np.log(share / (1 - share)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
        p = 1 / (1 + np.exp(-z))
    return p


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic weights (last: bias) on shares, by Newton's method."""
    x = np.column_stack([x * SCALE, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], SHRINK)
    shrink[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink)
        w = w + np.clip(np.linalg.solve(curve, x.T @ (y - p) - shrink * w), -4, 4)
    return w


def _probability(f: Forms, w: np.ndarray) -> np.ndarray:
    z = f.vectors() @ (w[:-1] * SCALE) + w[-1]
    return np.where(f.w.count > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0).astype(float)


def _judge(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, f in _slices(b.column("text")):
                p = _probability(f, w)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(p), pa.array(p >= THRESHOLD), pa.array(f.votes() @ _POWERS)], names=["doc_id", "score", "kept", "pattern"])

    return run


def _keep(w: np.ndarray, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = [_probability(f, w) >= THRESHOLD for _, _, f in _slices(b.column(text_at))]
                yield b.filter(pa.array(np.concatenate(keep)))

    return run


def fit(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vote patterns, their P(good), the scorer's weights) learnt from ``df``."""
    docs = df.select(common.text_or_empty(text_col).alias("text"))
    every = max(1, -(-5 * docs.count() // (4 * sample)))
    votes = docs.select("text", (F.pmod(F.xxhash64("text"), F.lit(every)) == 0).alias("sampled")).mapInArrow(_vote, "pattern long, vector binary")
    votes = common.stage(votes, "quality-votes")
    patterns = votes.groupBy("pattern").count().orderBy("pattern").toArrow()  # 3 ** labellers rows at most
    code, n = patterns.column("pattern").to_numpy(), patterns.column("count").to_numpy().astype(float)
    p = expectation_maximisation(code[:, None] // _POWERS % 3, n) if len(code) else np.zeros(0)
    part = votes.where("vector is not null").distinct().orderBy(F.xxhash64("vector"), "vector", "pattern").limit(sample).toArrow()
    x = np.array([np.frombuffer(v.as_buffer(), "<f4") for v in part.column("vector")]).reshape(-1, BUCKETS)
    y = p[np.searchsorted(code, part.column("pattern").to_numpy())] if len(x) else np.zeros(0)
    return code, p, train(x, y) if len(x) else np.zeros(BUCKETS + 1)


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``df``: doc_id, score, kept, label_probability (of the weak label)."""
    code, p, w = fit(df, text_col, sample)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    judged = docs.mapInArrow(_judge(w), "doc_id long, score double, kept boolean, pattern long")
    known = df.sparkSession.createDataFrame([(int(c), float(v)) for c, v in zip(code, p, strict=True)], "pattern long, label_probability double")
    return judged.join(F.broadcast(known), "pattern", "left").select("doc_id", "score", "kept", "label_probability")


def keep_good(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``df`` that the classifier keeps, all columns unchanged."""
    _, _, w = fit(df, text_col, sample)
    return df.mapInArrow(_keep(w, df.columns.index(text_col)), df.schema)
