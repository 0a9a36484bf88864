"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Corpus statistics (all training documents): word counts by 64-bit hash, summed in each task, packed by hash
range and merged in tasks.  The most frequent words (``LISTED`` at most, cut at a count) form a table that
every executor holds; the counts of all other words are joined by hash range, exactly, wherever they are needed.

Model.  log P(word | history) = log P(class | history) + log P(word | class, history).  Frequent words lie
in classes of ``WIDTH`` words; the other listed words in one class per count band, where a word's share is
its count's; what is not listed is the class ``rest``, shared by Good-Turing masses among rare counts and
the unknown word (one type).  Both softmaxes are log-linear in hashed features of the history: previous
word, previous two words, and the word before the previous one (a skip feature).  Histories are hashes of
the words themselves, of whatever frequency.  A feature's row holds one weight per class, or per word of a
class; the tables grow with the training tokens, a row for ``ROW_TOKENS`` of them, up to ``MOST_ROWS``.  In
training a word counts as it would without this occurrence (count - 1), so ``rest`` learns the rate of unseen words.

Training.  The training documents are dealt by hash to ``ROUNDS`` rounds.  In a round every task sums the
gradient of its documents in numpy batches at the current weights; the sums are added by weight block and
groups of ``FAN`` tasks, level by level, and one preconditioned step is taken.  The size of a task follows that
of the weights, so sums stay small beside the text they come from.

Scores are log10 probabilities.  Defined results: a null text counts as empty and is its end token alone;
a null id is in training; repeated rows count and are scored each; without training documents every token
is the unknown word with probability 1; an empty table gives an empty result; a very long text is scored
in the same batches as others.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common
from sedge.llm.textkit import buffers, mix, slices, word_hashes, words

LISTED = 1 << 20
#: Bits of the hash ranges in which words are counted, at most.
MOST_BITS = 16
FLUSH = 1 << 21
WIDTH = 64
FREQUENT_CLASSES = 36
ROUNDS = 4
STEP, DAMP = 0.9, 20.0
#: Rows of the hashed weight tables, in 32nds of all: previous word, previous two, skip; then each of them with the class.
SHARES = (4, 4, 2, 12, 6, 4)
LEAST_ROWS, MOST_ROWS, ROW_TOKENS = 1 << 15, 1 << 19, 2048
BATCH = 1 << 14
#: Blocks of weight rows that are summed apart, tasks whose sums are added at once, and tokens of a task: at least
#: so many, and so many for each row of weights.
BLOCK_ROWS, FAN, TASK_TOKENS, TOKENS_A_ROW = 1024, 32, 1 << 20, 32
#: Counts up to which words are tallied by count; above, by bins, sixteen to an octave.
TALLY = 1000
_BINS = np.unique(np.ceil(TALLY * 2.0 ** (np.arange(16 * 40) / 16)).astype(np.int64))

_U = np.uint64
END = mix(np.array([0xE0D], np.uint64))[0]
START = mix(np.array([0x57A7], np.uint64))[0]


def table_rows(tokens: int) -> np.ndarray:
    """First row of each weight table, and the number of all rows, for so many training tokens."""
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, int(tokens) // ROW_TOKENS).bit_length()))
    return np.cumsum([0, *(s * rows // 32 for s in SHARES)])


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, token hashes with an end per document, tokens per document)."""
    off, raw = buffers(column)
    for i, j in slices(off):
        w = words(off, raw, i, j)
        h = word_hashes(w)
        yield i, j, np.insert(h, np.cumsum(w.count), END), w.count + 1


def _cut(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash ranges present, where each begins in the sorted hashes, and the end)."""
    part = (h >> _U(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return part[first], np.append(first, len(h))


def _count(bits: int):
    return lambda batches: _count_words(batches, bits)


def _count_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held, many, size = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, n = np.concatenate(held), np.concatenate(many)
        own, back = np.unique(h, return_inverse=True)
        return own, np.bincount(back, weights=n).astype(np.int64)

    def out() -> pa.RecordBatch:
        h, n = merged()
        full, edge = _cut(h, bits)
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for x in (h, n))], names=["part", "hashes", "counts"])

    for b in batches:
        for _, _, h, _ in _tokens(b.column("text")):
            own, n = np.unique(h, return_counts=True)
            held.append(own)
            many.append(n)
            size += len(own)
            if size > FLUSH:
                own, n = merged()
                held, many, size = [own], [n], len(own)
                if size > FLUSH // 2:
                    yield out()
                    held, many, size = [], [], 0
    if size:
        yield out()


def _merge(table: pa.Table) -> pa.Table:
    h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")])
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")])
    own, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, weights=n).astype(np.int64)
    low = np.bincount(np.minimum(total, TALLY), minlength=TALLY + 1)
    high = np.bincount(np.searchsorted(_BINS, total[total >= TALLY], side="right"), minlength=len(_BINS) + 1)[1:]
    return pa.table({"part": table.column("part")[:1], "hashes": pa.array([own.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary()), "tokens": pa.array([int(total.sum())]), "types": pa.array([len(own)]), "low": pa.array([[*low.tolist(), *high.tolist()]], pa.list_(pa.int64()))})


def _at_least(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hs, ns in zip(b.column("hashes"), b.column("counts"), strict=True):
                h, n = np.frombuffer(hs.as_buffer(), np.int64), np.frombuffer(ns.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[n >= least]), pa.array(n[n >= least])], names=["h", "n"])

    return run


class Lexicon(NamedTuple):
    """Listed words by rising hash with count, class and place in the class; and what shares out ``rest``."""

    hashes: np.ndarray
    counts: np.ndarray
    group: np.ndarray
    place: np.ndarray
    loo_group: np.ndarray
    group_log: np.ndarray
    tokens: int
    types: int
    least: int
    rest: int
    groups: int
    rest_log: np.ndarray
    rest_tokens: float
    group_tokens: np.ndarray
    word_bias: np.ndarray
    table: np.ndarray
    bits: int

    def rest_share(self, count: np.ndarray) -> np.ndarray:
        """log10 of an unlisted word's share of ``rest``, by its count."""
        far = np.log10(np.maximum(count, 1)) - np.log10(self.rest_tokens)
        return np.where(count < len(self.rest_log), self.rest_log[np.minimum(count, len(self.rest_log) - 1)], far)


def least_listed(low: np.ndarray) -> int:
    """The least count at which all words with it or more are ``LISTED`` at most."""
    room, least = LISTED, int(_BINS[-1])
    for at in range(len(_BINS) - 1, -1, -1):
        room -= int(low[TALLY + 1 + at])
        if room < 0:
            return least
        least = int(_BINS[at])
    for c in range(TALLY - 1, 0, -1):
        room -= int(low[c])
        if room < 0:
            break
        least = c
    return least


def _lexicon(h: np.ndarray, n: np.ndarray, tokens: int, types: int, least: int, low: np.ndarray, bits: int) -> Lexicon:
    frequent = FREQUENT_CLASSES * WIDTH
    top = np.lexsort((h, -n))
    rank = np.empty(len(h), np.int64)
    rank[top] = np.arange(len(h))
    bands = min(int(np.log2(max(2, n.max(initial=1)))) + 1, WIDTH - FREQUENT_CLASSES - 1)
    rest = FREQUENT_CLASSES + bands
    band = lambda c: FREQUENT_CLASSES + np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), bands - 1)
    often = rank < frequent
    group = np.where(often, rank // WIDTH, band(n))
    loo = np.where(often & (n > least), group, np.where(n - 1 >= least, band(n - 1), rest))
    place = np.where(often, rank % WIDTH, -1)
    total = np.bincount(group, weights=n, minlength=rest + 1)
    # Good-Turing: words of count c make (c + 1) * n[c + 1] of fresh text; n[0] is the one unknown type.  Counts
    # from TALLY on are as good as certain and stand for themselves.
    near = min(least, TALLY)
    mass = np.array([(c + 1) * float(low[c + 1] if c + 1 < TALLY else low[c]) + 0.5 for c in range(near)])
    kinds = np.maximum(1.0, np.array([1.0, *low[1:near]]))
    mass = np.where(np.arange(near) > 0, np.where(low[:near] > 0, mass, 0), mass)
    far = max(0.0, float(tokens - int(n.sum()) - (np.arange(near) * low[:near]).sum())) if least > TALLY else 0.0
    rest_tokens = mass.sum() + far
    rest_log = np.log10(np.where(mass > 0, mass, 1) / rest_tokens / kinds)
    target = np.bincount(loo, weights=n, minlength=rest + 1) + 0.5
    target[rest] += max(0, tokens - int(n.sum()))
    bias = np.full((FREQUENT_CLASSES, WIDTH), -60.0, np.float32)
    bias[group[often], place[often]] = np.log(n[often])
    order = np.argsort(h)
    pick = lambda x, kind: x[order].astype(kind)
    return Lexicon(pick(h, np.uint64), pick(n, np.int64 if n.max(initial=0) > 2**31 - 1 else np.int32), pick(group, np.int8), pick(place, np.int8), pick(loo, np.int8), np.log10(np.maximum(total, 1)), tokens, types, least, rest, rest + 1, rest_log, rest_tokens, target, bias, table_rows(tokens), bits)


class Model:
    """Looks words up, forms history features and evaluates or differentiates both softmaxes."""

    def __init__(self, lex: Lexicon, weights: np.ndarray):
        self.lex = lex
        self.class_bias = np.log(lex.group_tokens / lex.group_tokens.sum()).astype(np.float32)
        self.tables = [weights[a:b] for a, b in zip(lex.table[:-1], lex.table[1:], strict=True)]
        self.first, self.second = [t[:, : lex.groups] for t in self.tables[:3]], self.tables[3:]
        # Hashes are spread evenly: the first listed word of each of 2^22 hash ranges, and the end.
        self.start = np.searchsorted(lex.hashes, np.arange(1 << 22, dtype=np.uint64) << _U(42)).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(lex.hashes)))

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Index of each token among the listed words, or -1."""
        out = np.full(len(h), -1, np.int64)
        spot = (h >> _U(42)).astype(np.int64)
        at, end = self.start[spot], self.start[spot + 1]
        rows = np.flatnonzero(at < end)
        while len(rows):
            hit = self.lex.hashes[at[rows]] == h[rows]
            out[rows[hit]] = at[rows[hit]]
            rows = rows[~hit]
            at[rows] += 1
            rows = rows[at[rows] < end[rows]]
        return out

    def histories(self, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes of the three history features of each token (history stops at the document's start)."""
        inside = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        one = np.where(inside >= 1, np.roll(h, 1), START)
        two = np.where(inside >= 2, np.roll(h, 2), START)
        return mix(one), mix(mix(one) + two), mix(two + _U(77))

    def rows(self, which: int, key: np.ndarray) -> np.ndarray:
        size = len(self.tables[which])
        return (key % _U(size)).astype(np.uint16 if size <= 1 << 16 else np.uint32)

    def first_rows(self, history: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return tuple(self.rows(i, x) for i, x in enumerate(history))

    def second_rows(self, group: np.ndarray, history: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        with_class = mix(group.astype(np.uint64) + _U(1)) | _U(1)
        return tuple(self.rows(i + 3, mix(x * with_class)) for i, x in enumerate(history))

    def first_level(self, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(numerators over all classes, their sums)."""
        return _exponents(self.first, rows, self.class_bias)

    def second_level(self, group: np.ndarray, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(numerators over the words of each token's class, their sums)."""
        return _exponents(self.second, rows, self.lex.word_bias[group])


def _exponents(tables: list[np.ndarray], rows: tuple[np.ndarray, ...], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of summed weights.  A step changes a weight by 1.35 at most, so single precision has room
    for them without a maximum being taken out."""
    z = tables[0][rows[0]]
    for t, r in zip(tables[1:], rows[1:], strict=True):
        z += t[r]
    z += bias
    np.exp(z, out=z)
    return z, z.sum(axis=1)


def _errors(z: np.ndarray, sums: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """What was to be predicted minus what was, in place."""
    z *= (-1 / sums)[:, None]
    z[np.arange(len(z)), goal] += 1
    return z


def _log_share(z: np.ndarray, sums: np.ndarray, goal: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(z[np.arange(len(z)), goal] / sums, 1e-30))


#: Occurrences in a batch from which on a row's gradients are summed by themselves.
HOT = 16


def _scatter(total: np.ndarray, seen: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
    """total[rows] += d.  Sorted by row, hot rows are summed one by one and all others together: first
    occurrences, then second ones, and so on."""
    order = np.argsort(rows, kind="stable")
    ranked, d = rows[order], d[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    own, many = ranked[first], np.diff(np.append(first, len(rows)))
    wide = slice(None, d.shape[1])
    for i in np.flatnonzero(many > HOT):
        total[own[i], wide] += d[first[i] : first[i] + many[i]].sum(axis=0)
    few = many <= HOT
    at, left = first[few], many[few]
    sums = d[at]
    for k in range(1, HOT):
        more = np.flatnonzero(left > k)
        if not len(more):
            break
        sums[more] += d[at[more] + k]
    total[own[few], wide] += sums
    seen[own] += many


def _gradient(words_of, weights_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = words_of.value
        model = Model(lex, weights_of.value)
        total = np.zeros((lex.table[-1], WIDTH), np.float32)
        seen = np.zeros(lex.table[-1], np.float32)
        sums = [(total[a:b], seen[a:b]) for a, b in zip(lex.table[:-1], lex.table[1:], strict=True)]
        for b in batches:
            for _, _, h, count in _tokens(b.column("text")):
                at = model.look_up(h)
                history = model.histories(h, count)
                goal = np.where(at >= 0, lex.loo_group[at].astype(np.int64), lex.rest) if len(lex.hashes) else np.full(len(at), lex.rest)
                for lo in range(0, len(at), BATCH):
                    cut = slice(lo, lo + BATCH)
                    own = tuple(x[cut] for x in history)
                    x = model.first_rows(own)
                    d = _errors(*model.first_level(x), goal[cut])
                    for r, into in zip(x, sums[:3], strict=True):
                        _scatter(*into, r, d)
                    often = np.flatnonzero(goal[cut] < FREQUENT_CLASSES)
                    if len(often):
                        g = goal[cut][often]
                        y = model.second_rows(g, tuple(k[often] for k in own))
                        d = _errors(*model.second_level(g, y), lex.place[at[cut][often]])
                        for r, into in zip(y, sums[3:], strict=True):
                            _scatter(*into, r, d)
        mean = _means(total, seen)
        blocks = [i for i in range(0, len(total), BLOCK_ROWS) if seen[i : i + BLOCK_ROWS].any()]
        task = pa.array([TaskContext.get().partitionId() // FAN] * len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK_ROWS for i in blocks], pa.int64()), task, pa.array([mean[i : i + BLOCK_ROWS].tobytes() for i in blocks], pa.binary()), pa.array([seen[i : i + BLOCK_ROWS].tobytes() for i in blocks], pa.binary())], names=["block", "task", "total", "seen"])

    return run


def _means(total: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Gradient per occurrence of a row's feature: within -1 to 1, so half precision is enough to send it."""
    return (total / np.maximum(seen, 1)[:, None]).astype("<f2")


def _sums(mean: bytes, seen: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(seen, np.float32)
    return np.frombuffer(mean, "<f2").reshape(-1, WIDTH).astype(np.float32) * n[:, None], n


_BLOCK = "block long, task long, total binary, seen binary"


def _add_blocks(t: pa.Table) -> pa.Table:
    """Sum of one weight block over the tasks of a group, which joins others of its level next."""
    total = seen = None
    for m, n in zip(t.column("total"), t.column("seen"), strict=True):
        more, many = _sums(m.as_py(), n.as_py())
        total, seen = (more, many) if total is None else (total + more, seen + many)
    task = pa.array([t.column("task")[0].as_py() // FAN], pa.int64())
    return pa.table({"block": t.column("block")[:1], "task": task, "total": pa.array([_means(total, seen).tobytes()], pa.binary()), "seen": pa.array([seen.astype(np.float32).tobytes()], pa.binary())})


def _sum_up(blocks: DataFrame, tasks: int) -> pa.Table:
    """Sums by block over all tasks, ``FAN`` at a time."""
    while True:
        blocks = blocks.groupBy("block", "task").applyInArrow(_add_blocks, _BLOCK)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return blocks.toArrow()


def _step(weights: np.ndarray, lex: Lexicon, blocks: pa.Table) -> np.ndarray:
    """One step: gradient over the expected count of (feature, class), damped."""
    total, seen = np.zeros_like(weights), np.zeros(len(weights), np.float32)
    for block, m, n in zip(blocks.column("block").to_pylist(), blocks.column("total"), blocks.column("seen"), strict=True):
        at = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
        total[at], seen[at] = _sums(m.as_py(), n.as_py())
    prior = np.full((len(weights), WIDTH), 1 / WIDTH, np.float32)
    prior[: lex.table[3], : lex.groups] = lex.group_tokens / lex.group_tokens.sum()
    return (weights + STEP * np.clip(total / (seen[:, None] * prior + DAMP), -1, 1.5)).astype(np.float32)


def _score(words_of, weights_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = words_of.value
        model = Model(lex, weights_of.value)
        floor = np.log10(lex.tokens + 0.1 * (lex.types + 1))
        key = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, j, h, count in _tokens(b.column("text")):
                at = model.look_up(h)
                listed = at >= 0
                doc = np.repeat(np.arange(j - i), count)
                base, value = np.full(len(h), -floor), np.zeros(len(h))
                if len(lex.hashes):
                    base = np.where(listed, np.log10(lex.counts[at] + 0.1) - floor, -floor)
                    history = model.histories(h, count)
                    group = np.where(listed, lex.group[at].astype(np.int64), lex.rest)
                    for lo in range(0, len(at), BATCH):
                        cut = slice(lo, lo + BATCH)
                        own = tuple(x[cut] for x in history)
                        got = _log_share(*model.first_level(model.first_rows(own)), group[cut])
                        often = np.flatnonzero(group[cut] < FREQUENT_CLASSES)
                        share = np.where(listed[cut], np.log10(lex.counts[at[cut]]) - lex.group_log[group[cut]], 0.0)
                        if len(often):
                            g = group[cut][often]
                            share[often] = _log_share(*model.second_level(g, model.second_rows(g, tuple(k[often] for k in own))), lex.place[at[cut][often]])
                        value[cut] = got + share
                keys = key + np.arange(j - i)
                key += j - i
                add = lambda x: np.bincount(doc, weights=x, minlength=j - i)  # noqa: E731,B023
                n = j - i
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n), b.column("held_out").slice(i, n), pa.array(keys), pa.array(count.astype(np.int64)), pa.array(add(listed).astype(np.int64)), pa.array(add(base)), pa.array(add(value)), pa.nulls(n, pa.int64()), none, none], schema=_SCORED)
                away = np.flatnonzero(~listed)
                if len(away) and lex.tokens:
                    away = away[np.argsort(h[away], kind="stable")]
                    full, edge = _cut(h[away], lex.bits)
                    pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())  # noqa: E731,B023
                    void = [pa.nulls(len(full), f.type) for f in list(_SCORED)[:7]]
                    yield pa.RecordBatch.from_arrays([*void, pa.array(full, pa.int64()), pack(h[away]), pack(keys[doc[away]])], schema=_SCORED)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("part", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())])
_SCORED_DDL = "doc_id long, held_out boolean, key long, n_tokens long, n_known long, base_score double, score double, part long, hashes binary, docs binary"


def _rest(words_of):
    """Counts of unlisted words, by hash range: what they add to their documents."""

    def run(tokens: pa.Table, vocabulary: pa.Table) -> pa.Table:
        join = lambda t, c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]) if t.num_rows else np.zeros(0, kind)
        h, docs = join(tokens, "hashes", np.uint64), join(tokens, "docs", np.int64)
        own, n = join(vocabulary, "hashes", np.uint64), join(vocabulary, "counts", np.int64)
        count = np.zeros(len(h), np.int64)
        if len(own):
            at = np.minimum(np.searchsorted(own, h), len(own) - 1)
            count = np.where(own[at] == h, n[at], 0)
        key, back = np.unique(docs, return_inverse=True)
        add = lambda x: np.bincount(back, weights=x, minlength=len(key)).astype(float)
        more = np.log10(count + 0.1)
        return pa.table({"key": pa.array(key), "more_known": pa.array(add(count > 0).astype(np.int64)), "more_base": pa.array(add(more)), "more_score": pa.array(add(words_of.value.rest_share(count)))})

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    doc = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = df.select(doc.alias("doc_id"), held.alias("held_out"), common.text_or_empty(text_col).alias("text"))
    train = docs.where(~F.col("held_out"))
    bits = common.hash_bits(train, MOST_BITS)
    packed = train.select("text").mapInArrow(_count(bits), "part long, hashes binary, counts binary")
    vocabulary = common.stage(packed.groupBy("part").applyInArrow(_merge, "part long, hashes binary, counts binary, tokens long, types long, low array<long>"), "lm-words")
    tallies = TALLY + 1 + len(_BINS)
    tally = vocabulary.select(F.posexplode("low").alias("i", "n")).where("n > 0").groupBy("i").agg(F.sum("n").alias("n"))  # ``tallies`` rows at most
    sums = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tokens, types, low = int(sums[0]), int(sums[1]), np.zeros(tallies, np.int64)
    for r in tally.collect():
        low[r["i"]] = r["n"]
    least = least_listed(low)
    listed = vocabulary.select("hashes", "counts").mapInArrow(_at_least(least), "h long, n long").toArrow()
    lex = _lexicon(listed.column("h").to_numpy().view(np.uint64), listed.column("n").to_numpy(), tokens, types, least, low, bits)
    weights = np.zeros((lex.table[-1], WIDTH), np.float32)
    tasks = max(spark.sparkContext.defaultParallelism, -(-tokens // rounds // max(TASK_TOKENS, TOKENS_A_ROW * len(weights))))
    words_of = spark.sparkContext.broadcast(lex)
    for r in range(rounds if tokens else 0):
        weights_of = spark.sparkContext.broadcast(weights)
        part = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text").coalesce(tasks)
        blocks = _sum_up(part.mapInArrow(_gradient(words_of, weights_of), _BLOCK), tasks)
        if blocks.num_rows:
            weights = _step(weights, lex, blocks)
        weights_of.destroy()
    weights_of = spark.sparkContext.broadcast(weights)
    scored = common.stage(docs.mapInArrow(_score(words_of, weights_of), _SCORED_DDL), "lm-scores")
    weights_of.destroy()
    away = scored.where("part is not null").select("part", "hashes", "docs").groupBy("part")
    more = away.cogroup(vocabulary.select("part", "hashes", "counts").groupBy("part")).applyInArrow(_rest(words_of), "key long, more_known long, more_base double, more_score double")
    more = more.groupBy("key").agg(F.sum("more_known").alias("k"), F.sum("more_base").alias("b"), F.sum("more_score").alias("s"))
    out = scored.where("part is null").join(more, "key", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(tokens).cast("long").alias("train_tokens"), plus("base_score", "b"), plus("score", "s"))
