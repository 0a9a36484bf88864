"""Phrase collocation mining by pivot partitioning.

1. Words.  One pass counts the words of each language; those of at least ``least`` occurrences can be in a phrase.
2. Rewriting.  Every word has an order: its place by falling count in a table of the ``LISTED`` most frequent words,
   all others behind them.  An occurrence of an n-gram belongs to its rarest word, the
   leftmost of those of the largest order - its pivot.  So each word of a text sends what can lie beside it in the n-grams
   that it owns: up to ``longest - 1`` words to the left, all of smaller order, and to the right, of no larger order.  Words
   below ``least`` end a fragment.  Equal fragments of a batch are one row with a count.
3. Mining.  Fragments go to their pivot's partition, where the n-grams around the pivot are counted; other partitions never
   see these n-grams, and only those of ``least`` occurrences leave it.  A pivot of more than ``SPLIT`` occurrences is dealt over
   several partitions by its fragments; its n-grams leave with the counts that they have and are added up.
4. Scores come from joins of the counted phrases with each other: a cut's two parts are themselves counted phrases or words.

Fragments of frequent pivots consist of even more frequent words, so there are few distinct ones, which the counts of the batches
fold together; fragments of rare pivots are as many as these occur.  The order only decides who counts an n-gram: words of equal
order, whether by a clash of hashes or for want of a place in the table, still give every occurrence exactly one owner.

Bounded: the table of words on the executors (``LISTED`` entries of 20 bytes), a slice of text or ``MINED`` fragments in a task (more
are counted in pieces), ``top`` rows of each salted part of a language in the final ranking.

Defined results: null and empty texts have no words; a null language counts as ``und``; repeated rows count each time, whatever
their ids; ties of scores rank by count and then by the phrase's bytes; an empty table has no phrases; texts of any
length are cut between pieces, where no phrase can lie; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common, textkit

LEAST = 30
LONGEST = 4
TOP = 2000
#: Longer candidates from this percentage of a phrase's count on take its place.
COVER = 80
#: Words of the table on the executors; occurrences of a pivot from which its fragments are dealt over several partitions.
LISTED = 1 << 20
SPLIT = 1 << 18
#: Fragments that are mined at once, or those of one route if these are more.
MINED = 1 << 18
#: Bytes of text that are worked on at once.
SLICE = 4 << 20
#: Parts of a language whose first rows are ranked before the language's are.
SALTS = 64

_KIND = np.zeros(256, np.uint8)  # 0 belongs to a word, 1 is blank, 2 ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Slice(NamedTuple):
    """Words of a slice of text as numbers into ``words``; ``piece`` differs between pieces and rows."""

    words: pa.Array
    code: np.ndarray
    row: np.ndarray
    piece: np.ndarray


def _ends(kind: np.ndarray, begin: int, most: int) -> Iterator[int]:
    """Where to cut one long text: behind the last end of a piece in each ``most`` bytes, or the next there is."""
    at, n = begin, begin + len(kind)
    while n - at > most:
        stops = np.flatnonzero(kind[at - begin : at - begin + most] == 2)
        if not len(stops):
            later = np.flatnonzero(kind[at - begin + most :] == 2)
            if not len(later):
                break
            at += most + int(later[0]) + 1
        else:
            at += int(stops[-1]) + 1
        yield at
    yield n


def slices(column: pa.Array, most: int = SLICE) -> Iterator[Slice]:
    """The words of a column of texts, lower-cased in A-Z."""
    offsets, raw = textkit.buffers(column)
    for i, j in textkit.slices(offsets, most):
        if j - i == 1 and offsets[j] - offsets[i] > 2 * most:
            at = int(offsets[i])
            for end in _ends(_KIND[raw[at : offsets[j]]], at, most):
                yield _words(raw[at:end], np.array([0, end - at]), i)
                at = end
        elif offsets[j] > offsets[i]:
            yield _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)


def _words(data: np.ndarray, bounds: np.ndarray, first_row: int) -> Slice:
    n = len(data)
    kind = _KIND[data]
    ink = kind == 0
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begin, stop = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:n]
    stop[:-1] &= ~ink[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    row = np.searchsorted(bounds, start, side="right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[start] + row.astype(np.int32)
    lowered = data[ink]
    lowered = np.where((lowered - np.uint8(65)) < 26, lowered + np.uint8(32), lowered)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(end - start, dtype=np.int32)])
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(lowered)).dictionary_encode()
    return Slice(found.dictionary, found.indices.to_numpy(zero_copy_only=False), row + first_row, piece)


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    found = column.fill_null("und").dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of each slice."""
    for b in batches:
        names, lang = _languages(b.column("lang"))
        for s in slices(b.column("text")):
            found = pc.value_counts(pa.array(lang[s.row] * len(s.words) + s.code))
            pair, many = found.field("values").to_numpy(), found.field("counts")
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(pair // max(1, len(s.words)))), s.words.take(pa.array(pair % max(1, len(s.words)))), many.cast(pa.int64())], names=["lang", "word", "f"])


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string's bytes."""
    offsets, raw = textkit.buffers(words)
    base = int(offsets[0])
    own = textkit.Words(raw[base:], offsets[:-1] - base, offsets[1:] - base, np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = np.zeros(len(words), np.uint64)
    some = own.end > own.start
    out[some] = textkit.word_hashes(own._replace(start=own.start[some], end=own.end[some]))
    return out


def _lang_word(langs: pa.Array, words: pa.Array) -> np.ndarray:
    return textkit.mix(_hashes(words) + textkit.mix(_hashes(langs)))


class Order(NamedTuple):
    """Sorted hashes of (language, word), their places by falling count, their splits; ``whole`` says that no word of
    enough occurrences is left out."""

    hashes: np.ndarray
    place: np.ndarray
    splits: np.ndarray
    whole: bool

    @classmethod
    def of(cls, table: pa.Table, whole: bool) -> Order:
        """From (lang, word, f) by falling f."""
        code = _lang_word(*(table.column(c).combine_chunks() for c in ("lang", "word"))) if table.num_rows else np.zeros(0, np.uint64)
        by = np.argsort(code, kind="stable")
        splits = 1 + table.column("f").to_numpy() // SPLIT
        return cls(code[by], by.astype(np.int32), np.minimum(splits, 1 << 20)[by].astype(np.int32), whole)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, splits) of words by hash; place -1 for words too rare for any phrase."""
        absent = np.int32(-1 if self.whole else len(self.hashes))
        if not len(self.hashes):
            return np.full(len(code), absent), np.ones(len(code), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, code), len(self.hashes) - 1)
        known = self.hashes[at] == code
        return np.where(known, self.place[at], absent), np.where(known, self.splits[at], np.int32(1))


def _reach(place: np.ndarray, piece: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and right of each belong to its fragment."""
    n = len(place)
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    go_left, go_right = place >= 0, place >= 0
    for d in range(1, min(longest, n)):
        a, b = place[:-d], place[d:]
        near = (piece[:-d] == piece[d:]) & (a >= 0) & (b >= 0)
        go_left[:d] = False
        go_left[d:] &= near & (a < b)
        go_right[n - d :] = False
        go_right[: n - d] &= near & (b <= a)
        left += go_left
        right += go_right
    return left, right


def _fragments(s: Slice, names: list[str], lang: np.ndarray, order: Order, longest: int) -> pa.RecordBatch:
    """Distinct fragments of a slice: route (a hash of language and pivot, and of more where the pivot is split), lang, skip
    (words before the pivot), words (with blanks between), f, split."""
    wide = len(s.words)
    own = lang[s.row]
    found = pa.array(own * wide + s.code).dictionary_encode()
    pair, back = found.dictionary.to_numpy(), found.indices.to_numpy()
    langs, words = pa.array(names).take(pa.array(pair // wide)), s.words.take(pa.array(pair % wide))
    code = _lang_word(langs, words)
    place, splits = order.find(code)
    left, right = _reach(place[back], s.piece, longest)
    at = np.flatnonzero((left > 0) | (right > 0))
    keys = []
    for d in range(1 - longest, longest):  # the words of the fragment, -1 where it has none
        inside = (-left[at] <= d) & (right[at] >= d)
        spot = np.clip(at + d, 0, len(s.code) - 1)
        keys.append(pa.array(np.where(inside, s.code[spot], -1).astype(np.int32)))
    columns = [f"k{i}" for i in range(len(keys))]
    grouped = pa.table([pa.array(back[at].astype(np.int32)), *keys], names=["pair", *columns]).group_by(["pair", *columns], use_threads=False).aggregate([([], "count_all")])
    held = [grouped.column(k).combine_chunks() for k in columns]
    parts = [s.words.take(pc.if_else(pc.greater_equal(c, 0), c, None)) for c in held]
    joined = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
    pivot = grouped.column("pair").to_numpy()
    skip = sum((c.to_numpy() >= 0).astype(np.int32) for c in held[: longest - 1])
    route, many = code[pivot], splits[pivot]
    split = np.flatnonzero(many > 1)
    if len(split):
        route[split] = textkit.mix(route[split] + _hashes(joined.take(pa.array(split))) % many[split].astype(np.uint64) + np.uint64(1))
    return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), langs.take(pa.array(pivot)), pa.array(skip), joined, grouped.column("count_all").combine_chunks(), pa.array(many > 1)], names=["route", "lang", "skip", "words", "f", "split"])


_FRAGMENTS = "route long, lang string, skip int, words string, f long, split boolean"


def _rewrite(order_of, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = order_of.value
        for b in batches:
            names, lang = _languages(b.column("lang"))
            for s in slices(b.column("text")):
                if len(s.code):
                    yield _fragments(s, names, lang, order, longest)

    return run


def _mine(t: pa.Table, longest: int, least: int) -> pa.Table:
    """lang, phrase, f of the n-grams around the pivots of fragments, those of ``least`` occurrences at least."""
    parts = pc.split_pattern(t.column("words").combine_chunks(), " ")
    offset = parts.offsets.to_numpy()
    words = parts.flatten().dictionary_encode()
    code = words.indices.to_numpy()
    langs = t.column("lang").combine_chunks().dictionary_encode()
    lang, skip, f = langs.indices.to_numpy(), t.column("skip").to_numpy(), t.column("f").to_numpy()
    begin, size = offset[:-1], np.diff(offset)
    out = []
    for length in range(2, longest + 1):
        rows, starts = [], []
        for i in range(length):  # words before the pivot
            fits = np.flatnonzero((skip >= i) & (size - skip >= length - i))
            rows.append(fits)
            starts.append(begin[fits] + skip[fits] - i)
        row, start = np.concatenate(rows), np.concatenate(starts)
        if not len(row):
            continue
        columns = [f"w{i}" for i in range(length)]
        grams = pa.table([pa.array(lang[row]), *(pa.array(code[start + i]) for i in range(length)), pa.array(f[row])], names=["lang", *columns, "f"])
        counted = grams.group_by(["lang", *columns], use_threads=False).aggregate([("f", "sum")])
        counted = counted.filter(pc.greater_equal(counted.column("f_sum"), least))
        phrase = pc.binary_join_element_wise(*(words.dictionary.take(counted.column(c).combine_chunks()) for c in columns), " ")
        out.append(pa.table([langs.dictionary.take(counted.column("lang").combine_chunks()), phrase, counted.column("f_sum")], names=["lang", "phrase", "f"]))
    return pa.concat_tables(out) if out else pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "f": pa.array([], pa.int64())})


def _mine_routes(longest: int, least: int, most: int = MINED):
    """Fragments sorted by route: whole routes are mined together, ``most`` fragments or somewhat more at once; what is
    mined in pieces, or of a split pivot, keeps all its counts, to be added up."""

    def mined(t: pa.Table, begun: int | None) -> Iterator[pa.RecordBatch]:
        part = t.column("split")
        if begun is not None:  # of this route some fragments have been counted before
            part = pc.or_(part, pc.equal(t.column("route"), begun))
        for rows, floor in ((t.filter(pc.invert(part)), least), (t.filter(part), 1)):
            if rows.num_rows:
                yield from _mine(rows, longest, floor).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, begun = [], 0, None
        for b in batches:
            held.append(b)
            many += b.num_rows
            if many < most:
                continue
            t = pa.Table.from_batches(held)
            route = t.column("route").to_numpy()
            last = int(np.searchsorted(route, route[-1]))  # the last route may go on
            if last:
                yield from mined(t.slice(0, last), begun)
                begun, held, many = None, t.slice(last).to_batches(), t.num_rows - last
            else:
                begun, held, many = int(route[0]), [], 0
                yield from mined(t, begun)
        if many:
            yield from mined(pa.Table.from_batches(held), begun)

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of (lang, text)."""
    return docs.mapInArrow(_count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, listed: int = LISTED) -> DataFrame:
    """lang, phrase, f of the phrases of 2 to ``longest`` words with at least ``least`` occurrences; ``words`` is staged."""
    frequent = words.where(F.col("f") >= least)
    first = frequent.orderBy(F.desc("f"), "lang", "word").limit(listed).toArrow()  # LISTED rows
    order = docs.sparkSession.sparkContext.broadcast(Order.of(first, first.num_rows < listed))
    fragments = docs.mapInArrow(_rewrite(order, longest), _FRAGMENTS)
    mined = fragments.repartition("route").sortWithinPartitions("route").mapInArrow(_mine_routes(longest, least), "lang string, phrase string, f long")
    return mined.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _score(a: str, left: str, right: str) -> Column:
    wide = "decimal(20,0)"
    return F.expr(f"(cast(2000000 as {wide}) * cast({a} as {wide})) div (cast({left} as {wide}) + cast({right} as {wide}))")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER, listed: int = LISTED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by the score of their loosest cut,
    without those that a longer phrase covers."""
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = common.stage(word_counts(docs), "phrase-words")
    grams = common.stage(phrase_counts(docs, words, least, longest, listed), "phrase-grams")
    known = grams.unionByName(words.where(F.col("f") >= least).withColumnRenamed("word", "phrase"))
    tokens = F.split("phrase", " ")
    part = lambda begin, length: F.array_join(F.slice(tokens, begin, length), " ")
    cuts = grams.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(tokens) - 1)).alias("k"))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size(tokens)).alias("rest"))
    for name, of in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(of), F.col("f").alias(name)), ["lang", of])
    loosest = cuts.withColumn("score", _score("a", "l", "r")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    # What each longer candidate covers: its shorter runs of words.
    size = F.size(tokens)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda i: F.array_join(F.slice(tokens, i, w), " "))))
    covered = grams.where(size > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = loosest.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First inside parts of a language, so that no task ranks a whole one.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = free.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
