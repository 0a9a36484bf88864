"""Phrase mining against a count of every n-gram."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedge.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            total[lang] += len(ws)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        found = []
        for g, a in frequent.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            longer = [m for h, m in frequent.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not any(100 * m >= 80 * a for m in longer):
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "x", "\x00", "é", "漢字", "new", "york", "times", "a\x1cb"] + [f"w{i}" for i in range(25)]
    weights = [20, 5, 12, 9, 3, 3, 3, 4, 4, 4, 2] + [1] * 25
    rows = []
    for _ in range(120):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "? "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [("New York Times of the x. " * 9, "en")] * 4
    return [*rows, (None, "en"), ("", None), (" \t", "en"), ("the " * 3000, "en"), ("...,,,", "xx"), ("one", "yy")]


@pytest.mark.parametrize(("least", "listed", "top"), [(3, 1 << 20, 2000), (3, 4, 2000), (2, 1, 7)])
def test_collocations(spark, least, listed, top):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DDL).repartition(3)
    found = phrases.collocations(docs, least=least, listed=listed, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, least, top)


def test_split_pivots(spark):
    """A pivot dealt over several partitions is counted whole."""
    order = phrases.Order.of(pa.table({"lang": ["en", "en"], "word": ["a", "b"], "f": [5 * phrases.SPLIT, 9]}), True)
    where = {h: i for i, h in enumerate(order.hashes)}
    code = phrases._lang_word(pa.array(["en", "en", "de"]), pa.array(["a", "b", "a"]))
    place, splits = order.find(code)
    assert place.tolist() == [0, 1, -1] and splits.tolist() == [6, 1, 1] and len(where) == 2
    rows = [("a b a b b a a", "en")] * 40 + [("a b a", "en")] * 30
    docs = spark.createDataFrame(rows, "text string, lang string")
    words = phrases.common.stage(phrases.word_counts(docs).withColumn("f", F.col("f") + F.lit(6 * phrases.SPLIT)), "words")
    got = {(r.lang, r.phrase): r.f for r in phrases.phrase_counts(docs, words).collect()}
    plain = Counter()
    for text, lang in rows:
        ws = text.split()
        plain.update((lang, " ".join(ws[i : i + k])) for k in (2, 3, 4) for i in range(len(ws) - k + 1))
    assert got == {k: n for k, n in plain.items() if n >= 30}


@pytest.mark.parametrize("most", [1, 3, 10, 1000])
def test_routes_are_mined_whole_or_in_pieces(most):
    """Whatever is held at once, the sums over all that leaves are the counts of what occurs often enough."""
    rng = random.Random(6)
    rows = sorted((rng.choice([1, 2, 2, 2, 2, 3, 9]), "en", rng.randint(0, 2), " ".join(rng.choices("abc", k=rng.randint(3, 4))), rng.randint(1, 3), False) for _ in range(60))
    rows = [(r, g, s, w, f, r == 3) for r, g, s, w, f, _ in rows]
    t = pa.table(dict(zip(("route", "lang", "skip", "words", "f", "split"), map(list, zip(*rows, strict=True)), strict=True)))
    got = Counter()
    for b in phrases._mine_routes(4, 5, most)(iter(t.to_batches(max_chunksize=4))):
        for r in b.to_pylist():
            got[r["phrase"]] += r["f"]
    want, by_route = Counter(), Counter()
    for route, _, skip, words, f, _ in rows:
        ws = words.split()
        for a in range(skip + 1):
            for z in range(skip, len(ws)):
                if 2 <= z - a + 1 <= 4:
                    by_route[route, " ".join(ws[a : z + 1])] += f
    for (_, phrase), f in by_route.items():
        want[phrase] += f
    sure = {p: f for p, f in want.items() if all(n >= 5 for (_, q), n in by_route.items() if q == p)}
    assert all(got[p] == f for p, f in sure.items()) and all(got[p] <= want[p] for p in got)


def test_every_occurrence_has_one_owner():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 60))
        place, piece = rng.integers(-1, 4, n).astype(np.int32), np.sort(rng.integers(0, 4, n)).astype(np.int32)
        left, right = phrases._reach(place, piece, 4)
        owned = Counter((i - a, i + b) for i in range(n) for a in range(left[i] + 1) for b in range(right[i] + 1) if 1 <= a + b <= 3)
        want = Counter((i, j) for i in range(n) for j in range(i + 1, min(n, i + 4)) if piece[i] == piece[j] and (place[i : j + 1] >= 0).all())
        assert owned == want


def test_long_texts_are_cut_between_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice(["ab ", "c ", "Ü ", "d. ", "e\n"]) for _ in range(3000))
    column = pa.array([text, "x y", None, "no end here " * 400, "z."])
    words = lambda most: [(int(r), w) for s in phrases.slices(column, most) for r, w in zip(s.row, s.words.take(pa.array(s.code)).to_pylist(), strict=True)]
    assert words(256) == words(1 << 20)

    def runs(most):
        out, last = [], None
        for s in phrases.slices(column, most):
            for r, p, w in zip(s.row, s.piece, s.words.take(pa.array(s.code)).to_pylist(), strict=True):
                key = (id(s), r, p)
                out, last = ([*out, [w]], key) if key != last else ([*out[:-1], [*out[-1], w]], last)
        return out

    assert runs(512) == runs(1 << 20)


def test_awkward_tables(spark):
    empty = phrases.collocations(spark.createDataFrame([], DDL))
    assert empty.count() == 0
    rows = [(None, "big cat", None, "q", "r")] * 31 + [(1, None, None, None, None)]
    out = phrases.collocations(spark.createDataFrame(rows, "doc_id long, Text string, lang string, word string, f string"))
    assert [tuple(r) for r in out.collect()] == [("und", 1, "big cat", 31, 31, 31, 62, 1_000_000)]


def test_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(4 * 10**13 + 1, 10**14 + 7, 3 * 10**14)], "a long, l long, r long").select(phrases._score("a", "l", "r")).first()[0]
    assert row == 2_000_000 * (4 * 10**13 + 1) // (4 * 10**14 + 7)
