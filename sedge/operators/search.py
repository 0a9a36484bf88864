"""Keyword (BM25), vector (cosine), typeahead and hybrid search as single plans.

Keyword search runs on documents directly or on a stored postings table, which makes a query a pruned read
of its terms.  Corpus statistics are one row, so joining them broadcasts one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.text import search_tokens

# Ranking and fusion constants.
K1, B = 1.2, 0.75
RRF_K = 60
BRANCH_LIMIT = 50
DIGITS = 6


def query_terms(text: str) -> list[str]:
    """Distinct lower-case runs of letters and digits."""
    import regex

    return list(dict.fromkeys(t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, length: one row per distinct term of a document."""
    tokens = docs.select(F.col(key), search_tokens(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens"))
    return tokens.select(key, "length", F.explode("tokens").alias("term")).groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """n and avg_length: one row."""
    length = F.size(search_tokens(F.col(text)))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avg_length"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def _begins(term: str):
    return lambda x: x.startswith(term)


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", prefix_last: bool = False) -> DataFrame:
    """(key, score) of the documents that match; with ``prefix_last`` the last term matches as a prefix.

    Documents are tokenised once: what is left of each (a few numbers) goes through one exchange that both
    the statistics and the scores read.  So the condition on a match is put on the score, which needs the
    statistics, where it cannot be pushed below that exchange.
    """
    terms = query_terms(query)
    whole, prefix = (terms[:-1], terms[-1:]) if prefix_last else (terms, [])
    hits = [_equals(t) for t in whole] + [_begins(t) for t in prefix]
    if not hits:
        return docs.select(key, F.lit(0.0).alias("score")).where("false")
    base = docs.select(F.col(key), search_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    seen = base.select(key, F.size("tokens").alias("length"), *[F.size(F.filter("tokens", h)).alias(f"tf{i}") for i, h in enumerate(hits)]).repartition(key)
    stats = seen.agg(F.count(key).alias("n"), F.avg("length").alias("avg_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(hits))])
    found = seen.crossJoin(F.broadcast(stats))  # stats: one row
    norm = K1 * (1 - B + B * F.col("length") / F.col("avg_length"))
    score = sum((idf(F.col("n"), F.col(f"df{i}")) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(hits))), F.lit(0.0))
    return found.select(key, score.alias("score")).where("score > 0").select(key, F.round("score", DIGITS).alias("score"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """n and avg_length of stored lengths: one row."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))


def bm25_postings(index: DataFrame, stats: DataFrame, query: str, key: str = "doc_id", prefix_last: bool = False) -> DataFrame:
    """The same scores from a postings table: the filter on ``term`` reaches its reader, as equality or as
    a range of terms with the prefix."""
    terms = query_terms(query)
    whole, prefix = (terms[:-1], terms[-1:]) if prefix_last else (terms, [])
    named = F.col("term").isin(*whole) if whole else F.lit(False)
    begins = F.col("term").startswith(prefix[0]) if prefix else F.lit(False)
    hit = index.where(named | begins) if terms else index.where("false")
    hit = hit.withColumn("hit", F.explode(F.array_compact(F.array(F.when(named, F.col("term")), F.when(begins, F.lit("")))))) if prefix else hit.withColumn("hit", F.col("term"))
    hit = hit.groupBy(key, "hit", "length").agg(F.sum("tf").alias("tf"))  # terms under one prefix are one term
    freq = hit.groupBy("hit").agg(F.count(F.lit(1)).alias("df"))  # a row per query term
    joined = hit.join(F.broadcast(freq), "hit").crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("length") / F.col("avg_length"))
    return joined.groupBy(key).agg(F.round(F.sum(idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)), DIGITS).alias("score"))


def top(scored: DataFrame, key: str, limit: int, offset: int = 0, sort: Sequence[Column] = ()) -> DataFrame:
    ordered = scored.orderBy(*sort, F.desc("score"), F.asc(key))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a constant query vector; 0 where either has no length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = F.sqrt(square) * float(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when(size > 0, dot / size).otherwise(0.0)


def vector_search(df: DataFrame, query: Sequence[float], key: str, vector: str) -> DataFrame:
    """(key, score) with score (1 + cosine) / 2; rows without a vector or of another length are left out."""
    usable = df.where(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    return usable.select(key, F.round((1 + cosine(F.col(vector), query)) / 2, DIGITS).alias("score"))


def ranked(hits: DataFrame, order: Sequence[Column], limit: int = BRANCH_LIMIT) -> DataFrame:
    """Adds the 0-based ``rank`` of a branch cut to ``limit`` rows."""
    cut = hits.orderBy(*order).limit(limit)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def collapse(hits: DataFrame, key: str) -> DataFrame:
    """First hit per key: its rank and its score; rows without key go, but kept their rank."""
    return hits.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))


def _branches(keyword: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    kw = collapse(keyword, key).select(key, F.col("rank").alias("kw_rank"), F.col("score").alias("kw_score"))
    vec = collapse(vector, key).select(key, F.col("rank").alias("vec_rank"), F.col("score").alias("vec_score"))
    return kw.join(vec, key, "full_outer")


def _fused(joined: DataFrame, key: str, score: Column, limit: int) -> DataFrame:
    out = joined.withColumn("score", F.round(score, 12))
    return out.orderBy(F.desc("score"), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), key).limit(limit).select(key, "score", "kw_rank", "vec_rank")


def fuse_rrf(keyword: DataFrame, vector: DataFrame, key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked branches."""
    part = lambda r: F.coalesce(1.0 / (k + 1.0 + F.col(r)), F.lit(0.0))
    return _fused(_branches(keyword, vector, key), key, part("kw_rank") + part("vec_rank"), limit)


def fuse_weighted(keyword: DataFrame, vector: DataFrame, key: str, limit: int, weights: tuple[float, float]) -> DataFrame:
    """Weighted fusion; a component without a usable score falls back to 1 / (1 + rank)."""

    def part(name: str) -> Column:
        s = F.col(f"{name}_score")
        return F.coalesce(F.when((s >= 0) & ~F.isnan(s) & (s != float("inf")), s), 1.0 / (1.0 + F.col(f"{name}_rank")), F.lit(0.0))

    return _fused(_branches(keyword, vector, key), key, weights[0] * part("kw") + weights[1] * part("vec"), limit)


def squash(score: Column) -> Column:
    """An unbounded score to 0..1, so that both branches of a weighted fusion share a range."""
    return score / (score + 1)
