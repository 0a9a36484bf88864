"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import ann, common, exact_dedup, jaccard, lm, merkle, mixing, mtree, packing, phrases, pii, quality, sharding, tokencount


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.documents(spark, sf_dir))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(common.documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(common.documents(spark, sf_dir), k=4, num=85, den=100)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key of ``sedge.pii.key``; without one, under a new key that nobody keeps."""
    key = spark.conf.get("sedge.pii.key", None) or secrets.token_hex(32)
    return pii.replace_entities(common.documents(spark, sf_dir), key)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(common.documents(spark, sf_dir))


def op12_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("computed")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_packing, op4_lm_scores, op5_sharding, op6_quality, op7_nearest_neighbours, op8_token_counts, op9_jaccard_join, op10_pii_surrogates, op11_merkle_manifest, op12_mtree_topk, op13_phrases)
}
