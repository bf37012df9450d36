"""The thin queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, divergence, lm, minhash, mixing, packing, pq_dedup, quality, spelling, suffix, token_counts, toxicity, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # passages of 50 words may be shorter than 400 bytes, so they are counted beside the bytes removed
    return suffix.repeat_digests(_table(spark, sf_dir, "documents"), words=50)


def op5_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op6_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_by_warc(spark, _table(spark, sf_dir, "pages"))


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op11_resynchronised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_divergence_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


ALL = (
    op1_packing, op2_toxicity, op3_multi_index, op4_suffix_dedup, op5_product_quantisation, op6_compression, op7_warc, op8_maxent, op9_mixing, op10_minhash,
    op11_resynchronised_counts, op12_spelling_variants, op13_divergence_cells,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": warc.WARC_SQL, "op9_mixing": mixing.MIX_SQL, "op13_divergence_cells": divergence.AUDIT_SQL}
