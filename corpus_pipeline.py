"""From documents to packed training sequences: reject toxic texts, keep one of each group of near copies, take out repeated
passages, mix the sources to their target weights, and pack what is left.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of documents. No stage's decisions can be written as one SQL statement over learned models, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstlake.llm import minhash, mixing, packing, suffix, toxicity
from burstlake.llm.common import cut
from burstlake.llm.queries import WORD_BPE


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic; the model learns from the labelled ones among them."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are linked by a similarity of 0.8 or more, the smallest doc_id."""
    return minhash.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 50 words that occur anywhere else as well."""
    return suffix.remove_repeats(docs, words=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have shares in proportion to the root of their size, in random order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in as few sequences as possible; copies are packed each."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
