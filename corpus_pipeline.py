"""The corpus pipeline: quality rules, exact and near deduplication, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; all
but the last return the columns of documents. ``run`` writes every stage's result to the shared
folder and reads it back for the next one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import exact_dedup, fertility, minhash, packing, secret_scan
from quillflow.llm.bpe import vocabulary_path
from quillflow.llm.common import small_batches, stored, table
from quillflow.llm.queries import PIECE_BPE, WORD_BPE


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """The stage, with a bound on the rows that are on their way to Python at a time."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    return fertility.keep_good(docs, vocabulary_path(PIECE_BPE))


@in_small_batches
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest doc_id."""
    return exact_dedup.keep_last(docs)


@in_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles: the least doc_id."""
    return minhash.keep_one(docs)


@in_small_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    path = vocabulary_path(WORD_BPE)
    return secret_scan.redact(docs, secret_scan.train(docs, path), path)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    pieces = packing.pack(docs, vocabulary_path(WORD_BPE))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality_rules", quality_rules), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("secrets", secrets), ("packed", packed)]

# Bands, sketches, forests and tokenizers have no form in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
