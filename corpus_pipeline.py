"""Corpus pipeline: quality, toxicity, line dedup, SimHash near-dedup, packing.

Every stage reads what the stage before it wrote.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.llm import line_dedup, packing, quality, simhash, toxicity
from rubricon.llm.common import table
from rubricon.llm.queries import WORD_VOCABULARY
from rubricon.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.keep_ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out()))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that occurred earlier; a document of which nothing is left goes."""
    left = line_dedup.dedup_lines(docs)
    deleted, remain = left.columns[-2:]                     # under other names where the documents have such columns
    left = left.where(F.col(remain).isNull() | (F.col(remain) > 0))
    return left.withColumn("n_chars", F.when(F.col(deleted) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, shingle_words=3, max_bits=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, WORD_VOCABULARY).drop("ids")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("line_dedup", line_stage), ("simhash", simhash_stage),
          ("packing", packing_stage)]

#: Trained models and tokenizers are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
