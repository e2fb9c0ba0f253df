"""The corpus pipeline: toxicity filter, exact and near deduplication, source mix, token counts.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but
the last return the columns of ``docs``; the last returns token ids and digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact, mixing, neighbours, toxicity
from tidemark.llm.common import short_batches
from tidemark.llm.queries import tokenizer_path
from tidemark.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones, does not call toxic."""
    short_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the smallest id."""
    short_batches(spark)
    return neighbours.drop_neighbours(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and digests of ids and decoded text."""
    short_batches(spark)
    return bpe.encode(docs, tokenizer_path()).drop("decoded")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", exact_dedup), ("jaccard_join", drop_near_copies), ("mix_sources", mix_sources), ("tokens", tokens)]

#: Training, rounding and encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
