"""A corpus pipeline of five stages: quality, toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gets all rows that the one before it kept. The first four return the
columns of documents; the last returns each remaining document's token ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import mixing, near_copies, quality_crf, sentencepiece_codec, toxicity
from twinsift.llm.common import shared_folder, table
from twinsift.llm.registry import job, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    return quality_crf.keep_good(docs, quality_crf.learn(docs, table(spark, sf_dir, "labels")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance calls toxic go."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: candidates by SimHash, verified by five-word shingles at a similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts in place of the texts, with the check that they decode to the text."""
    return sentencepiece_codec.encode_texts(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", job(quality)),
    ("toxicity", job(clean)),
    ("simhash near-dedup", job(unique)),
    ("mixing", job(mixture)),
    ("sentencepiece", job(tokens)),
]

#: No SQL expresses the fitted classifiers; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result but the last is written to the shared folder and read again.

    What a stage has read is deleted once its own result is written; the last one's input stays, as its rows are not
    read before the caller asks for them.
    """
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
