"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import os
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, language_id, license_scan, media, mixing, quality_crf, quality_rules, sentencepiece_codec, simhash, toxicity
from .common import table


#: Place of the public SentencePiece model that the queries use, unless TWINSIFT_SENTENCEPIECE names another one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def tokenizer() -> str:
    return os.environ.get("TWINSIFT_SENTENCEPIECE", MODEL)


#: Rows of an Arrow batch in these jobs. Spark bounds batches by 64 MB; texts of this kind need less, and workers live long.
BATCH_ROWS = 1024


def job(f):
    """The job `f` of (spark, …), with small Arrow batches unless the session's owner has said otherwise. Operators leave settings alone."""

    @wraps(f)
    def run(spark: SparkSession, *rest) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if name not in spark.conf.getAll:
            spark.conf.set(name, str(BATCH_ROWS))
        return f(spark, *rest)

    return run


def op3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality_crf.score_quality(docs, quality_crf.learn(docs, table(spark, d, "labels")))


def op10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, d, "labels")))


def op7(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language_id.identify(docs, language_id.learn(docs))


QUERIES = {
    "op1_license_scan": lambda spark, d: license_scan.scan_licenses(table(spark, d, "documents")),
    "op2_chat_format": lambda spark, d: chat_format.digest_chat(chat_format.format_chat(chat_format.planted(table(spark, d, "conversations")))),
    "op3_quality_crf": op3,
    "op4_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op5_mixing": lambda spark, d: mixing.mix_amounts(table(spark, d, "documents")),
    "op6_quality_rules": lambda spark, d: quality_rules.judge(table(spark, d, "documents")),
    "op7_language_id": op7,
    "op8_sentencepiece": lambda spark, d: sentencepiece_codec.code_texts(table(spark, d, "documents"), tokenizer()),
    "op9_media_columns": lambda spark, d: media.media_of_texts(table(spark, d, "documents")),
    "op10_toxicity": op10,
}
QUERIES = {name: job(f) for name, f in QUERIES.items()}

ORACLES: dict[str, str] = {"op1_license_scan": license_scan.sql(), "op2_chat_format": chat_format.SQL, "op5_mixing": mixing.SQL, "op6_quality_rules": quality_rules.SQL}
