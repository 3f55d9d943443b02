"""Corpus pipeline over ``documents``: each stage reads all that its predecessor kept.

Language ID -> line dedup -> near-dedup -> mixing sources -> byte-level BPE.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.bpe import encode_documents
from ledgerlark.llm.language_id import UNKNOWN, identify_languages
from ledgerlark.llm.line_templates import line_dedup
from ledgerlark.llm.minhash_dedup import near_dedup
from ledgerlark.llm.queries import label_weights
from ledgerlark.llm.source_mix import mixed_documents
from ledgerlark.session import keep_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Fitted profiles and merge replay cannot be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no letters, null text) go; all others stay.

    Without a labelled document no language is learned; then every text with a letter stays.
    """
    if docs.where("lang is not null").isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return (identify_languages(docs, pred="__lang", score="__score")
            .where(F.col("__lang") != UNKNOWN).select(*docs.columns))


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; every document stays, with its new length."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (5-word shingles, similarity 0.8 or more)."""
    return near_dedup(docs, width=5, percent=80).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources (weights 1, 2, 3, at most three epochs) takes them."""
    return mixed_documents(docs, label_weights(spark, sf_dir)).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                            outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", recurring_lines),
    ("minhash_near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("bpe_encoding", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
