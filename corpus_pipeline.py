"""A training-corpus pipeline: language ID, near-duplicate removal, secret removal, source mixing, tokenization.

Each stage takes the documents its predecessor kept and all but the last return
the columns of ``documents``. ``run`` applies them to a folder's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pinweave.llm import bpe, jaccard, langid, mixing, secrets
from pinweave.runtime import Scratch, ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with lang as predicted.

    Texts that are null, empty or without letters go, and so does every document if no
    lang is known to learn from. Repeated rows stay; an empty table gives no rows.
    """
    return langid.keep_identified(docs, Scratch(spark, "pipeline-language"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 or more over five-word shingles, that of the least doc_id.

    Rows without text, words or doc_id are linked with nothing and stay. Of several rows
    of one doc_id one stays. An empty table gives no rows.
    """
    return jaccard.keep_firsts(docs, Scratch(spark, "pipeline-jaccard"), words=5, num=80, den=100)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; null and empty texts and repeated rows stay as they are."""
    ship_package(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources' words meet their target weights.

    A null source is a source of its own; texts without words follow their source's
    rate; rows that are equal in doc_id and text are drawn alike. An empty table gives
    no rows.
    """
    return mixing.emit(docs, Scratch(spark, "pipeline-mix"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with the digests of ids and decoded text; a null text has none."""
    ship_package(spark)
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("tokenization", tokenize),
]

ORACLE_SQL = None  # code lengths and subword merges have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again before the next and dropped after it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
