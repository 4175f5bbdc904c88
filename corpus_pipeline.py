"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``. An empty table gives an empty one of
the same columns; further columns of ``documents`` travel along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, near_dup, quality, secret_scan
from tidemark.llm.shared import drop_tables, write_table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and perplexity bands keep; null and empty texts go, repeated rows share their fate."""
    return quality.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id, of repeated rows one; without any id that of the least text."""
    return near_dup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret's text replaced and ``n_chars`` counted anew; texts without a secret are untouched, null stays null."""
    return secret_scan.redact_documents(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target; a document's copies are repeated rows. Null is a source; equal ids decide alike."""
    return mixing.mix_documents(docs)


def encode_to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, both digests and the ids of every row; a null text has no ids."""
    return bpe.encode_documents(docs, bpe.read_ranks(public_tokenizers.path(BPE_RANKS)), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", reject_by_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_to_targets),
    ("byte-level BPE encoding and decoding", encode_to_ids),
]

#: Signatures, perplexity and merges are beyond SQL; tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = write_table(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
        drop_tables(docs)  # a stage's rows are read from the written ones from here on
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
