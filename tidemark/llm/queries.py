"""The registered queries of this subpackage, one thin function for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, near_dup, pii, quality, secret_scan, token_files, topk, toxicity
from tidemark.llm.shared import id_crc32, read_documents

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_RANKS))
    return bpe.encode_documents(read_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, keep_ids=False)


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "source")
    return secret_scan.scan_documents(docs).withColumnRenamed("id", "doc_id")


def op3_bagminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dup.duplicate_classes(read_documents(spark, sf_dir).select("doc_id", "text"))
    return classes.select(F.col("id").alias("doc_id"), "class_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "source")
    mixed = mixing.with_copies(docs)
    taken = F.col("size") * F.col("copies")
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op5_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = id_crc32("doc_id") % 3 == 1
    return toxicity.score_documents(docs, labels.where(~held_out), held_out=held_out)


def op6_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_TOKENIZER), encoding="utf-8") as f:
        definition = f.read()
    return token_files.token_file_digests(read_documents(spark, sf_dir).select("doc_id", "text"), definition, end_id=END_ID)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return topk.search(vectors, vectors.where("id % 50 = 0"))


def op8_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    found = pii.sanitise_spans(docs)
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", pii.sha256_hex("base").alias("base_sha256"), "spans", "added")


def op9_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = id_crc32("doc_id") % 4 == 2
    return langid.identify(docs, docs.where(~held_out), held_out=held_out)


def op10_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    judged = quality.judge_documents(docs)
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "surprise"
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_secret_ownership, op3_bagminhash_near_dup, op4_source_mixing, op5_gru_toxicity, op6_huffman_token_files, op7_exact_topk, op8_disclosure_pii, op9_rank_order_langid, op10_perplexity_rules)}
