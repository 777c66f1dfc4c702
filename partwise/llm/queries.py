"""One query for each training-data operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, language, minhash, packing, quality, resampling, sentencepiece_dropout, sharding, spelling, substrings, token_files, urls, warc
from .oracles import ORACLE_SQL

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file: in TOKENIZER_DIR, or where the installed package keeps it."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), dropout=0.1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return told.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=1)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), shards=24)
    return shards.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), width=20)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), every=199, least_letters=6, least_n=5, factor=5)


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece_dropout, op2_warc, op3_quality_rules, op4_language_id, op5_minhash, op6_packing, op7_url_filter, op8_sharding, op9_embedding_dedup, op10_token_files, op11_resampling, op12_substrings, op13_spelling)
}

#: The other queries cannot be written in SQL; tests compare them with brute force.
__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_file"]
