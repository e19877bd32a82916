"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, conversations, fingerprint, langid, mixing, quality, resample, secrets, shards, simhash, suffix, token_count, urls
from tidewright.llm.common import new_path, table


#: Where the public tokenizers' files are; a path on every executor.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.compacted(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return store.read(shard_col="shard", tier_col="tier", columns=["doc_id", "source", "n_chars"])


def sharded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as they come back from the store, without where they lie, which is named anew each time."""
    store = shards.compacted(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return store.read(columns=["doc_id", "text", "lang", "source"]).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), copy_col="copy", order_col="shuffle_key")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).drop("text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fitted(docs))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repaired_digests(conversations.damaged(rows), rows)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_url_filters": op5_url_filters,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_suffix_array": op8_suffix_array,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_secret_scans": op11_secret_scans,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance_resampling": op13_importance_resampling,
    "sharded_rows": sharded_rows,
}
ORACLE_SQL = {
    "op5_url_filters": urls.SQL,
    "op7_mixing": mixing.SQL,
    "op9_quality_rules": quality.SQL,
    "op11_secret_scans": secrets.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_importance_resampling": resample.SQL,
    "sharded_rows": "select doc_id, md5(text) as text_md5, lang, source from documents",
}
