"""A corpus for language-model training: filtered, deduplicated, mixed and encoded.

Each stage takes all rows that its predecessor kept, and all but the last return the columns of
documents. ``run`` applies the stages one after another, each written to the shared scratch folder
and read back, so a lost executor costs one stage's tasks at most; what a stage kept for itself goes then.

Defined cases: a null text is an empty one, which the quality rules reject; equal rows are copies of
which one stays; extra columns pass through all stages but the last; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, mixing, quality, simhash, suffix
from tidewright.llm.common import given, settled, table

#: Repeated passages of about forty words and more are cut.
PASSAGE_BYTES = 200

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that a rule rejects go."""
    return quality.cascade(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near copies stays."""
    return simhash.one_of_each_group(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages that repeat across or within documents go from their texts."""
    return suffix.cut(docs, window=PASSAGE_BYTES)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents repeat by their source's rate, in a new order."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: texts become token ids."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = given()
        docs = settled(stage(spark, docs, sf_dir), name, mark)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express near copies, repeated passages or encoding.
ORACLE_SQL = None
