"""A corpus pipeline of five stages over ``documents``; each stage is written as Parquet and read again by the next.

Null and empty texts fail the quality rules. Equal rows and near copies leave one row each. Columns beside those of
``documents`` are handed on, whatever their names, by all stages but the last. An empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rainfold.llm.common import dropped, stored
from rainfold.llm.dedup import drop_copies
from rainfold.llm.jaccard import drop_near_copies
from rainfold.llm.packing import pack
from rainfold.llm.pii import redact
from rainfold.llm.quality import drop_poor


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return drop_poor(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what gives it away become placeholders."""
    return redact(docs, support=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("PII", personal_data),
    ("packing", packing),
]

#: SQL can't express the outlier test or the packing; tests hold the stages against brute-force versions on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's rows. A stage's table goes when the next one is written, the last one's when the application ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return docs
