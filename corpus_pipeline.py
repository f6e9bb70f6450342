"""The corpus pipeline: documents in, token shards out, each stage on all that the one before kept.

1. quality: documents that the byte-level convolutional network scores under the threshold go.
2. near-duplicates: of each class of linked documents the one of smallest id stays.
3. decontamination: documents that hold a benchmark window go.
4. mixing: documents are sampled by probabilities raked to source, language and topic weights.
5. tokens: documents are encoded and written as shards; the result is read back from them, a row per document.

Stages 1 to 4 return documents' columns. SQL can't say stages 1, 2 and 5, so ORACLE_SQL is None, and each stage is tested against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewise.llm import decontam, mixing, neardup, quality, tokenbin
from framewise.llm.common import durable, table

ORACLE_SQL: str | None = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenbin.op9(spark, sf_dir, docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
