"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the
next one's documents.

quality      documents that the classifier predicts as label 0 go
exact        of equal texts the largest doc_id stays
near         of each component of documents that share 0.8 or more of the five-word shingles that either has the smallest doc_id stays
substrings   byte strings of 100 and more that also stand earlier are cut out of the texts
packing      what is left is packed into sequences of at most 4096 tokens (the last stage's own columns)

Null texts count as empty ones; of all empty texts one row stays. Rows without an id stay unless their text goes; they are last where the smallest id stays and first to go
where the largest does. Other columns pass through. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import cuckoo, packing, quality, simhash, suffixes
from paperloom.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cuckoo.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, width=5, share=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
