"""The training-data pipeline: from raw documents to packed sequences.

Each stage takes all that its predecessor kept, is written as Parquet and read again. All but
the last return the columns of documents. An empty input passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontaminate, language, near_copies, packing, quality, simhash
from quillmark.llm.common import new_folder, read_table, scratch, stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised."""
    return language.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that op9's fingerprints or a similarity of 0.8 on five-word shingles link."""
    return simhash.keep_first(docs, similarity=near_copies.SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages, or too little of them to count."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = new_folder(spark)
        with scratch(spark):
            docs = stash(stage(spark, docs, sf_dir), kept)
    return STAGES[-1][1](spark, docs, sf_dir)
