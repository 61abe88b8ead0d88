"""Queries over the driver tables, one for each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontaminate import leaks_by_document
from .html_extract import extract_text
from .id_files import through_files
from .language import identify_documents
from .lm_score import score_documents
from .packing import pack
from .quality import judge
from .simhash import near_duplicates
from .token_count import count_tokens
from .url_filter import ORACLE as URL_ORACLE
from .url_filter import judge_urls, rule_table


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks_by_document(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_token_count, op2_url_filter, op3_html_extract, op4_id_files, op5_lm_score, op6_decontaminate, op7_quality, op8_language, op9_simhash, op10_packing)}

#: SQL for the operators that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {"op2_url_filter": URL_ORACLE}
