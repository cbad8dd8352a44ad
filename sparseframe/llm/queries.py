"""One query per operator, over whole tables with production parameters, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, quality_rules as rules
from .bpe import bpe
from .common import table
from .decontaminate import matches
from .language_id import language_id
from .main_text import extract
from .ngram_join import ngram_jaccard
from .pii import find_pii
from .quality_rules import quality_rules
from .token_files import token_files
from .toxicity import toxicity


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_edit_match_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_perspectives,
        op2_bpe_tree,
        op3_toxicity_ftrl,
        op4_host_quality_rules,
        op5_ngram_jaccard_join,
        op6_language_mixture,
        op7_pii_crf,
        op8_html_tree_scoring,
        op9_edit_match_decontamination,
        op10_simple8b_token_files,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_chat_perspectives": chat.ORACLE, "op4_host_quality_rules": rules.ORACLE}
