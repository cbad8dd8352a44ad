"""Corpus pipeline: quality rules, near duplicates, decontamination, personal data, tokens.

Every stage works on all that the one before kept. Each is written as Parquet to the shared
folder and read again as the next one's documents. All take an empty table and give one, and
ignore columns beside those of documents. A text is one row of one task, however long: a task
needs a few times its longest text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseframe.llm.bpe import bpe
from sparseframe.llm.common import SPACES, Scratch, table
from sparseframe.llm.decontaminate import decontaminate
from sparseframe.llm.ngram_join import ngram_jaccard
from sparseframe.llm.pii import find_pii
from sparseframe.llm.quality_rules import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep.

    A null or empty text has no words and goes. A null source has no verdict. Ids play no part:
    repeated rows each count for their host, and stay or go together.
    """
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the least id. Documents without words stay.

    Repeated rows, of one id and one text, become one row; one id with several texts is one
    node, and its texts stay or go together. Rows without an id are told apart by their text
    alone: one row of each text stays, or none if its words stand, exactly so, under an id.
    Of the rows for one id and text the least (lang, source, n_chars) stays.
    """
    groups = ngram_jaccard(docs, k=5, percent=80)
    drop = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped")).distinct()
    rows = docs.select(*COLUMNS)
    left = rows.join(drop, F.col("doc_id") == F.col("dropped"), "left_anti")
    # ids that may have several rows; none in most tables, and then no text moves
    scratch = Scratch(spark)
    many = scratch.cut(docs.groupBy(F.col("doc_id").alias("many")).count().where("count > 1 or many is null").select("many"), "many")
    if not many.limit(1).count():
        return left
    same = F.col("doc_id").eqNullSafe(F.col("many"))
    once = left.join(many, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r")).select("doc_id", "text", "r.*")
    named = rows.where("doc_id is not null and text is not null").select(F.col("text").alias("named"))
    spaces = F.lit(SPACES)
    copies = (F.col("text") == F.col("named")) & F.col("doc_id").isNull() & (F.trim("text", spaces) != "")
    return left.join(many, same, "left_anti").unionByName(once.join(named, copies, "left_anti"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Null and empty texts hold none and stay; rows without an id stay; of rows that share an id with a leak, all go."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans of personal data replaced by their kind; n_chars follows. Every row comes back; a null text stays null, and so does its n_chars."""
    out = find_pii(docs.select(*COLUMNS), keep=("doc_id", "lang", "source"), outputs=("redacted",))
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every text; a null or empty text has no ids. Repeated rows each come back."""
    return bpe(docs, keep=("doc_id", "source"), outputs=("n_tokens", "ids"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("decontamination", benchmark_leaks), ("pii", personal_data), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs


#: The pairwise similarity, the CRF and the tokenizer are beyond SQL: tested by brute force.
ORACLE_SQL = None
