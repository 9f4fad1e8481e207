"""A corpus pipeline of five operators: quality rules, line dedup, n-gram Jaccard join, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import line_dedup, ngram_jaccard, packing, pii, quality
from lodestack.llm.common import removed, stored
from lodestack.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failed lines. Null and empty texts are rejected; repeated rows and null ids stay."""
    return quality.clean_documents(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that one of smaller id has. Null texts stay null; rows of one id are one document."""
    return line_dedup.dedup_documents(docs.select(*COLUMNS))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of rows of equal id and text one, and of a group the smallest id; texts without words stay."""
    return ngram_jaccard.keep_one(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. Null texts stay null; repeated rows stay."""
    return pii.redact_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences. A null or empty text is its end id alone; repeated rows are packed too."""
    return packing.pack_best_fit(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard", jaccard_stage), ("pii", pii_stage), ("best_fit_packing", packing_stage)]

#: The rules of line quality, the trained field and the tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again, and removed once the next is written.

    No documents give no rows. documents must have all COLUMNS; others are left out.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
