"""A training corpus from raw documents, in five stages: quality rules, near duplicates, personal data, mix, tokens.

Edge cases, in every stage: an empty table gives an empty one of the same columns; columns beyond those of documents are
kept up to the last stage, whatever their names (but for columns that an operator's docstring names as replaced).

- quality rules: null, empty and short texts go; a null language is judged by its script; repeated rows are judged alike.
- near duplicates: rows of one id are one document and stay or go together; rows with a null id stay; texts without words are
  linked with none.
- personal data: null texts stay null; texts of any length are searched whole; repeated rows are redacted alike.
- mix: rows of one id, null among them, are taken together; rows repeat as often as they are taken, at most three times.
- tokens: null texts have no tokens, an empty list; bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riftspark.llm import bpe, common, mixing, near_dedup, pii, quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return near_dedup.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the names of its kinds."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, as often as it takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids with their tokens."""
    return bpe.encode(docs, without_text=True).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("quality rules", quality), ("near duplicates", dedup), ("personal data", private), ("mix", mixed), ("tokens", tokens)]

#: Signatures, tokenisers and fitted trees can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is kept as Parquet in the shared folder and read again by the next stage."""
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.keep(docs, f"stage{k}")
    return docs
