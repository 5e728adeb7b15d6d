"""A corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret redaction, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs.  All but the
last return the columns of their docs, whatever further ones there are and whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm import bpe, common, decontaminate, ngram_join, quality, secrets

#: SQL cannot express the stages of joins by similarity and of tokenisation; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a rule nor the verdict of their host rejects.  Null, empty and short texts go; repeated rows are judged one
    by one; a null source is a host; an empty table gives an empty one."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links (shingles of five words, similarity of 0.8 or more): that of the least doc_id, then class.
    Null and wordless texts stay; of repeated rows one stays; a null doc_id names no document; an empty table gives an empty one."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts and repeated rows stay; an empty table gives an empty one."""
    return decontaminate.clean_documents(docs, common.read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars set anew; null and empty texts and repeated rows stay as they are."""
    return secrets.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of their decoded bytes, and the ids; null and empty texts have no tokens."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's table is deleted when the next one's is written."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = common.staged_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            common.removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
