"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, fim, licenses, ngram_join, quality, secrets, sharding, substrings, token_alignment, token_files, urls, warc

#: The rules of the URL query.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(common.read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(common.read(spark, sf_dir, "documents"), words=4, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(common.read(spark, sf_dir, "documents"), length=400)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(common.read(spark, sf_dir, "documents"), n_shards=40)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(common.read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(common.read(spark, sf_dir, "pages"), URL_RULES)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = token_files.write_images(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_files.read_images(images)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(common.read(spark, sf_dir, "documents").select("doc_id", "text"), common.read(spark, sf_dir, "benchmark"))
    return found.drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restore(fim.transform(common.read(spark, sf_dir, "documents"), rate=90, spm_rate=20))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(common.read(spark, sf_dir, "pages"), revisit_from=0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_ngram_jaccard_join, op3_substring_dedup, op4_byte_bpe, op5_sharding, op6_licenses, op7_url_filter, op8_token_files, op9_decontamination, op10_quality_rules, op11_fill_in_middle, op12_warc, op13_token_alignment)}
