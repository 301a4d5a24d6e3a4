"""Queries of these operators over the given tables, and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import (
    archives,
    audit,
    bpe,
    languages,
    leaks,
    lines,
    links,
    oracle,
    quality,
    search,
    secret_scan,
    simhash,
    toxicity,
    trees,
)

Query = Callable[[SparkSession, str], DataFrame]

# The rules that the urls are judged by.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> bpe.Vocabulary:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.Vocabulary.load(path, public_tokenizers.PATTERN, blanks_apart=True)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(table(spark, sf_dir, "documents"), vocabulary())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.withColumn("toxic", F.col("grade") >= 1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return trees.score(docs, trees.learn(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_secret_scans,
        op3_quality_rules,
        op4_byte_bpe,
        op5_line_dedup,
        op6_toxicity,
        op7_language_id,
        op8_warc,
        op9_simhash,
        op10_decontamination,
        op11_lexical_search,
        op12_quality_classifier,
        op13_filter_audit,
    )
}

SQL: dict[str, str] = {
    "op1_url_filters": oracle.url_filters(URL_RULES),
    "op2_secret_scans": oracle.secret_scans(),
    "op3_quality_rules": oracle.quality_rules(),
    "op5_line_dedup": oracle.line_dedup(),
    "op8_warc": oracle.warc(),
    "op11_lexical_search": oracle.lexical_search(),
    "op13_filter_audit": oracle.filter_audit(),
}
