"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontaminate, html_text, licenses, packing, quality_rules, sharding, simhash, suffix_dedup, token_cache, url_filter
from wordloom.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labels = url_filter.labels_of_pages(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_filter.judge_urls(pages, labels=labels)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.count_tokens(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_license_scan, op3_packing, op4_quality_rules, op5_html_extraction, op6_suffix_dedup, op7_url_filter, op8_sharding, op9_token_counts, op10_near_dedup)}

#: None of the contracted digests is SQL on whole tables (learned verdicts, token ids, byte spans, XXH64, CRC-32);
#: tests/llm holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
