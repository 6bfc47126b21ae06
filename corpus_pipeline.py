"""A document pipeline of five operators of wordloom.llm: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  The order: quality rules, near-dedup by verified shingle similarity (one document of
each group stays, that with the smallest doc_id), suffix-array dedup (covered
bytes go from the text), benchmark decontamination (documents that hold an
item go), packing.

Each row is judged on its own text, so rows without doc_id, and rows of one
doc_id and different texts, stay apart; null text is empty, and an empty text
fails the quality rules.  Of rows of one doc_id and one text one stays.  Among
equal texts and near copies the row with the smallest doc_id stays, rows
without one coming last in the order of a hash of their text.  A text that is
repeats throughout stays as an empty one.  An empty table gives an empty one;
columns beside those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontaminate, near_texts, packing, quality_rules, suffix_dedup
from wordloom.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_texts.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Fingerprints, byte spans, edit distances and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
