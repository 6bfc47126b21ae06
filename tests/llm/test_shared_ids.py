"""Filtering stages keep clean documents that share a doc_id, or have none, with others."""

import corpus_pipeline
from tests.llm.tables import documents, words
from wordloom.llm import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_judges_each_row(spark):
    rows = [(None, words(301, 60)), (None, "too short"), (5, words(302, 60)), (5, "short too"), (6, "short"), (7, words(303, 70))]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.keep_good(docs, labels)
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {rows[0], rows[2], rows[5]}


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark):
    rows = [(5, words(304, 90)), (5, words(305, 90)), (5, words(305, 90)), (4, words(306, 90)), (9, words(306, 90)), (None, words(307, 90)), (None, words(308, 90))]
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows), "").select(COLUMNS[:2]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted({*rows[:2], rows[3], *rows[5:]}, key=repr)
