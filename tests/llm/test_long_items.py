"""Operator 1: the error budget follows the item's length however long it is."""

import random

from tests.llm.tables import words
from wordloom.llm import decontaminate


def test_item_of_several_thousand_characters(spark):
    item = words(170, 800)
    assert len(decontaminate.normalised(item)) > 4000
    out = list(item)
    for at in random.Random(8).sample(range(0, len(item), 5), 100):
        out[at] = "z" if out[at] != " " else "y"
    docs = spark.createDataFrame([(1, words(171, 50) + " " + "".join(out) + " " + words(172, 50)), (2, words(173, 900))], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 9)] and 64 < got[0]["distance"] <= 100
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()] == [2]
