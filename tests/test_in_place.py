"""Encodings that are made in place hold what those that are bound hold, and nothing that is not asked for is made."""

import pytest
from pyspark.sql import functions as F

from wordloom.operators import columns as C
from wordloom.operators.encoding import FIELDS
from wordloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    rows = [(0, "a bcd ef ghij k"), (1, ""), (2, None), (3, "one"), (4, "x y z u v w")]
    df = spark.createDataFrame(rows, "i int, t string")
    return df.withColumn("e", F.when(F.col("t").isNotNull(), catalog._encoding(F.col("t"))).cast(C.SCHEMA))


@pytest.mark.parametrize("right", [True, False])
def test_padding_of_a_named_column(made, right):
    both = made.select("t", C.with_padding("e", 6, 9, "P", right, 3).alias("a"), C.with_padding(F.col("e"), 6, 9, "P", right, 3).alias("b"), C.pad_to_multiple("e", 4, 9, "P", right, 3).alias("c"), C.pad_to_multiple(F.col("e"), 4, 9, "P", right, 3).alias("d"))
    for r in both.collect():
        assert r["a"] == r["b"] and r["c"] == r["d"] and (r["a"] is None) == (r["t"] is None)
    whole, ids = (C.pad_to_longest(made, "e", 9, right=right, multiple=8, fields=f).orderBy("i").select("e.ids").collect() for f in (FIELDS, ("ids",)))
    assert whole == ids


def test_words_and_characters(made):
    e = F.col("e")
    got = made.orderBy("i").select(C.word_to_chars(e, 0).alias("chars"), C.word_to_tokens(e, 0).alias("tokens"), C.char_to_token(e, 11).alias("at"), C.n_sequences(e).alias("n")).collect()
    want = [((0, 13), (1, 3), 2, 1), ((0, 0), (1, 2), None, 1), (None, None, None, 0), ((0, 3), (1, 2), None, 1), ((0, 11), (1, 3), None, 1)]
    assert [tuple(None if x is None else tuple(x) if isinstance(x, tuple) else x for x in r) for r in got] == want


def test_what_is_not_shown_is_not_made(spark):
    padded = catalog.p3_pad_to_longest(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "<s>" not in padded and "attention_mask" not in padded
    mapped = catalog.c_index_mapping(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in mapped and mapped.count("split(") == 1
