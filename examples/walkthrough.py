"""A walk through the engine on a small table: loading, encoding, pairs, padding, decoding, vocabularies, SQL and streams.

    python examples/walkthrough.py
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import sql
from wordloom.operators import columns as C
from wordloom.operators import encode as E
from wordloom.operators import vocabulary as V
from wordloom.operators.tokenizer import Tokenizer
from wordloom.plans import toy
from wordloom.sources import own_json
from wordloom.sources.model_file import parse_model, write_model
from wordloom.streaming.text_stream import decode_stream, stream_decode_arrays


def walk(spark: SparkSession) -> dict[str, DataFrame]:
    """The steps by name; each is an ordinary DataFrame, nothing has run yet."""
    steps: dict[str, DataFrame] = {}

    # A model: from a binary file or a tokenizer JSON as a rule; here a small fixed one, through the binary form and the own JSON form.
    fixed = toy.tokenizer()
    model = parse_model(write_model(_model_of(fixed)))
    tok = own_json.load(Tokenizer.from_model(model, fixed.config).to_json())

    texts = spark.createDataFrame([(1, "x", "the house and the tree"), (2, "x", "a door"), (3, "y", None)], "id int, batch string, text string")
    encoded = texts.select("id", "batch", E.encode("text", tok).alias("e"))
    steps["encode"] = encoded.select("id", "e.ids", "e.tokens", "e.offsets", "e.special_tokens_mask")
    steps["tokenize"] = texts.select("id", E.tokenize("text", tok).alias("tokens"), E.token_count("text", tok).alias("n"))
    steps["truncate"] = encoded.select("id", C.with_truncation("e", 4, keep_special=True)["tokens"].alias("tokens"))
    steps["batch"] = E.encode_batch(texts, "text", tok.with_padding(multiple=4), batch_by="batch").select("id", "encoding.ids", "encoding.attention_mask")
    steps["pair"] = texts.select("id", E.encode_pair("text", F.lit("a small door"), tok, max_length=16, strategy="only_second").alias("e")).select("id", "e.tokens", "e.type_ids", "e.sequence_ids")
    steps["positions"] = encoded.select("id", C.char_to_token("e", 4).alias("token_at_4"), C.token_to_chars("e", 2).alias("span_of_2"), C.n_sequences("e").alias("sequences"))
    steps["decode"] = texts.select("id", E.decode(E.token_ids("text", tok), tok).alias("text"))

    vocab = V.vocab_df(spark, tok)
    grown = V.add_tokens(vocab, spark.createDataFrame([(0, "[NEW]"), (1, "the")], "pos int, piece string"))
    steps["added"] = V.added_vocab(grown)
    steps["lookup"] = V.piece_to_id(spark.createDataFrame([("the",), ("zebra",)], "piece string"), "piece", vocab, tok.vocab.trainer.unk_id)

    sql.register(spark, tok, "walk")
    texts.createOrReplaceTempView("walk_texts")
    steps["sql"] = spark.sql("SELECT w.id AS text_id, walk_count(w.text) AS n, t.* FROM walk_texts w, LATERAL walk_explode(w.text) t")

    streams = texts.select("id", E.token_ids("text", tok).alias("ids"))
    steps["stream"] = stream_decode_arrays(streams, "id", "ids", tok)
    assert "".join(decode_stream(tok, tok.ids("the house"))) == "the house"
    return steps


def _model_of(tok: Tokenizer):
    from wordloom.model import Model

    return Model(tok.vocab.pieces, tok.vocab.trainer, tok.normalizer)


if __name__ == "__main__":
    session = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    for name, df in walk(session).items():
        print(f"== {name}")
        df.show(truncate=80)
