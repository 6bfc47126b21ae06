"""The engine's functions for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

import pyarrow as pa

from wordloom.functions.slices import sliced, sliced_pair
from wordloom.operators.columns import SCHEMA
from wordloom.operators.encode import Shared, _lists, encodings_to_arrow
from wordloom.operators.tokenizer import Tokenizer


def register(spark: SparkSession, tok: Tokenizer, prefix: str = "sp") -> list[str]:
    """Registers <prefix>_encode, _encode_pair, _ids, _tokenize, _count, _decode and the table function _explode (pos, id, token, start, end, word_id)."""
    shared = Shared(spark, tok)

    def each(of, batch: pa.Array) -> list:
        own = shared.tok
        return [None if x is None else of(own, x) for x in batch.to_pylist()]

    def encode(texts: pa.Array) -> pa.Array:
        return encodings_to_arrow(each(lambda t, x: t.finish(t.bare(x)), texts))

    def encode_pair(a: pa.Array, b: pa.Array) -> pa.Array:
        own = shared.tok
        return encodings_to_arrow([None if x is None or y is None else own.finish_pair(own.bare_pair(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist())])

    def ids(texts: pa.Array) -> pa.Array:
        return _lists(each(lambda t, x: t.ids(x), texts), pa.int32())

    def tokenize(texts: pa.Array) -> pa.Array:
        return _lists(each(lambda t, x: t.tokens(x), texts), pa.string())

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(each(lambda t, x: len(t.ids(x)), texts), pa.int32())

    def decode(batch: pa.Array) -> pa.Array:
        return pa.array(each(lambda t, x: t.decode(x), batch), pa.string())

    @udtf(returnType="pos: int, id: int, token: string, start: int, end: int, word_id: int")
    class Explode:
        def eval(self, text: str):
            for pos, (i, token, (start, end), word) in enumerate(shared.tok.rows(text) if text is not None else ()):
                yield pos, i, token, start, end, word

    made = {"encode": sliced(SCHEMA, encode), "encode_pair": sliced_pair(SCHEMA, encode_pair), "ids": sliced("array<int>", ids), "tokenize": sliced("array<string>", tokenize), "count": sliced("int", count), "decode": sliced("string", decode)}
    for name, f in made.items():
        spark.udf.register(f"{prefix}_{name}", f)
    spark.udtf.register(f"{prefix}_explode", Explode)
    return [f"{prefix}_{name}" for name in (*made, "explode")]
