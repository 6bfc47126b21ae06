"""Encoding and decoding of DataFrame columns.

Texts go to workers in Arrow batches and come back as one struct or list
column: a projection, with no exchange and no join.  Of a batch a worker takes
a slice of so many bytes at a time, and sends its result back as a batch of its
own.  Each worker keeps the ids of the chunks it has seen, so that a frequent
word is segmented once a worker.
Decoding of plain pieces, and everything done to encodings afterwards, are
native expressions.

The input limit of a single call does not hold for columns: a text of any
length is encoded whole, so that one long row cannot fail a job.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import textops
from wordloom.functions.slices import sliced, sliced_pair
from wordloom.model import BYTE, MARK
from wordloom.operators import columns
from wordloom.operators.columns import SCHEMA
from wordloom.operators.encoding import FIELDS, Encoding
from wordloom.operators.tokenizer import Tokenizer

_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_KINDS = dict(zip(FIELDS, (pa.string(), *[pa.int32()] * 4, _SPAN, pa.int32(), pa.int32())))


class Shared:
    """A tokenizer that is sent to executors once, by broadcast, and loaded once a worker."""

    def __init__(self, spark: SparkSession, tok: Tokenizer):
        self.sent = spark.sparkContext.broadcast(tok)

    @property
    def tok(self) -> Tokenizer:
        return self.sent.value


def _shared(tok: Tokenizer) -> Shared:
    return Shared(SparkSession.active(), tok)


def _lists(rows: list[list | None], kind: pa.DataType) -> pa.Array:
    offsets, flat, at = [0], [], 0
    for r in rows:
        flat += r or ()
        at += len(r or ())
        offsets.append(at)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind), mask=pa.array([r is None for r in rows]))


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    starts, ends = (_lists([[span[k] for span in r] for r in rows], pa.int32()) for k in (0, 1))
    return pa.ListArray.from_arrays(starts.offsets, pa.StructArray.from_arrays([starts.values, ends.values], fields=list(_SPAN)))


def encodings_to_arrow(rows: list[Encoding | None]) -> pa.StructArray:
    made = []
    for f in FIELDS:
        values = [None if e is None else getattr(e, f) for e in rows]
        values = [[] if v is None else v for v in values]
        made.append(_spans(values) if f == "offsets" else _lists(values, _KINDS[f]))
    return pa.StructArray.from_arrays(made, fields=[pa.field(f, a.type) for f, a in zip(FIELDS, made)], mask=pa.array([e is None for e in rows]))


def encode(text: Column | str, tok: Tokenizer, add_special: bool | None = None) -> Column:
    """The encoding of a text, with offsets and words, truncated and padded as the tokenizer is set; null stays null."""
    shared = _shared(tok)

    def run(texts: pa.Array) -> pa.Array:
        own = shared.tok
        return encodings_to_arrow([None if t is None else own.finish(own.bare(t, add_special)) for t in texts.to_pylist()])

    return sliced(SCHEMA, run)(text)


def encode_pair(a: Column | str, b: Column | str, tok: Tokenizer, add_special: bool | None = None, max_length: int | None = None, strategy: str | None = None) -> Column:
    """Null if either text is."""
    shared = _shared(tok)

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        own = shared.tok
        return encodings_to_arrow([None if x is None or y is None else own.finish_pair(own.bare_pair(x, y, add_special, max_length, strategy)) for x, y in zip(left.to_pylist(), right.to_pylist())])

    return sliced_pair(SCHEMA, run)(a, b)


def token_ids(text: Column | str, tok: Tokenizer, add_special: bool | None = None) -> Column:
    """Ids alone, with the special tokens around them, neither cut nor padded."""
    shared = _shared(tok)
    bos, eos = tok.ends(add_special)

    def run(texts: pa.Array) -> pa.Array:
        own = shared.tok
        front, back = [] if bos is None else [bos], [] if eos is None else [eos]
        return _lists([None if t is None else front + own.ids(t) + back for t in texts.to_pylist()], pa.int32())

    return sliced("array<int>", run)(text)


def token_count(text: Column | str, tok: Tokenizer) -> Column:
    """The number of content tokens."""
    shared = _shared(tok)

    def run(texts: pa.Array) -> pa.Array:
        own = shared.tok
        return pa.array([None if t is None else len(own.ids(t)) for t in texts.to_pylist()], pa.int32())

    return sliced("int", run)(text)


def pair_count(a: Column | str, b: Column | str, tok: Tokenizer, add_special: bool | None = None, max_length: int | None = None, strategy: str | None = None) -> Column:
    """The length of the encoding of a pair, cut as it is; null if either text is."""
    shared = _shared(tok)

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        own = shared.tok
        return pa.array([None if x is None or y is None else own.pair_length(x, y, add_special, max_length, strategy) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.int32())

    return sliced_pair("int", run)(a, b)


def tokenize(text: Column | str, tok: Tokenizer) -> Column:
    """E6"""
    shared = _shared(tok)

    def run(texts: pa.Array) -> pa.Array:
        own = shared.tok
        return _lists([None if t is None else own.tokens(t) for t in texts.to_pylist()], pa.string())

    return sliced("array<string>", run)(text)


def tokens_by(df: DataFrame, text: str, by: str, tok: Tokenizer) -> DataFrame:
    """(by, tokens, docs): content tokens, and texts that have any, of each value of a column.

    Where words can be segmented apart, texts are cut into words in the JVM and each distinct word is encoded once;
    texts with a literal mark, in which words may run into each other, and other models take the way by whole texts.
    """

    def whole(part: DataFrame) -> DataFrame:
        return part.select(by, token_count(text, tok).alias("n")).where("n > 0").groupBy(by).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))

    if not tok.counts_by_words:
        return whole(df)
    spaces = f"[{textops._java(textops.SPACE)}]"
    plain = df.where(~F.contains(text, F.lit(MARK)))
    words = plain.select(by, F.explode(F.split(text, spaces + "+")).alias("__w")).where("__w <> ''").groupBy(by, "__w").agg(F.count("*").alias("__n"))
    counted = words.select(by, (F.col("__n") * token_count("__w", tok)).alias("tokens"), F.lit(0).cast("long").alias("docs"))
    texts = plain.where(F.col(text).rlike(f"[^{textops._java(textops.SPACE)}]")).groupBy(by).agg(F.lit(0).cast("long").alias("tokens"), F.count("*").alias("docs"))
    return counted.unionByName(texts).unionByName(whole(df.where(F.contains(text, F.lit(MARK))))).groupBy(by).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))


def _bare(tok: Tokenizer) -> Tokenizer:
    return tok.no_padding()


def _padded(df: DataFrame, out: str, tok: Tokenizer, batch_by: str | None, made: Column, length_of: Column) -> DataFrame:
    p = tok.padding
    if p is None:
        return df.withColumn(out, made)
    return columns.pad_to_longest(df, out, tok.pad_id, tok.pad_token, p.right, p.pad_type_id, batch_by, p.length, p.multiple, length_of, made)


def encode_batch(df: DataFrame, text: str, tok: Tokenizer, out: str = "encoding", add_special: bool | None = None, batch_by: str | None = None) -> DataFrame:
    """Every text encoded and cut on its own, then padded over the table or over each batch.

    The longest lengths come from counts of ids, for which each distinct word is segmented once; encodings are made once.
    """
    n = token_count(text, tok) + sum(x is not None for x in tok.ends(add_special))
    if tok.truncation is not None:
        n = F.least(n, F.lit(tok.truncation.max_length))
    return _padded(df, out, tok, batch_by, encode(text, _bare(tok), add_special), n)


def encode_pair_batch(df: DataFrame, a: str, b: str, tok: Tokenizer, out: str = "encoding", add_special: bool | None = None, max_length: int | None = None, strategy: str | None = None, batch_by: str | None = None) -> DataFrame:
    """The longest lengths come from counts of ids, as those of a batch of single texts."""
    made = _bare(tok)
    return _padded(df, out, tok, batch_by, encode_pair(a, b, made, add_special, max_length, strategy), pair_count(a, b, made, add_special, max_length, strategy))


def constant(values: list | dict, kind: str) -> Column:
    """A literal array or map of any size in one expression, folded when the query is planned."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def decode(ids: Column | str, tok: Tokenizer, skip_special: bool = True) -> Column:
    """Native; byte pieces give the character of their value."""
    if tok.utf8_bytes:
        return decode_utf8(ids, tok, skip_special)
    from wordloom.functions.textops import denormalize

    v = tok.vocab
    shown = ["" if skip_special and v.is_special(i) else chr(int(p.piece[3:5], 16)) if p.type == BYTE else p.piece for i, p in enumerate(v.pieces)]
    table = constant(shown, "array<string>")
    outside = F.lit("" if skip_special else v.trainer.unk_piece)
    ids = F.col(ids) if isinstance(ids, str) else ids
    return denormalize(F.array_join(F.transform(ids, lambda x: F.coalesce(F.get(table, x), outside)), ""), tok.normalizer)


def decode_utf8(ids: Column | str, tok: Tokenizer, skip_special: bool = True) -> Column:
    """D1 with runs of byte pieces read as UTF-8."""
    shared = _shared(tok)

    def run(batch: pa.Array) -> pa.Array:
        own = shared.tok
        return pa.array([None if x is None else own.decode(x, skip_special) for x in batch.to_pylist()], pa.string())

    return sliced("string", run)(ids)


def ids_to_tokens(ids: Column | str, tok: Tokenizer) -> Column:
    """D4"""
    table = constant([p.piece for p in tok.vocab.pieces], "array<string>")
    return F.transform(F.col(ids) if isinstance(ids, str) else ids, lambda x: F.coalesce(F.get(table, x), F.lit(tok.vocab.trainer.unk_piece)))


def tokens_to_ids(tokens: Column | str, tok: Tokenizer) -> Column:
    """D3: through Arrow, as a native map literal would be searched from its start for every token."""
    shared = _shared(tok)

    def run(batch: pa.Array) -> pa.Array:
        v = shared.tok.vocab
        known, ids = pa.array(v.index.keys(), pa.string()), pa.array(v.index.values(), pa.int32())
        found = ids.take(pc.index_in(batch.flatten(), known))
        counts = pc.fill_null(pc.list_value_length(batch), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(counts).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, pc.fill_null(found, v.trainer.unk_id), mask=batch.is_null())

    return sliced("array<int>", run)(tokens)
