"""Token streams to text: chunks are released at newlines, after CJK characters and at word borders.

Decoded text only ever grows by appending, so the state of a stream is its
pending text and three small values, never its tokens.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from wordloom.functions.slices import cut
from wordloom.functions.textops import _java
from wordloom.model import BYTE, MARK
from wordloom.operators.tokenizer import Tokenizer, code_units

#: Ideographs, compatibility ideographs, Hangul and kana.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0xAC00, 0xD7AF), (0x3040, 0x309F), (0x30A0, 0x30FF))
_CJK_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK)
HOLD = 4


def printable(pending: str) -> str:
    """What may be released of the text that is held back."""
    if not pending:
        return ""
    at = pending.find("\n")
    if at >= 0:
        return pending[: at + 1]
    if any(a <= ord(pending[-1]) <= b for a, b in CJK):
        return pending
    at = pending.rfind(" ")
    if at > 0:
        return pending[: at + 1]
    return pending if code_units(pending) > HOLD else ""


def printable_column(pending: Column) -> Column:
    """X3 as a native expression."""
    space = F.locate(" ", F.reverse(pending))
    last = F.char_length(pending) - space
    units = F.octet_length(F.encode(pending, "UTF-16BE")) / 2
    return (
        F.when(F.locate("\n", pending) > 0, F.substr(pending, F.lit(1), F.locate("\n", pending)))
        .when(pending.rlike(f"[{_java(_CJK_CLASS)}]$"), pending)
        .when((space > 0) & (last > 0), F.substr(pending, F.lit(1), last + 1))
        .when(units > HOLD, pending)
        .otherwise(F.when(pending.isNotNull(), ""))
    )


@dataclass
class StreamState:
    pending: str = ""
    at_start: bool = True
    prompt_left: int = 0
    raw: bytes = b""


class TextStreamer:
    """put() takes a token, end() releases the rest; chunks go to the callback (text, stream end) or to standard output."""

    def __init__(self, tok: Tokenizer, skip_special: bool = True, skip_prompt: bool = False, prompt_length: int = 1, on_text: Callable[[str, bool], None] | None = None):
        self.tok, self.skip_special = tok, skip_special
        self.prompt = prompt_length if skip_prompt else 0
        self.on_text = on_text or (lambda text, last: print(text, end="\n" if last else "", flush=True))
        self.reset()

    def reset(self) -> None:
        self.state = StreamState(prompt_left=self.prompt)

    def _append(self, text: str) -> None:
        n, s = self.tok.normalizer, self.state
        if n.escape_whitespaces:
            text = text.replace(MARK, " ")
        if text and s.at_start:
            s.at_start = False
            if n.add_dummy_prefix:
                text = text.removeprefix(" ")
        s.pending += text

    def _flush_bytes(self) -> None:
        if self.state.raw:
            self._append(codecs.decode(self.state.raw, "utf-8", "replace"))
            self.state.raw = b""

    def put(self, token_id: int) -> None:
        s, v = self.state, self.tok.vocab
        if s.prompt_left > 0:
            s.prompt_left -= 1
            return
        kind = v.type(token_id)
        if kind == BYTE and self.tok.utf8_bytes:
            s.raw += bytes([int(v.pieces[token_id].piece[3:5], 16)])
            return
        self._flush_bytes()
        if kind == BYTE:
            self._append(chr(int(v.pieces[token_id].piece[3:5], 16)))
        elif not (self.skip_special and v.is_special(token_id)):
            self._append(v.id_to_piece(token_id))
        out = printable(s.pending)
        if out:
            s.pending = s.pending[len(out) :]
            self.on_text(out, False)

    def end(self) -> None:
        self._flush_bytes()
        rest = self.state.pending
        self.reset()
        self.on_text(rest, True)


def decode_with_callback(tok: Tokenizer, ids: list[int], on_text: Callable[[str], None], skip_special: bool = True) -> None:
    """X6"""
    streamer = TextStreamer(tok, skip_special, on_text=lambda text, last: on_text(text) if text else None)
    for x in ids:
        streamer.put(x)
    streamer.end()


def decode_stream(tok: Tokenizer, ids: Iterator[int], skip_special: bool = True) -> Iterator[str]:
    """Chunks as they become ready."""
    out: list[str] = []
    streamer = TextStreamer(tok, skip_special, on_text=lambda text, last: out.append(text) if text else None)
    for x in ids:
        streamer.put(x)
        yield from out
        out.clear()
    streamer.end()
    yield from out


def _arrow(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = (key, pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "seq", "chunk", "stream_end"])


def stream_decode_batch(df: DataFrame, key: str, pos: str, token_id: str, tok: Tokenizer, end: str | None = None, skip_special: bool = True, skip_prompt: bool = False, prompt_length: int = 1) -> DataFrame:
    """(key, seq, chunk, stream_end): every stream of a table decoded in the order of pos.

    A row with a true ``end`` ends its stream (its token id, if any, comes before); so does the last row of a key without one.
    Streams pass through a sorted partition one token at a time; none is held whole.
    """
    from wordloom.operators.encode import Shared

    shared = Shared(df.sparkSession, tok)
    kind = df.schema[key].dataType
    flag = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    rows = df.select(F.col(key).alias("key"), F.col(pos).cast("long").alias("pos"), F.col(token_id).cast("int").alias("id"), flag.alias("end"))
    schema = StructType([StructField("key", kind), StructField("seq", LongType()), StructField("chunk", StringType()), StructField("stream_end", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, seq, opened = object(), 0, False

        def emit(text: str, last: bool) -> None:
            nonlocal seq
            out.append((now, seq, text, last))
            seq += 1

        streamer = TextStreamer(shared.tok, skip_special, skip_prompt, prompt_length, emit)
        key_type = pa.string()
        for batch in batches:
            key_type = batch.column(0).type
            for k, token, last in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if k != now:
                    if opened:
                        streamer.end()
                    now, seq = k, 0
                opened = True
                if token is not None:
                    streamer.put(token)
                if last:
                    streamer.end()
                    opened = False
            if len(out) > 10_000:
                yield _arrow(out, key_type)
                out.clear()
        if opened:
            streamer.end()
        if out:
            yield _arrow(out, key_type)

    return rows.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(run, schema)


def stream_decode_arrays(df: DataFrame, key: str, ids: str, tok: Tokenizer, skip_special: bool = True, skip_prompt: bool = False, prompt_length: int = 1) -> DataFrame:
    """(key, seq, chunk, stream_end): each row's ids decoded as a stream that ends with them; nothing is exchanged.  Null ids give no rows."""
    from wordloom.operators.encode import Shared

    shared = Shared(df.sparkSession, tok)
    kind = df.schema[key].dataType
    schema = StructType([StructField("key", kind), StructField("seq", LongType()), StructField("chunk", StringType()), StructField("stream_end", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        row: list[tuple[str, bool]] = []
        streamer = TextStreamer(shared.tok, skip_special, skip_prompt, prompt_length, lambda text, last: row.append((text, last)))
        for batch in batches:
            for keys, ids in cut(tuple(batch.columns)):
                for k, tokens in zip(keys.to_pylist(), ids.to_pylist()):
                    if tokens is None:
                        continue
                    for x in tokens:
                        streamer.put(x)
                    streamer.end()
                    out.extend((k, i, text, last) for i, (text, last) in enumerate(row))
                    row.clear()
                    if len(out) > 10_000:
                        yield _arrow(out, batch.column(0).type)
                        out.clear()
            if out:
                yield _arrow(out, batch.column(0).type)
                out.clear()

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema)


class _Held:
    """A tokenizer that goes along with the query: its driver-side worker sees no broadcasts."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok


class _Processor(StatefulProcessor):
    """State of a key: pending text, start flag, prompt tokens left, raw bytes, the next position, chunks so far, late tokens so far."""

    def __init__(self, shared, options: dict, idle_ms: int | None):
        self.shared, self.options, self.idle_ms = shared, options, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("stream", "pending string, at_start boolean, prompt_left int, raw binary, next_pos long, seq long, late long")

    def _open(self, out: list):
        streamer = TextStreamer(self.shared.tok, on_text=lambda text, last: out.append((text, last)), **self.options)
        if self.value.exists():
            pending, at_start, prompt_left, raw, next_pos, seq, late = self.value.get()
            streamer.state = StreamState(pending, at_start, prompt_left, bytes(raw))
            return streamer, next_pos, seq, late
        return streamer, -(2**63), 0, 0

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        out: list[tuple[str, bool]] = []
        streamer, next_pos, seq, late = self._open(out)
        for r in sorted(rows, key=lambda r: r["pos"]):
            if r["pos"] < next_pos:
                late += 1
                continue
            next_pos = r["pos"] + 1
            if r["id"] is not None:
                streamer.put(r["id"])
            if r["end"]:
                streamer.end()
        s = streamer.state
        self.value.update((s.pending, s.at_start, s.prompt_left, s.raw, next_pos, seq + len(out), late))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        for i, (text, last) in enumerate(out):
            yield Row(key=key[0], seq=seq + i, chunk=text, stream_end=last, late=late)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        """A stream that has been idle ends, and its state goes."""
        out: list[tuple[str, bool]] = []
        streamer, _, seq, late = self._open(out)
        streamer.end()
        self.value.clear()
        for i, (text, last) in enumerate(out):
            yield Row(key=key[0], seq=seq + i, chunk=text, stream_end=last, late=late)

    def close(self) -> None:
        pass


def stream_decode(sdf: DataFrame, key: str, pos: str, token_id: str, tok: Tokenizer, end: str | None = None, skip_special: bool = True, skip_prompt: bool = False, prompt_length: int = 1, idle_ms: int | None = None) -> DataFrame:
    """(key, seq, chunk, stream_end, late): a streaming DataFrame of tokens decoded with state; needs the RocksDB state store.

    Tokens of a micro-batch are taken in the order of pos; one at or before a
    position that was already taken is late: dropped, and counted in ``late``.
    """
    flag = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    rows = sdf.select(F.col(key).alias("key"), F.col(pos).cast("long").alias("pos"), F.col(token_id).cast("int").alias("id"), flag.alias("end"))
    schema = StructType([StructField("key", sdf.schema[key].dataType), StructField("seq", LongType()), StructField("chunk", StringType()), StructField("stream_end", BooleanType()), StructField("late", LongType())])
    processor = _Processor(_Held(tok), {"skip_special": skip_special, "skip_prompt": skip_prompt, "prompt_length": prompt_length}, idle_ms)
    return rows.groupBy("key").transformWithState(processor, schema, "Append", "ProcessingTime" if idle_ms is not None else "None")
