"""Binary model files: parsing, writing, and reading them through Spark."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from wordloom.model import MODEL_TYPES, UNIGRAM, Model, NormalizerSpec, Piece, Trainer, float32, piece_type
from wordloom.sources.wire import BYTES, FIXED32, VARINT, Reader, Writer

_TRAINER = {40: "unk_id", 41: "bos_id", 42: "eos_id", 43: "pad_id", 45: "unk_piece", 46: "bos_piece", 47: "eos_piece", 48: "pad_piece"}
_NORMALIZER = {3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}


def parse_model(data: bytes) -> Model:
    """Fields of an unexpected wire type are skipped; unknown model types count as Unigram."""
    reader, pieces, trainer, normalizer = Reader(data), [], Trainer(), NormalizerSpec()
    while (tag := reader.tag()) is not None:
        number, kind = tag
        if kind == BYTES and number == 1:
            pieces.append(_piece(reader.message()))
        elif kind == BYTES and number == 2:
            trainer = _trainer(reader.message())
        elif kind == BYTES and number == 3:
            normalizer = _normalizer(reader.message())
        else:
            reader.skip(kind)
    return Model(tuple(pieces), trainer, normalizer)


def _piece(r: Reader) -> Piece:
    out = Piece("")
    while (tag := r.tag()) is not None:
        if tag == (1, BYTES):
            out = replace(out, piece=r.string())
        elif tag == (2, FIXED32):
            out = replace(out, score=r.float())
        elif tag == (3, VARINT):
            out = replace(out, type=piece_type(r.varint()))
        else:
            r.skip(tag[1])
    return out


def _trainer(r: Reader) -> Trainer:
    found: dict = {}
    while (tag := r.tag()) is not None:
        number, kind = tag
        if number == 3 and kind == VARINT:
            found["model_type"] = MODEL_TYPES.get(r.varint(), UNIGRAM)
        elif number == 35 and kind == VARINT:
            found["byte_fallback"] = r.bool()
        elif number in (40, 41, 42, 43) and kind == VARINT:
            value = r.signed() & 0xFFFFFFFF
            found[_TRAINER[number]] = value - 2**32 if value >= 2**31 else value
        elif number in (45, 46, 47, 48) and kind == BYTES:
            found[_TRAINER[number]] = r.string()
        else:
            r.skip(kind)
    return Trainer(**found)


def _normalizer(r: Reader) -> NormalizerSpec:
    found: dict = {}
    while (tag := r.tag()) is not None:
        number, kind = tag
        if number == 1 and kind == BYTES:
            found["name"] = r.string()
        elif number == 2 and kind == BYTES:
            found["charsmap"] = r.bytes() or None
        elif number in _NORMALIZER and kind == VARINT:
            found[_NORMALIZER[number]] = r.bool()
        else:
            r.skip(kind)
    return NormalizerSpec(**found)


def write_model(model: Model) -> bytes:
    """The inverse of parse_model."""
    out = Writer()
    for p in model.pieces:
        out.blob(1, bytes(Writer().blob(1, p.piece).single(2, p.score).number(3, p.type).out))
    t = Writer().number(3, {v: k for k, v in MODEL_TYPES.items()}[model.trainer.model_type]).number(35, model.trainer.byte_fallback)
    for number, name in _TRAINER.items():
        value = getattr(model.trainer, name)
        t.blob(number, value) if isinstance(value, str) else t.number(number, value)
    out.blob(2, bytes(t.out))
    n = Writer().blob(1, model.normalizer.name)
    if model.normalizer.charsmap:
        n.blob(2, model.normalizer.charsmap)
    for number, name in _NORMALIZER.items():
        n.number(number, getattr(model.normalizer, name))
    out.blob(3, bytes(n.out))
    return bytes(out.out)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One file from any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_model(spark: SparkSession, path: str) -> Model:
    return parse_model(read_bytes(spark, path))


def pieces_of(rows) -> tuple[Piece, ...]:
    """Pieces from rows (id, piece, score, type) of a vocabulary table; missing ids become empty pieces."""
    found = {r["id"]: Piece(r["piece"], float32(r["score"]), piece_type(r["type"])) for r in rows}
    return tuple(found.get(i, Piece("")) for i in range(max(found, default=-1) + 1))
