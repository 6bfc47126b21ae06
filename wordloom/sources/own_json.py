"""The engine's own JSON of a tokenizer, both ways, and detection of the other format."""

from __future__ import annotations

import base64
import json

from pyspark.sql import SparkSession

from wordloom.model import BPE, UNIGRAM, Config, FormatError, Model, NormalizerOp, NormalizerSpec, Piece, PreTokenizerSpec, Trainer, Unsupported, float32, piece_type
from wordloom.operators.tokenizer import Tokenizer
from wordloom.sources import hf_json
from wordloom.sources.hf_json import _decode

VERSION = "1.0"


def is_pipeline(data: dict) -> bool:
    """Whether an object is a tokenizer.json pipeline rather than the own format."""
    model = data.get("model")
    if not isinstance(model, dict):
        return False
    vocab = model.get("vocab")
    return "type" in model or isinstance(vocab, (list, dict)) and len(vocab) > 0


def dump(tok: Tokenizer) -> dict:
    t, n, c, p = tok.vocab.trainer, tok.normalizer, tok.config, tok.pre_tokenizer

    def b64(blob: bytes | None) -> str | None:
        return base64.b64encode(blob).decode() if blob else None

    def without_none(d: dict) -> dict:
        return {k: v for k, v in d.items() if v is not None}

    out = {
        "version": VERSION,
        "model_type": t.model_type,
        "vocab": {"pieces": [x.piece for x in tok.vocab.pieces], "scores": [x.score for x in tok.vocab.pieces], "types": [x.type for x in tok.vocab.pieces]},
        "special_tokens": {r: {"id": getattr(t, f"{r}_id"), "piece": getattr(t, f"{r}_piece")} for r in ("unk", "bos", "eos", "pad")},
        "normalizer": without_none({
            "add_dummy_prefix": n.add_dummy_prefix, "remove_extra_whitespaces": n.remove_extra_whitespaces, "escape_whitespaces": n.escape_whitespaces, "normalizer_name": n.name,
            "precompiled_charsmap": b64(n.charsmap),
            "operations": [without_none({"type": o.type, "precompiled_charsmap": b64(o.charsmap), "pattern": o.pattern, "replacement": o.replacement}) for o in n.operations] or None,
        }),
        "config": {"add_bos_token": c.add_bos, "add_eos_token": c.add_eos, "pair_eos_tokens_between_sequences": c.pair_eos_between, "pair_type_id": c.pair_type_id, "pair_special_type_id": c.pair_special_type_id},
        "byte_fallback": t.byte_fallback,
        "fuse_unk": t.fuse_unk,
    }
    if p is not None:
        out["pre_tokenizer"] = {"whitespace_split": p.whitespace_split, "use_metaspace": p.use_metaspace, "add_prefix_space": p.add_prefix_space, "replacement": p.replacement, "split": p.split}
    return out


def load(source: str | dict, config: Config | None = None) -> Tokenizer:
    """A tokenizer from either format."""
    try:
        data = json.loads(source) if isinstance(source, str) else source
    except json.JSONDecodeError as e:
        raise FormatError(str(e)) from e
    if is_pipeline(data):
        return hf_json.load(data, config)

    def need(d: dict, key: str):
        if d.get(key) is None:
            raise FormatError(f"{key} is missing")
        return d[key]

    need(data, "version")
    kind = need(data, "model_type")
    if kind not in (UNIGRAM, BPE):
        raise Unsupported(f"models of type {kind}")
    vocab = need(data, "vocab")
    pieces, scores, types = (need(vocab, k) for k in ("pieces", "scores", "types"))
    if not len(pieces) == len(scores) == len(types):
        raise FormatError("pieces, scores and types differ in length")
    ids = need(data, "special_tokens")
    roles = {}
    for r in ("unk", "bos", "eos", "pad"):
        entry = need(ids, r)
        roles |= {f"{r}_id": entry["id"], f"{r}_piece": entry["piece"]}
    n = data.get("normalizer") or {}
    ops = []
    for o in n.get("operations") or []:
        blob = o.get("precompiled_charsmap")
        ops.append(NormalizerOp(need(o, "type"), o.get("pattern"), o.get("replacement"), _decode(blob, "charsmap") if blob else None))
    blob = _decode(n["precompiled_charsmap"], "charsmap") if n.get("precompiled_charsmap") else None
    spec = NormalizerSpec(n.get("normalizer_name", ""), n.get("add_dummy_prefix", True), n.get("remove_extra_whitespaces", True), n.get("escape_whitespaces", True), None if any(o.type == "Precompiled" for o in ops) else blob, tuple(ops))
    pre = None
    if (p := data.get("pre_tokenizer")) is not None:
        pre = PreTokenizerSpec(p.get("whitespace_split", False), p.get("use_metaspace", True), p.get("add_prefix_space", True), p.get("replacement", "▁"), p.get("split", True))
    if config is None:
        c = data.get("config") or {}
        config = Config(c.get("add_bos_token", False), c.get("add_eos_token", False), c.get("pair_eos_tokens_between_sequences", 1), c.get("pair_type_id", 1), c.get("pair_special_type_id", 1))
    trainer = Trainer(model_type=kind, byte_fallback=data.get("byte_fallback", False), fuse_unk=data.get("fuse_unk", False), **roles)
    made = tuple(Piece(a, float32(b), piece_type(c)) for a, b, c in zip(pieces, scores, types))
    return Tokenizer.from_model(Model(made, trainer, spec, pre), config)


def read(spark: SparkSession, path: str, config: Config | None = None) -> Tokenizer:
    """From a file in any store that Spark reads."""
    from wordloom.sources.model_file import read_bytes

    return load(read_bytes(spark, path).decode(), config)


def save(spark: SparkSession, tok: Tokenizer, path: str, pretty: bool = True) -> None:
    """One text file at path, through the file system of the path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where, True)
    out.write(bytearray(tok.to_json(pretty).encode()))
    out.close()
