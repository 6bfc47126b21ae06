"""tokenizer.json pipelines: model, added tokens, normalizer, pre-tokenizer, post-processor, decoder, settings."""

from __future__ import annotations

import base64
import binascii
import json
import re
import warnings
from dataclasses import dataclass, replace

from wordloom.model import (
    BPE,
    BYTE,
    CONTROL,
    MARK,
    NORMAL,
    UNIGRAM,
    UNKNOWN,
    AddedToken,
    Config,
    FormatError,
    Model,
    NormalizerOp,
    NormalizerSpec,
    Padding,
    Piece,
    PreTokenizerSpec,
    Trainer,
    Truncation,
    Unsupported,
    byte_value,
    float32,
)
from wordloom.operators.tokenizer import Tokenizer
from wordloom.sources.charsmap import Charsmap

_ROLES = {"unk": ("<unk>", "[UNK]"), "bos": ("<s>", "<bos>", "[BOS]"), "eos": ("</s>", "<eos>", "[EOS]"), "pad": ("<pad>", "[PAD]")}


def load(source: str | dict, config: Config | None = None) -> Tokenizer:
    """A tokenizer from the text or the parsed object of a tokenizer.json."""
    data = json.loads(source) if isinstance(source, str) else source
    section = data.get("model")
    if section is None:
        raise FormatError("no model section")
    kind = model_kind(section)
    added = [AddedToken(e["id"], e["content"], bool(e.get("special")), bool(e.get("single_word")), bool(e.get("lstrip")), bool(e.get("rstrip")), e.get("normalized", True)) for e in data.get("added_tokens") or []]
    trainer = Trainer()
    for token in added:
        for role, names in _ROLES.items():
            if token.special and token.content in names:
                trainer = replace(trainer, **{f"{role}_id": token.id, f"{role}_piece": token.content})
    normal = parse_normalizer(data.get("normalizer"))
    pre = parse_pre_tokenizer(data.get("pre_tokenizer"), normal.no_spaces)
    spec = normal.spec
    if pre is not None and pre.use_metaspace:
        spec = replace(spec, escape_whitespaces=True, add_dummy_prefix=spec.add_dummy_prefix or pre.add_prefix_space)
    trainer = replace(trainer, byte_fallback=has_byte_fallback(data.get("decoder")))
    special = {t.content for t in added if t.special}
    if kind == "Unigram":
        pieces, trainer = unigram_pieces(section, trainer, special)
    elif kind == "BPE":
        pieces, trainer = bpe_pieces(section, trainer, special)
    else:
        raise Unsupported(f"model type {kind}")
    if config is None:
        config = parse_post_processor(data.get("post_processor"), trainer)
    out = Tokenizer.from_model(Model(pieces, trainer, spec, pre), config, tuple(added))
    vocab = out.vocab
    for token in sorted(added, key=lambda t: t.id):
        if token.id >= len(pieces) or token.content not in vocab.index:
            vocab = vocab.add_at(token.id, token.content, token.special)
    return replace(out, vocab=vocab, truncation=parse_truncation(data.get("truncation")), padding=parse_padding(data.get("padding")))


def model_kind(section: dict) -> str:
    """The declared type, else Unigram for a list of pieces and BPE for a map."""
    vocab = section.get("vocab")
    kind = section.get("type") or (("Unigram" if isinstance(vocab, list) else "BPE") if vocab and isinstance(vocab, (list, dict)) else None)
    if kind is None:
        raise FormatError("no model type")
    return kind


def unigram_pieces(section: dict, trainer: Trainer, special: set[str]) -> tuple[tuple[Piece, ...], Trainer]:
    """S6"""
    vocab = section.get("vocab")
    if not isinstance(vocab, list):
        raise FormatError("a Unigram vocab is a list")
    unk = section.get("unk_id")
    unk = trainer.unk_id if unk is None else unk
    out = []
    for i, (piece, score) in enumerate(vocab):
        kind = UNKNOWN if i == unk else CONTROL if piece in special else BYTE if byte_value(piece) is not None else NORMAL
        out.append(Piece(piece, float32(score), kind))
    name = out[unk].piece if 0 <= unk < len(out) else trainer.unk_piece
    return tuple(out), replace(trainer, model_type=UNIGRAM, unk_id=unk, unk_piece=name, fuse_unk=section.get("fuse_unk", True))


def parse_merges(merges: list) -> list[tuple[str, str]]:
    """Pairs from "left right" strings and two-item lists; anything else is passed over, but keeps its rank."""
    out = []
    for m in merges:
        if isinstance(m, str) and " " in m:
            left, _, right = m.partition(" ")
            out.append((left, right))
        elif isinstance(m, list) and len(m) == 2:
            out.append((str(m[0]), str(m[1])))
        else:
            out.append(None)
    return out


def bpe_pieces(section: dict, trainer: Trainer, special: set[str]) -> tuple[tuple[Piece, ...], Trainer]:
    """A merge result scores minus its rank (its last one), other pieces lie below all merges."""
    vocab = section.get("vocab")
    if not isinstance(vocab, dict):
        raise FormatError("a BPE vocab is a map")
    merges = parse_merges(section.get("merges") or [])
    rank = {m[0] + m[1]: i for i, m in enumerate(merges) if m}
    rest = -float(len(merges) + 1)
    size = len(vocab)
    out = [Piece("") for _ in range(size)]
    for piece, i in vocab.items():
        if not 0 <= i < size:
            continue
        kind = UNKNOWN if i == trainer.unk_id else CONTROL if piece in special else BYTE if byte_value(piece) is not None else NORMAL
        score = 0.0 if kind in (UNKNOWN, CONTROL) else -float(rank[piece]) if piece in rank else rest
        out[i] = Piece(piece, float32(score), kind)
    fallback = trainer.byte_fallback or bool(section.get("byte_fallback"))
    return tuple(out), replace(trainer, model_type=BPE, byte_fallback=fallback, fuse_unk=bool(section.get("fuse_unk")))


def has_byte_fallback(decoder: dict | None) -> bool:
    """S10"""
    if not decoder:
        return False
    return decoder.get("type") == "ByteFallback" or decoder.get("type") == "Sequence" and any(map(has_byte_fallback, decoder.get("decoders") or []))


@dataclass(frozen=True)
class _Normal:
    spec: NormalizerSpec
    no_spaces: bool = False  # proven: no literal space is left (N12)


def _decode(text: str, what: str) -> bytes:
    try:
        return base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError) as e:
        raise FormatError(f"{what}: {e}") from e


def parse_normalizer(data: dict | None) -> _Normal:
    """Operations run in order only where there is a charsmap; other pipelines come down to the flags."""
    if data is None:
        return _Normal(NormalizerSpec(remove_extra_whitespaces=False))
    flags = {"add_dummy_prefix": False, "escape_whitespaces": False}
    ops: list[NormalizerOp] = []
    proven = False

    def visit(node: dict) -> None:
        nonlocal proven
        kind = node.get("type")
        if kind == "Sequence":
            inner = node.get("normalizers")
            if not isinstance(inner, list) or not all(isinstance(x, dict) for x in inner):
                raise FormatError("a normalizer Sequence needs a list of objects")
            for x in inner:
                visit(x)
        elif kind == "Precompiled":
            text = node.get("precompiled_charsmap")
            if not isinstance(text, str) or not text:
                raise FormatError("Precompiled without a charsmap")
            blob = _decode(text, "charsmap")
            Charsmap.parse(blob)
            ops.append(NormalizerOp(kind, charsmap=blob))
            proven = False
        elif kind == "Prepend":
            prefix = node.get("prepend")
            if not isinstance(prefix, str):
                raise FormatError("Prepend without a string")
            flags["add_dummy_prefix"] |= prefix in (MARK, " ")
            proven = proven and " " not in prefix
            ops.append(NormalizerOp(kind, replacement=prefix))
        elif kind == "Replace":
            pattern, content = node.get("pattern"), node.get("content")
            if not isinstance(pattern, dict):
                raise FormatError("Replace without a pattern")
            if not isinstance(content, str):
                raise FormatError("Replace without content")
            regex, literal = pattern.get("Regex"), pattern.get("String")
            if isinstance(regex, str):
                source = regex
            elif isinstance(literal, str):
                source = re.escape(literal)
            else:
                raise Unsupported("Replace patterns other than Regex and String")
            try:
                re.compile(source)
            except re.error as e:
                raise FormatError(f"Replace pattern: {e}") from e
            flags["escape_whitespaces"] |= content == MARK
            alone = literal if len(pattern) == 1 else None
            if alone == " " and content == MARK:
                proven = True
            elif alone in (" ", MARK) or " " in content or isinstance(regex, str):
                proven = False
            ops.append(NormalizerOp(kind, source, content))
        else:
            raise Unsupported(f"normalizer {kind}")

    visit(data)
    keep = any(op.type == "Precompiled" for op in ops)
    return _Normal(NormalizerSpec(remove_extra_whitespaces=False, operations=tuple(ops) if keep else (), **flags), proven)


def parse_pre_tokenizer(data: dict | None, no_spaces: bool) -> PreTokenizerSpec | None:
    """Metaspace, WhitespaceSplit, a Split that cannot match, and sequences of them."""
    if data is None:
        return None
    kind = data.get("type")
    if kind == "Sequence":
        inner = data.get("pretokenizers")
        if not isinstance(inner, list) or not all(isinstance(x, dict) for x in inner):
            raise FormatError("a pre-tokenizer Sequence needs a list of objects")
        split, meta = False, None
        for x in inner:
            if x.get("type") == "Sequence":
                raise Unsupported("nested pre-tokenizer Sequence")
            got = parse_pre_tokenizer(x, no_spaces)
            if got.use_metaspace:
                if meta:
                    raise Unsupported("two Metaspace pre-tokenizers")
                meta = got
            elif got.whitespace_split:
                if meta:
                    raise Unsupported("WhitespaceSplit after Metaspace")
                split = True
        return replace(meta, whitespace_split=split) if meta else PreTokenizerSpec(split, False)
    if kind == "WhitespaceSplit":
        return PreTokenizerSpec(True, False)
    if kind == "Metaspace":
        return _metaspace(data)
    if kind == "Split" and no_spaces and data.get("pattern") == {"String": " "} and not data.get("invert"):
        return PreTokenizerSpec(False, False)
    raise Unsupported(f"pre-tokenizer {json.dumps(data)}")


def _metaspace(data: dict) -> PreTokenizerSpec:
    """W8"""
    mark = data.get("replacement", MARK)
    if not mark:
        raise FormatError("an empty Metaspace replacement")
    prefix = data.get("add_prefix_space")
    if prefix is None:
        scheme = data.get("prepend_scheme")
        if scheme not in (None, "always", "first", "never"):
            raise Unsupported(f"prepend_scheme {scheme}")
        prefix = scheme != "never"
    return PreTokenizerSpec(False, True, prefix, mark, data.get("split", True))


def parse_post_processor(data: dict | None, trainer: Trainer) -> Config:
    """S9"""
    if not data:
        return Config()
    if data.get("type") != "TemplateProcessing":
        warnings.warn(f"post-processor {data.get('type')} adds no tokens", stacklevel=2)
        return Config()

    def token(entry) -> str | None:
        return entry["SpecialToken"].get("id") if isinstance(entry, dict) and isinstance(entry.get("SpecialToken"), dict) else None

    single = data.get("single") or []
    bos = bool(single) and token(single[0]) == trainer.bos_piece
    eos = bool(single) and token(single[-1]) == trainer.eos_piece
    pair = data.get("pair")
    if pair is None:
        return Config(bos, eos)
    count, type_id, special_type = 0, 1, 1
    for entry in pair:
        if not isinstance(entry, dict):
            continue
        seq = entry.get("Sequence")
        if isinstance(seq, dict) and seq.get("id") == "B":
            type_id = seq.get("type_id", type_id)
        if token(entry) == trainer.eos_piece:
            count += 1
            special_type = entry["SpecialToken"].get("type_id", special_type)
    return Config(bos, eos, count - (1 if eos and count else 0), type_id, special_type)


def parse_truncation(data: dict | None) -> Truncation | None:
    """S12"""
    if not data:
        return None
    size = data.get("max_length")
    if not isinstance(size, int) or size <= 0:
        raise FormatError("truncation needs a positive max_length")
    if data.get("stride"):
        raise Unsupported("truncation with a stride")
    names = {"longestfirst": "longest_first", "onlyfirst": "only_first", "onlysecond": "only_second"}
    strategy = str(data.get("strategy", "LongestFirst")).lower().replace("_", "")
    if strategy not in names:
        raise Unsupported(f"truncation strategy {data.get('strategy')}")
    return Truncation(size, _right(data.get("direction")), names[strategy])


def _right(direction: str | None) -> bool:
    word = str(direction or "right").lower()
    if word not in ("left", "right"):
        raise FormatError(f"direction {direction}")
    return word == "right"


def parse_padding(data: dict | None) -> Padding | None:
    if not data:
        return None
    strategy = data.get("strategy")
    length = strategy.get("Fixed") if isinstance(strategy, dict) else None
    return Padding(_right(data.get("direction")), length, data.get("pad_to_multiple_of") or None, data.get("pad_id"), data.get("pad_token"), data.get("pad_type_id") or 0)
