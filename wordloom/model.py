"""Immutable descriptions of a subword model and of how texts are encoded with it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np

MARK = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECE_TYPES = (NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE)
UNIGRAM, BPE, WORD, CHAR = "unigram", "bpe", "word", "char"
MODEL_TYPES = {1: UNIGRAM, 2: BPE, 3: WORD, 4: CHAR}
LONGEST_FIRST, ONLY_FIRST, ONLY_SECOND, DO_NOT_TRUNCATE = "longest_first", "only_first", "only_second", "do_not_truncate"
STRATEGIES = (LONGEST_FIRST, ONLY_FIRST, ONLY_SECOND, DO_NOT_TRUNCATE)
MAX_CODE_UNITS = 500_000


class FormatError(ValueError):
    """A model file or document that breaks its format."""


class Unsupported(NotImplementedError):
    """A well-formed feature that this engine does not have."""


def piece_type(code: int) -> int:
    """A piece type code; unknown codes are normal pieces."""
    return code if code in PIECE_TYPES else NORMAL


def float32(x: float) -> float:
    """Scores are kept with single precision and summed with double."""
    return float(np.float32(x))


@dataclass(frozen=True)
class Piece:
    piece: str
    score: float = 0.0
    type: int = NORMAL


@dataclass(frozen=True)
class Trainer:
    model_type: str = UNIGRAM
    unk_id: int = 0
    bos_id: int = 1
    eos_id: int = 2
    pad_id: int = -1
    unk_piece: str = "<unk>"
    bos_piece: str = "<s>"
    eos_piece: str = "</s>"
    pad_piece: str = "<pad>"
    byte_fallback: bool = False
    fuse_unk: bool = False


@dataclass(frozen=True)
class NormalizerOp:
    """Precompiled (charsmap), Prepend (replacement) or Replace (pattern: a regular expression, replacement: literal)."""

    type: str
    pattern: str | None = None
    replacement: str | None = None
    charsmap: bytes | None = None


@dataclass(frozen=True)
class NormalizerSpec:
    name: str = ""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes | None = None
    operations: tuple[NormalizerOp, ...] = ()


@dataclass(frozen=True)
class PreTokenizerSpec:
    whitespace_split: bool = False
    use_metaspace: bool = True
    add_prefix_space: bool = True
    replacement: str = MARK
    split: bool = True


@dataclass(frozen=True)
class Config:
    add_bos: bool = False
    add_eos: bool = False
    pair_eos_between: int = 1
    pair_type_id: int = 1
    pair_special_type_id: int = 1

    @staticmethod
    def gemma() -> Config:
        return Config(add_bos=True, add_eos=True)

    @staticmethod
    def llama() -> Config:
        return Config(add_bos=True)


@dataclass(frozen=True)
class AddedToken:
    id: int
    content: str
    special: bool = False
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = True


@dataclass(frozen=True)
class Padding:
    right: bool = True
    length: int | None = None
    multiple: int | None = None
    pad_id: int | None = None
    pad_token: str | None = None
    pad_type_id: int = 0


@dataclass(frozen=True)
class Truncation:
    max_length: int
    right: bool = True
    strategy: str = LONGEST_FIRST


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id and the reverse; the last id of a repeated piece wins in the reverse."""

    pieces: tuple[Piece, ...]
    trainer: Trainer = Trainer()
    added: tuple[int, ...] = field(default=())
    added_special: tuple[int, ...] = field(default=())

    @cached_property
    def index(self) -> dict[str, int]:
        return {p.piece: i for i, p in enumerate(self.pieces)}

    @cached_property
    def longest(self) -> int:
        return max((len(p.piece) for p in self.pieces), default=0)

    @cached_property
    def byte_ids(self) -> dict[int, int]:
        if not self.trainer.byte_fallback:
            return {}
        return {b: i for i, p in enumerate(self.pieces) if p.type == BYTE and (b := byte_value(p.piece)) is not None}

    def __len__(self) -> int:
        return len(self.pieces)

    def piece_to_id(self, piece: str) -> int:
        return self.index.get(piece, self.trainer.unk_id)

    def id_to_piece(self, i: int) -> str:
        return self.pieces[i].piece if 0 <= i < len(self.pieces) else self.trainer.unk_piece

    def score(self, i: int) -> float:
        return self.pieces[i].score if 0 <= i < len(self.pieces) else float("-inf")

    def type(self, i: int) -> int:
        return self.pieces[i].type if 0 <= i < len(self.pieces) else UNKNOWN

    def is_special(self, i: int) -> bool:
        return self.type(i) in (CONTROL, UNKNOWN)

    def is_byte(self, i: int) -> bool:
        return self.type(i) == BYTE

    def _grown(self, pieces: list[Piece], **ids) -> Vocabulary:
        return replace(self, pieces=tuple(pieces), **ids)

    def add_tokens(self, tokens: list[str]) -> tuple[Vocabulary, int]:
        """Append tokens that the vocabulary lacks, with score 0; a token repeated in one call is appended each time."""
        fresh = [t for t in tokens if t not in self.index]
        first = len(self.pieces)
        ids = tuple(range(first, first + len(fresh)))
        return self._grown([*self.pieces, *(Piece(t, 0.0, USER_DEFINED) for t in fresh)], added=self.added + ids), len(fresh)

    def add_special_tokens(self, tokens: dict[str, str]) -> tuple[Vocabulary, int]:
        """Append new control pieces by role; pad, bos and eos roles (``pad_token`` or ``pad``) take the token's id; known pieces keep their type."""
        now, count = self, 0
        for role, token in tokens.items():
            i = now.index.get(token)
            if i is None:
                i = len(now.pieces)
                now = now._grown([*now.pieces, Piece(token, 0.0, CONTROL)], added=now.added + (i,), added_special=now.added_special + (i,))
                count += 1
            role = role.removesuffix("_token")
            if role in ("pad", "bos", "eos"):
                now = replace(now, trainer=replace(now.trainer, **{f"{role}_id": i, f"{role}_piece": token}))
        return now, count

    def add_at(self, i: int, token: str, special: bool = False) -> Vocabulary:
        """A token at a fixed id; gaps become empty pieces, another piece there is an error."""
        if i < 0:
            raise ValueError(f"negative token id {i}")
        if i < len(self.pieces) and self.pieces[i].piece not in ("", token):
            raise FormatError(f"id {i} holds {self.pieces[i].piece!r}, not {token!r}")
        if self.index.get(token, i) != i:
            raise FormatError(f"{token!r} has id {self.index[token]}, not {i}")
        pieces = [*self.pieces, *(Piece("", 0.0, NORMAL) for _ in range(i + 1 - len(self.pieces)))]
        if pieces[i].piece != token:
            pieces[i] = Piece(token, 0.0, CONTROL if special else USER_DEFINED)
        new = () if i in self.added else (i,)
        return self._grown(pieces, added=self.added + new, added_special=self.added_special + (new if special else ()))


def byte_value(piece: str) -> int | None:
    """42 of <0x2A>; null for other pieces."""
    if len(piece) != 6 or not piece.startswith("<0x") or piece[5] != ">":
        return None
    try:
        return int(piece[3:5], 16)
    except ValueError:
        return None


@dataclass(frozen=True)
class Model:
    pieces: tuple[Piece, ...]
    trainer: Trainer = Trainer()
    normalizer: NormalizerSpec = NormalizerSpec()
    pre_tokenizer: PreTokenizerSpec | None = None
