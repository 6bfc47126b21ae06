"""A small fixed model whose vocabulary also fits into a SQL statement.

Scores are multiples of 1/256, so that sums are exact.
"""

from __future__ import annotations

from wordloom.model import BPE, BYTE, CONTROL, MARK, NORMAL, UNKNOWN, Config, Model, NormalizerSpec, Piece, Trainer
from wordloom.operators.tokenizer import Tokenizer

_LETTERS = "abcdefghijklmnopqrstuvwxyABDEHILOSTWäöüéèêçñóíá.,"
_PARTS = "th he er in on re an en ti te es or ed nd ha at is it al st le ng sh wh ou ing ion ent the tion ble eau ier ung sch ich keit heit os as cion lle ment"
_STARTS = "t a o the of and in de la le un der die que los el is was to"


def pieces() -> list[Piece]:
    texts = [MARK, *_LETTERS, *_PARTS.split(), *(MARK + x for x in _STARTS.split())]
    scored = [Piece(t, -(2 + 4 / len(t) + (37 * i * i + 11 * i) % 251 / 256) // (1 / 256) / 256, NORMAL) for i, t in enumerate(texts)]
    return [Piece("<unk>", -20.0, UNKNOWN), Piece("<s>", 0.0, CONTROL), Piece("</s>", 0.0, CONTROL), *scored]


def tokenizer(kind: str = "unigram", config: Config = Config.gemma(), fuse: bool = False) -> Tokenizer:
    trainer = Trainer(model_type=kind, pad_id=2, fuse_unk=fuse)
    return Tokenizer.from_model(Model(tuple(pieces()), trainer, NormalizerSpec()), config)


def bpe() -> Tokenizer:
    return tokenizer(BPE)


#: Score of each byte piece.
BYTE_SCORE = -6.5


def bytes_tokenizer() -> Tokenizer:
    """The same pieces, with all bytes behind them."""
    more = [Piece(f"<0x{b:02X}>", BYTE_SCORE, BYTE) for b in range(256)]
    return Tokenizer.from_model(Model((*pieces(), *more), Trainer(pad_id=2, byte_fallback=True), NormalizerSpec()), Config.gemma())


def sql_values() -> str:
    """(id, piece, score, type) rows of a VALUES list."""
    return ", ".join(f"({i}, '{p.piece}', {p.score!r}::DOUBLE, {p.type})" for i, p in enumerate(pieces()))


LONGEST = max(len(p.piece) for p in pieces() if p.type == NORMAL)
