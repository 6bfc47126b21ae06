"""The encoding of one text: eight parallel lists, and their algebra on Python values (columns.py has the same on Columns)."""

from __future__ import annotations

from dataclasses import dataclass, fields
from itertools import compress

from wordloom.model import DO_NOT_TRUNCATE, LONGEST_FIRST, ONLY_FIRST, ONLY_SECOND

FIELDS = ("tokens", "ids", "type_ids", "attention_mask", "special_tokens_mask", "offsets", "word_ids", "sequence_ids")
NO_SPAN = (0, 0)


@dataclass(frozen=True)
class Encoding:
    tokens: list[str]
    ids: list[int]
    type_ids: list[int]
    attention_mask: list[int]
    special_tokens_mask: list[int]
    offsets: list[tuple[int, int]]
    word_ids: list[int | None]
    sequence_ids: list[int | None]

    @staticmethod
    def empty() -> Encoding:
        return Encoding(*([] for _ in FIELDS))

    @staticmethod
    def content(rows, type_id: int = 0, sequence_id: int | None = None) -> Encoding:
        """Of rows (id, token, offset, word id); the sequence is the type where none is given."""
        n = len(rows)
        return Encoding([r[1] for r in rows], [r[0] for r in rows], [type_id] * n, [1] * n, [0] * n, [r[2] for r in rows], [r[3] for r in rows], [type_id if sequence_id is None else sequence_id] * n)

    @staticmethod
    def special(token: str, token_id: int, type_id: int = 0) -> Encoding:
        return Encoding([token], [token_id], [type_id], [1], [1], [NO_SPAN], [None], [None])

    @staticmethod
    def joined(parts: list[Encoding]) -> Encoding:
        """Parts behind each other, with nothing shifted."""
        return Encoding(*([x for p in parts for x in getattr(p, f)] for f in FIELDS))

    def __len__(self) -> int:
        return len(self.ids)

    def to_map(self) -> dict:
        return {f.name: [list(x) for x in self.offsets] if f.name == "offsets" else list(getattr(self, f.name)) for f in fields(self)}

    def _slice(self, start: int, end: int) -> Encoding:
        return Encoding(*(getattr(self, f)[start:end] for f in FIELDS))

    def with_padding(self, target: int, pad_id: int, pad_token: str = "[PAD]", right: bool = True, pad_type_id: int = 0) -> Encoding:
        """P1"""
        n = target - len(self)
        if n <= 0:
            return self
        fill = Encoding([pad_token] * n, [pad_id] * n, [pad_type_id] * n, [0] * n, [1] * n, [NO_SPAN] * n, [None] * n, [None] * n)
        return Encoding.joined([self, fill] if right else [fill, self])

    def pad_to_multiple(self, multiple: int, pad_id: int, pad_token: str = "[PAD]", right: bool = True, pad_type_id: int = 0) -> Encoding:
        """P2"""
        return self if multiple <= 0 else self.with_padding(len(self) + -len(self) % multiple, pad_id, pad_token, right, pad_type_id)

    def with_truncation(self, max_length: int, from_end: bool = True, keep_special: bool = False) -> Encoding:
        """T1, T2"""
        if len(self) <= max_length:
            return self
        if not keep_special:
            return self._slice(0, max_length) if from_end else self._slice(len(self) - max_length, len(self))
        content = [i for i, m in enumerate(self.special_tokens_mask) if m == 0]
        room = max(max_length - sum(m == 1 for m in self.special_tokens_mask), 0)
        kept = set(content[:room] if from_end else content[max(len(content) - room, 0) :])
        where = [m == 1 or i in kept for i, m in enumerate(self.special_tokens_mask)]
        out = Encoding(*(list(compress(getattr(self, f), where)) for f in FIELDS))
        special = [m == 1 for m in out.special_tokens_mask]
        return Encoding(
            out.tokens, out.ids, out.type_ids, [1] * len(out), out.special_tokens_mask, [NO_SPAN if s else o for s, o in zip(special, out.offsets)],
            [None if s else w for s, w in zip(special, out.word_ids)], [None if s else t if q is None else q for s, q, t in zip(special, out.sequence_ids, out.type_ids)],
        )

    @staticmethod
    def truncate_pair(a: Encoding, b: Encoding, max_length: int, strategy: str = LONGEST_FIRST, n_special: int = 3) -> tuple[Encoding, Encoding]:
        """T4 to T6"""
        room = max_length - n_special
        if room <= 0:
            return Encoding.empty(), Encoding.empty()
        left, right = pair_lengths(len(a), len(b), room, strategy)
        return a.with_truncation(left), b.with_truncation(right)

    @staticmethod
    def merge(parts: list[Encoding], growing_offsets: bool = True) -> Encoding:
        """M1"""
        if len(parts) == 1:
            return parts[0]
        out, shift, words = [], 0, 0
        for p in parts:
            moved = [(s + shift, e + shift) if (s, e) != NO_SPAN else NO_SPAN for s, e in p.offsets] if growing_offsets else p.offsets
            out.append(Encoding(p.tokens, p.ids, p.type_ids, p.attention_mask, p.special_tokens_mask, moved, [None if w is None else w + words for w in p.word_ids], p.sequence_ids))
            shift += max((e for s, e in p.offsets if (s, e) != NO_SPAN), default=0)
            words += max((w for w in p.word_ids if w is not None), default=0) + 1
        return Encoding.joined(out)

    # C1 to C7
    def char_to_token(self, pos: int, sequence: int = 0) -> int | None:
        return next((i for i, (q, (s, e)) in enumerate(zip(self.sequence_ids, self.offsets)) if q == sequence and s <= pos < e), None)

    def char_to_word(self, pos: int, sequence: int = 0) -> int | None:
        i = self.char_to_token(pos, sequence)
        return None if i is None else self.word_ids[i]

    def token_to_chars(self, i: int) -> tuple[int, int] | None:
        if not 0 <= i < len(self) or self.special_tokens_mask[i] == 1 and self.offsets[i] == NO_SPAN:
            return None
        return self.offsets[i]

    def token_to_word(self, i: int) -> int | None:
        return self.word_ids[i] if 0 <= i < len(self) else None

    def token_to_sequence(self, i: int) -> int | None:
        return self.sequence_ids[i] if 0 <= i < len(self) else None

    def _of_word(self, word: int, sequence: int) -> list[int]:
        return [i for i, (q, w) in enumerate(zip(self.sequence_ids, self.word_ids)) if q == sequence and w == word]

    def word_to_chars(self, word: int, sequence: int = 0) -> tuple[int, int] | None:
        found = self._of_word(word, sequence)
        return (min(self.offsets[i][0] for i in found), max(self.offsets[i][1] for i in found)) if found else None

    def word_to_tokens(self, word: int, sequence: int = 0) -> tuple[int, int] | None:
        found = self._of_word(word, sequence)
        return (found[0], found[-1] + 1) if found else None

    @property
    def n_sequences(self) -> int:
        return 2 if 1 in self.sequence_ids else 1 if 0 in self.sequence_ids else 0


def pair_lengths(a: int, b: int, room: int, strategy: str) -> tuple[int, int]:
    """Lengths of two sequences that are cut to ``room`` together."""
    excess = a + b - room
    if excess <= 0 or strategy == DO_NOT_TRUNCATE:
        return a, b
    if strategy == ONLY_FIRST:
        return max(a - excess, 0), b
    if strategy == ONLY_SECOND:
        return a, max(b - excess, 0)
    lead = min(abs(a - b), excess)  # the longer one loses its lead first
    a, b, rest = (a - lead, b, excess - lead) if a > b else (a, b - lead, excess - lead)
    return a - rest // 2, b - (rest + 1) // 2


class EncodingBuilder:
    """An encoding put together token by token."""

    def __init__(self):
        self.parts: list[Encoding] = []

    def add_token(self, token: str, token_id: int, type_id: int, offset: tuple[int, int], word_id: int | None = None, sequence_id: int | None = None) -> EncodingBuilder:
        self.parts.append(Encoding.content([(token_id, token, offset, word_id)], type_id, sequence_id))
        return self

    def add_special_token(self, token: str, token_id: int, type_id: int = 0) -> EncodingBuilder:
        self.parts.append(Encoding.special(token, token_id, type_id))
        return self

    def build(self) -> Encoding:
        return Encoding.joined(self.parts)

    def clear(self) -> None:
        self.parts = []
