"""A tokenizer: a model, its settings, and encoding of single Python strings with all metadata."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from functools import cached_property

from wordloom.functions.textops import WIDE_SPACES, TextNormalizer, chunk_texts, chunks
from wordloom.model import BYTE, CHAR, LONGEST_FIRST, MAX_CODE_UNITS, WORD, AddedToken, Config, Model, NormalizerSpec, Padding, PreTokenizerSpec, Truncation, Unsupported, Vocabulary
from wordloom.operators.encoding import Encoding, pair_lengths
from wordloom.operators.kernels import Bpe, Unigram, algorithm, fuse_unknown

#: Chunks kept in a worker with their ids: so many, of at most so many characters.
MEMO_SIZE, MEMO_CHARS = 500_000, 64
Row = tuple[int, str, tuple[int, int], int | None]  # id, token, offset, word id


def code_units(text: str) -> int:
    """The length of a text in UTF-16, which the input limit counts."""
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


def _is_word(c: str) -> bool:
    return c == "_" or c.isascii() and c.isalnum() or c > "\x7f" and c not in WIDE_SPACES


def _same(source: str, normal: str) -> bool:
    return source == normal or source == "\u3000" and normal == " " or "\uff01" <= source <= "\uff5e" and chr(ord(source) - 0xFEE0) == normal


def align(source: str, normal: str) -> list[tuple[int, int] | None]:
    """The source span of each character of a normalized text, by one pass over both."""
    out, at, last = [], 0, None
    n = len(source)
    for c in normal:
        if at < n and source[at] == c and c not in WIDE_SPACES:
            last, at = (at, at + 1), at + 1
            out.append(last)
            continue
        if c in WIDE_SPACES:
            if at < n and source[at] in WIDE_SPACES:
                end = at + 1
                while end < n and source[end] in WIDE_SPACES:
                    end += 1
                last, at = (at, end), end
                out.append(last)
            else:
                out.append(None)
            continue
        hit = at
        while hit < n and not _same(source[hit], c) and source[hit] in WIDE_SPACES:
            hit += 1
        if hit < n and _same(source[hit], c):
            last, at = (hit, hit + 1), hit + 1
        elif at < n:
            last, at = (at, at + 1), at + 1
        out.append(last)
    return out


def _span(spans: list, start: int, end: int, marker: int, with_marker: bool) -> tuple[int, int]:
    """The source span of a token; the marker in front counts as its last character, or not at all."""
    if not marker:  # spans never go back, so the first and the last one tell
        end = min(end, len(spans))
        while start < end and spans[start] is None:
            start += 1
        while start < end and spans[end - 1] is None:
            end -= 1
        return (spans[start][0], spans[end - 1][1]) if start < end else (0, 0)
    found = []
    for i in range(start, min(end, len(spans))):
        lead = i < start + marker
        if spans[i] is not None and (with_marker or not lead):
            found.append((spans[i][1] - 1, spans[i][1]) if lead else spans[i])
    if found:
        return min(s for s, _ in found), max(e for _, e in found)
    return (0, 1) if start < end and marker and not start else (0, 0)


@dataclass(frozen=True)
class Tokenizer:
    vocab: Vocabulary
    normalizer: NormalizerSpec = NormalizerSpec()
    pre_tokenizer: PreTokenizerSpec | None = None
    config: Config = Config()
    added_tokens: tuple[AddedToken, ...] = ()
    padding: Padding | None = None
    truncation: Truncation | None = None
    forward_bytes: bool = False
    utf8_bytes: bool = False

    @staticmethod
    def from_model(model: Model, config: Config = Config(), added_tokens: tuple[AddedToken, ...] = ()) -> Tokenizer:
        if model.trainer.model_type in (WORD, CHAR):
            raise Unsupported(f"models of type {model.trainer.model_type}")
        return Tokenizer(Vocabulary(model.pieces, model.trainer), model.normalizer, model.pre_tokenizer, config, tuple(added_tokens))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    @cached_property
    def _normal(self) -> TextNormalizer:
        return TextNormalizer(self.normalizer)

    @cached_property
    def segmenter(self) -> Unigram | Bpe:
        return algorithm(self.vocab, forward_bytes=self.forward_bytes) if self.vocab.trainer.model_type == "unigram" else algorithm(self.vocab)

    # settings (P5, T3)
    def with_padding(self, **options) -> Tokenizer:
        return replace(self, padding=Padding(**options))

    def no_padding(self) -> Tokenizer:
        return replace(self, padding=None)

    def with_truncation(self, max_length: int, **options) -> Tokenizer:
        return replace(self, truncation=Truncation(max_length, **options))

    def no_truncation(self) -> Tokenizer:
        return replace(self, truncation=None)

    @property
    def pad_id(self) -> int:
        """P4"""
        if self.padding is not None and self.padding.pad_id is not None:
            return self.padding.pad_id
        return max(self.vocab.trainer.pad_id, 0)

    @property
    def pad_token(self) -> str:
        return self.padding.pad_token if self.padding is not None and self.padding.pad_token is not None else self.vocab.trainer.pad_piece

    def ends(self, add_special: bool | None = None) -> tuple[int | None, int | None]:
        """Ids in front of and behind a text; an explicit choice holds for both."""
        t = self.vocab.trainer
        bos = self.config.add_bos if add_special is None else add_special
        eos = self.config.add_eos if add_special is None else add_special
        return (t.bos_id if bos and t.bos_id >= 0 else None), (t.eos_id if eos and t.eos_id >= 0 else None)

    def num_special_tokens(self, add_bos: bool | None = None, add_eos: bool | None = None, pair: bool = False) -> int:
        """E7"""
        t = self.vocab.trainer
        bos = (self.config.add_bos if add_bos is None else add_bos) and t.bos_id >= 0
        eos = (self.config.add_eos if add_eos is None else add_eos) and t.eos_id >= 0
        return int(bos) + int(eos) + (self.config.pair_eos_between if pair and eos else 0)

    # vocabulary
    def add_tokens(self, tokens: list[str]) -> tuple[Tokenizer, int]:
        vocab, count = self.vocab.add_tokens(tokens)
        return replace(self, vocab=vocab), count

    def add_special_tokens(self, tokens: dict[str, str]) -> tuple[Tokenizer, int]:
        vocab, count = self.vocab.add_special_tokens(tokens)
        return replace(self, vocab=vocab), count

    def get_vocab(self, with_added: bool = True) -> dict[str, int]:
        added = set() if with_added else set(self.vocab.added)
        return {p: i for p, i in self.vocab.index.items() if i not in added}

    def added_vocab(self) -> dict[str, int]:
        return {self.vocab.pieces[i].piece: i for i in self.vocab.added}

    def is_added(self, token_id: int) -> bool:
        return token_id in set(self.vocab.added)

    def is_added_token(self, piece: str) -> bool:
        return self.is_added(self.vocab.index.get(piece, -1))

    # one text
    def guard(self, text: str) -> None:
        if code_units(text) > MAX_CODE_UNITS:
            raise ValueError(f"text of more than {MAX_CODE_UNITS} code units")

    def _plain(self, text: str, shift: int = 0) -> list[Row]:
        normal = self._normal.normalize(text)
        out: list[Row] = []
        for chunk in chunks(normal, align(text, normal), self.pre_tokenizer):
            at = 0
            for i in self._chunk_ids(chunk.text):
                token, start = self.vocab.id_to_piece(i), at
                if chunk.text.startswith(token, at):
                    at += len(token)
                elif at < len(chunk.text):
                    at += 1
                s, e = _span(chunk.spans, start, at, chunk.marker, chunk.with_marker)
                out.append((i, token, (s + shift, e + shift), chunk.word))
        return out

    def _content_end(self, text: str, start: int, content: str, normalized: bool) -> int | None:
        end = start + len(content)
        if not normalized:
            return end if text.startswith(content, start) else None
        if text.startswith(content, start) and self._normal.normalize(text[start:end]) == content:
            return end
        for end in range(start + 1, min(len(text), end + 32) + 1):
            if self._normal.normalize(text[start:end]) == content:
                return end
        return None

    @cached_property
    def _matchable(self) -> list[tuple[AddedToken, str]]:
        pairs = [(t, self._normal.normalize(t.content) if t.normalized else t.content) for t in self.added_tokens]
        return [(t, c) for t, c in pairs if c]

    @cached_property
    def _first(self) -> re.Pattern | None:
        """Characters that an added token can begin with; None where a normalized one may begin with any."""
        if any(t.normalized for t, _ in self._matchable):
            return None
        chars = {c[0] for _, c in self._matchable} | (set(WIDE_SPACES) if any(t.lstrip for t, _ in self._matchable) else set())
        return re.compile("[" + "".join(map(re.escape, sorted(chars))) + "]")

    def added_matches(self, text: str) -> list[tuple[int, int, AddedToken]]:
        """At each place the token that spans most, of those the one declared first."""
        out, at, n = [], 0, len(text)
        while at < n and self._matchable:
            if self._first is not None:
                hit = self._first.search(text, at)
                if hit is None:
                    break
                at = hit.start()
            best = None
            for token, content in self._matchable:
                start = at
                if token.lstrip:
                    while start < n and text[start] in WIDE_SPACES:
                        start += 1
                end = self._content_end(text, start, content, token.normalized)
                if end is None:
                    continue
                if token.rstrip:
                    while end < n and text[end] in WIDE_SPACES:
                        end += 1
                if token.single_word and (start > 0 and _is_word(text[start - 1]) or end < n and _is_word(text[end])):
                    continue
                if best is None or end > best[1]:
                    best = (at, end, token)
            if best is None:
                at += 1
            else:
                out.append(best)
                at = best[1]
        return out

    def rows(self, text: str) -> list[Row]:
        """Tokens of a text without special tokens around it."""
        out: list[Row] = []
        at = 0
        for start, end, token in self.added_matches(text):
            if at < start:
                out += self._plain(text[at:start], at)
            out.append((token.id, token.content, (start, end), None))
            at = end
        if at < len(text) or not out:
            out += self._plain(text[at:], at)
        return out

    # encodings
    def _special(self, role: str, type_id: int = 0) -> Encoding:
        t = self.vocab.trainer
        return Encoding.special(getattr(t, f"{role}_piece"), getattr(t, f"{role}_id"), type_id)

    def _cut(self, e: Encoding) -> Encoding:
        t = self.truncation
        return e if t is None else e.with_truncation(t.max_length, t.right, True)

    def finish(self, e: Encoding, cut: bool = True) -> Encoding:
        """Of one text: truncation, then padding to a length, then to a multiple; there is no batch to pad to."""
        e, p = self._cut(e) if cut else e, self.padding
        if p is not None and p.length is not None:
            e = e.with_padding(p.length, self.pad_id, self.pad_token, p.right, p.pad_type_id)
        if p is not None and p.multiple is not None:
            e = e.pad_to_multiple(p.multiple, self.pad_id, self.pad_token, p.right, p.pad_type_id)
        return e

    def bare(self, text: str, add_special: bool | None = None) -> Encoding:
        """A text with its special tokens, neither cut nor padded."""
        bos, eos = self.ends(add_special)
        body = Encoding.content(self.rows(text))
        return Encoding.joined([*([self._special("bos")] if bos is not None else []), body, *([self._special("eos")] if eos is not None else [])])

    def bare_pair(self, a: str, b: str, add_special: bool | None = None, max_length: int | None = None, strategy: str | None = None) -> tuple[Encoding, bool]:
        """(two texts with their special tokens, whether a limit was there to cut them to)."""
        bos, eos = self.ends(add_special)
        c, t = self.config, self.truncation
        limit = max_length if max_length is not None else t.max_length if t else None
        first, second = Encoding.content(self.rows(a), 0, 0), Encoding.content(self.rows(b), c.pair_type_id, 1)
        if limit is not None:
            n_special = (bos is not None) + (0 if eos is None else 1 + c.pair_eos_between)
            first, second = Encoding.truncate_pair(first, second, limit, strategy or (t.strategy if t else LONGEST_FIRST), n_special)
        end = [] if eos is None else [self._special("eos", c.pair_special_type_id)]
        return Encoding.joined([*([self._special("bos")] if bos is not None else []), first, *end * c.pair_eos_between, second, *end]), limit is not None

    def finish_pair(self, made: tuple[Encoding, bool]) -> Encoding:
        e, limited = made
        return self.finish(e, not limited)

    def encode(self, text: str, add_special: bool | None = None) -> Encoding:
        self.guard(text)
        return self.finish(self.bare(text, add_special))

    def encode_pair(self, a: str, b: str, add_special: bool | None = None, max_length: int | None = None, strategy: str | None = None) -> Encoding:
        self.guard(a)
        self.guard(b)
        return self.finish_pair(self.bare_pair(a, b, add_special, max_length, strategy))

    def pair_length(self, a: str, b: str, add_special: bool | None = None, max_length: int | None = None, strategy: str | None = None) -> int:
        """The length of ``finish_pair(bare_pair(...))`` without padding, from ids alone."""
        bos, eos = self.ends(add_special)
        t = self.truncation
        limit = max_length if max_length is not None else t.max_length if t else None
        n_special = (bos is not None) + (0 if eos is None else 1 + self.config.pair_eos_between)
        n_a, n_b = len(self.ids(a)), len(self.ids(b))
        if limit is not None:
            room = limit - n_special
            n_a, n_b = pair_lengths(n_a, n_b, room, strategy or (t.strategy if t else LONGEST_FIRST)) if room > 0 else (0, 0)
        return n_a + n_b + n_special

    def _pad_all(self, batch: list[Encoding]) -> list[Encoding]:
        p = self.padding
        if p is None or not batch:
            return batch
        size = p.length if p.length is not None else max(map(len, batch))
        size += -size % p.multiple if p.multiple else 0
        return [e.with_padding(size, self.pad_id, self.pad_token, p.right, p.pad_type_id) for e in batch]

    def encode_batch(self, texts: list[str], add_special: bool | None = None) -> list[Encoding]:
        for t in texts:
            self.guard(t)
        return self._pad_all([self._cut(self.bare(t, add_special)) for t in texts])

    def encode_pair_batch(self, pairs: list[tuple[str, str]], add_special: bool | None = None, max_length: int | None = None, strategy: str | None = None) -> list[Encoding]:
        for pair in pairs:
            for t in pair:
                self.guard(t)
        made = [self.bare_pair(a, b, add_special, max_length, strategy) for a, b in pairs]
        return self._pad_all([e if limited else self._cut(e) for e, limited in made])

    # ids alone, with each chunk of a text segmented once a worker
    @cached_property
    def _parts(self) -> re.Pattern | None:
        return re.compile("\u2581+[^\u2581]*|[^\u2581]+") if self._chunks_cut_at_marks else None

    @cached_property
    def _memo(self) -> dict[str, list[int]]:
        return {}

    @cached_property
    def _word_segmenter(self):
        """Without fusing: that is for whole chunks."""
        return algorithm(self.vocab, fuse=False, forward_bytes=self.forward_bytes) if self.vocab.trainer.model_type == "unigram" else self.segmenter

    def _chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        memo = self._memo
        for part in self._parts.findall(chunk) if self._parts else (chunk,):
            ids = memo.get(part)
            if ids is None:
                ids = self._word_segmenter.tokenize(part)
                if len(part) <= MEMO_CHARS:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[part] = ids
            out += ids
        return fuse_unknown(out, self.vocab.trainer.unk_id) if getattr(self.segmenter, "fuse", False) else out

    def ids(self, text: str) -> list[int]:
        """Ids of a text without special tokens around it; the same as those of ``rows``."""
        out, at = [], 0
        for start, end, token in [*self.added_matches(text), (len(text), len(text), None)]:
            if at < start:
                for chunk in chunk_texts(self._normal.normalize(text[at:start]), self.pre_tokenizer):
                    out += self._chunk_ids(chunk)
            if token is not None:
                out.append(token.id)
            at = end
        return out

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text without special tokens around it; the same as those of ``rows``."""
        out, at = [], 0
        for start, end, token in [*self.added_matches(text), (len(text), len(text), None)]:
            if at < start:
                for chunk in chunk_texts(self._normal.normalize(text[at:start]), self.pre_tokenizer):
                    out += map(self.vocab.id_to_piece, self._chunk_ids(chunk))
            if token is not None:
                out.append(token.content)
            at = end
        return out

    def tokenize(self, text: str) -> list[str]:
        """E6"""
        self.guard(text)
        return [r[1] for r in self.rows(text)]

    def decode(self, ids: list[int], skip_special: bool = True) -> str:
        """D1; byte pieces give the character of their value, or with utf8_bytes the UTF-8 text of a run of them."""
        out, run = [], bytearray()
        for i in ids:
            kind = self.vocab.type(i)
            if kind == BYTE:
                run.append(int(self.vocab.pieces[i].piece[3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8" if self.utf8_bytes else "latin-1", "replace"))
                run = bytearray()
            if not (skip_special and self.vocab.is_special(i)):
                out.append(self.vocab.id_to_piece(i))
        if run:
            out.append(run.decode("utf-8" if self.utf8_bytes else "latin-1", "replace"))
        return self._normal.denormalize("".join(out))

    @cached_property
    def _chunks_cut_at_marks(self) -> bool:
        """Whether a chunk, which lies between added tokens, may be cut before each run of marks and each part encoded on its own, with the same ids.

        So if no piece continues from another character into a mark, the mark is a piece, and no chunk can meet a dead end.
        """
        from wordloom.model import MARK

        v, t = self.vocab, self.vocab.trainer
        if MARK not in v.index:
            return False
        if any(MARK in p.piece.lstrip(MARK) for p in v.pieces):
            return False
        if t.model_type == "unigram":
            if t.byte_fallback and len(v.byte_ids) < 256 or not t.byte_fallback and not 0 <= t.unk_id < len(v):
                return False
            return all(p.score > float("-inf") for p in v.pieces)
        return True

    @property
    def cuts_at_marks(self) -> bool:
        """The same of a text: added tokens may lie anywhere in one."""
        return not self.added_tokens and self._chunks_cut_at_marks

    @property
    def counts_by_words(self) -> bool:
        """Whether the tokens of a text without marks are those of its words, each as a text."""
        return self.cuts_at_marks and self.pre_tokenizer is None and not getattr(self.segmenter, "fuse", False) and self.normalizer == NormalizerSpec()

    def to_json(self, pretty: bool = False) -> str:
        from wordloom.sources.own_json import dump

        return json.dumps(dump(self), ensure_ascii=False, indent=2 if pretty else None)
