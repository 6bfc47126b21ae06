"""Segmentation of one chunk of text: best Unigram path, and pair merges."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from wordloom.model import BPE, UNIGRAM, Unsupported, Vocabulary

_NONE = float("-inf")


class Unigram:
    """The path of largest score; ties go to the path found first (longer last piece)."""

    def __init__(self, vocab: Vocabulary, fuse: bool | None = None, forward_bytes: bool = False):
        t = vocab.trainer
        self.vocab, self.unk, self.bytes = vocab, t.unk_id, t.byte_fallback
        self.fuse = t.fuse_unk if fuse is None else fuse
        self.forward_bytes = forward_bytes
        self.scores = {p: (i, vocab.pieces[i].score) for p, i in vocab.index.items() if p}
        self.sizes = sorted({len(p) for p in self.scores})
        first: dict[str, set[int]] = {}
        for p in self.scores:
            first.setdefault(p[0], set()).add(len(p))
        self.by_first = {c: sorted(s) for c, s in first.items()}

    def _bytes(self, char: str) -> list[int] | None:
        ids = [self.vocab.byte_ids.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return None if None in ids else ids

    def tokenize(self, text: str) -> list[int]:
        n = len(text)
        best, back = [_NONE] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        scores = self.scores
        for i in range(n):
            base, found = best[i], False
            if base == _NONE:
                continue
            for size in self.by_first.get(text[i], ()):
                if i + size > n:
                    break
                hit = scores.get(text[i : i + size])
                if hit is not None:
                    found = True
                    if base + hit[1] > best[i + size]:
                        best[i + size], back[i + size] = base + hit[1], (i, (hit[0],))
            if found:
                continue
            if self.bytes:
                ids = self._bytes(text[i])
                if ids is None:
                    continue
                value = base + sum(self.vocab.score(x) for x in ids)
                edge = (i, tuple(ids if self.forward_bytes else ids[::-1]))
            else:
                value, edge = base + self.vocab.score(self.unk), (i, (self.unk,))
            if value > best[i + 1]:
                best[i + 1], back[i + 1] = value, edge
        if n and back[n] is None:
            out = self._greedy(text)
        else:
            parts, at = [], n
            while at:
                parts.append(back[at][1])
                at = back[at][0]
            out = [x for part in reversed(parts) for x in part]
        return fuse_unknown(out, self.unk) if self.fuse else out

    def _greedy(self, text: str) -> list[int]:
        out, i = [], 0
        while i < len(text):
            sizes = [s for s in self.by_first.get(text[i], ()) if text[i : i + s] in self.scores and i + s <= len(text)]
            if sizes:
                out.append(self.scores[text[i : i + sizes[-1]]][0])
                i += sizes[-1]
                continue
            if self.bytes and self.vocab.byte_ids:
                out += [self.vocab.byte_ids.get(b, self.unk) for b in text[i].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
            i += 1
        return out


def fuse_unknown(ids: list[int], unk: int) -> list[int]:
    return [x for i, x in enumerate(ids) if x != unk or not i or ids[i - 1] != unk]


class Bpe:
    """Merges of neighbours whose joined text is a piece: largest score first, leftmost on ties, with a heap."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.bytes = vocab, vocab.trainer.byte_fallback
        self.scores = {p: vocab.pieces[i].score for p, i in vocab.index.items()}

    def symbols(self, text: str) -> list[str]:
        out = []
        for c in text:
            if c in self.scores or not self.bytes:
                out.append(c)
            else:
                ids = (self.vocab.byte_ids.get(b) for b in c.encode("utf-8", "surrogatepass"))
                out += [self.vocab.trainer.unk_piece if i is None else self.vocab.id_to_piece(i) for i in ids]
        return out

    def tokenize(self, text: str) -> list[int]:
        sym = self.symbols(text)
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            joined = sym[i] + sym[j]
            score = self.scores.get(joined)
            if score is not None:
                heapq.heappush(heap, (-score, i, joined, j))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined, j = heapq.heappop(heap)
            # both sides must still be what they were when the pair was offered
            if sym[i] is None or right[i] != j or sym[j] is None or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [self.vocab.piece_to_id(s) for s in sym if s is not None]


def naive_bpe(vocab: Vocabulary, text: str) -> list[int]:
    """The definition of Bpe, by scanning all neighbours before each merge."""
    own = Bpe(vocab)
    sym = own.symbols(text)
    while True:
        found = [(own.scores[a + b], -i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if a + b in own.scores]
        if not found:
            return [vocab.piece_to_id(s) for s in sym]
        i = -max(found)[1]
        sym[i : i + 2] = [sym[i] + sym[i + 1]]


def algorithm(vocab: Vocabulary, **options) -> Unigram | Bpe:
    """A15"""
    kind = vocab.trainer.model_type
    if kind == UNIGRAM:
        return Unigram(vocab, **options)
    if kind == BPE:
        return Bpe(vocab)
    raise Unsupported(f"models of type {kind}")


Segmenter = Callable[[str], list[int]]


class PrefixTable:
    """A1 to A3: pieces by their text, with prefix searches by length."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.longest = 0

    def insert(self, piece: str, i: int) -> None:
        self.ids[piece] = i
        self.longest = max(self.longest, len(piece))

    def lookup(self, piece: str) -> int | None:
        return self.ids.get(piece)

    def __contains__(self, piece: str) -> bool:
        return piece in self.ids

    def __len__(self) -> int:
        return len(self.ids)

    def clear(self) -> None:
        self.ids, self.longest = {}, 0

    def prefixes(self, text: str, start: int = 0) -> list[tuple[str, int, int, int]]:
        """(piece, id, start, end) of every piece at a place, shorter ones first."""
        ends = range(start + 1, min(len(text), start + self.longest) + 1)
        return [(p, self.ids[p], start, e) for e in ends if (p := text[start:e]) in self.ids]

    def longest_prefix(self, text: str, start: int = 0) -> tuple[str, int, int, int] | None:
        found = self.prefixes(text, start)
        return found[-1] if found else None
