"""Operator 1: benchmark decontamination by pigeonhole edit matching.

Texts and items are compared over their letters and digits, lower-cased, with
every run of other characters as one space.  An item of n characters has an
error budget of n // ``chars_per_error`` edits, whatever its length (a caller
may set a bound, ``max_errors``).  It is split into budget + 1 pieces, of which any place that matches within the
budget holds one unchanged; all pieces of a block of items are found by one
Aho-Corasick pass over each whole text, and the place around a hit is verified
with Myers' bit-parallel edit distance.

Items are a query set held against all texts in blocks of at most
``block_chars`` characters.  The texts are read once: a task holds some of them
(``HELD_BYTES``) and takes one block after another to them, so that it has one
block's automaton at a time, whatever the size of the benchmark.

An item without a budget (fewer than ``chars_per_error`` characters) must
stand as whole words; a longer one may begin or end inside a word.

Null and empty texts match nothing; items without letters or digits and null
items match nothing; repeated rows give repeated results; empty tables give
an empty result.  Of places of equal distance the first counts.  Only the
named columns are read, whatever other columns are named; ``drop_leaks``
passes all on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import text_of

CHARS_PER_ERROR = 16
BLOCK_CHARS = 4_000_000
HELD_BYTES = 32_000_000
_SCHEMA = "doc_id long, item_id long, distance int, item_chars int, end_char long"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
_NAMES = ["doc_id", "item_id", "distance", "item_chars", "end_char"]
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def budget(item: str, chars_per_error: int = CHARS_PER_ERROR, max_errors: int | None = None) -> int:
    errors = len(item) // chars_per_error
    return errors if max_errors is None else min(max_errors, errors)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their starts."""
    cut = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def myers_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, errors: int) -> tuple[int, int] | None:
    """(smallest distance of a pattern of length m to a substring of text, where that ends), if within errors."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, errors + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        plus = (mh << 1 | ~(xv | ph)) & full
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if end >= 0 else None


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], chars_per_error: int, max_errors: int | None = None):
        self.items, self.masks = [], {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            item = normalised(raw)
            if item:
                errors = budget(item, chars_per_error, max_errors)
                for start, piece in pieces(item, errors):
                    found.setdefault(piece, []).append((len(self.items), start))
                self.items.append((item_id, item, errors))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, smallest distance, item length, end of the place in the normalised text), an item once."""
        if not self.any:
            return []
        text = normalised(text)
        places: dict[int, list[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for i, start in where:
                places.setdefault(i, []).append(last + 1 - length - start)
        out = []
        for i, starts in places.items():
            item_id, item, errors = self.items[i]
            if not errors:
                whole = [a for a in starts if (a == 0 or text[a - 1] == " ") and (a + len(item) == len(text) or text[a + len(item)] == " ")]
                if whole:
                    out.append((item_id, 0, len(item), min(whole) + len(item)))
                continue
            masks = self.masks.get(i)
            if masks is None:
                masks = self.masks[i] = myers_masks(item)
            best, at = errors + 1, -1
            starts.sort()
            j = 0
            while j < len(starts) and best:
                begin = starts[j]
                end = begin
                while j < len(starts) and starts[j] <= end + 2 * errors + 1:
                    end = starts[j]
                    j += 1
                lo = max(0, begin - errors)
                got = myers(masks, len(item), text[lo : end + len(item) + errors], best - 1)
                if got:
                    best, at = got[0], lo + got[1]
            if at >= 0:
                out.append((item_id, best, len(item), at))
        return out


_BUILT: dict[str, Matcher] = {}


def _matcher(name: str, sent, chars_per_error: int, max_errors: int | None) -> Matcher:
    """The matcher of a block, built once for all tasks of a worker that follow each other; name tells blocks apart."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(sent.value, chars_per_error, max_errors)
    return _BUILT[name]


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, streamed to the driver and handed on in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if row[1]:
            block.append((row[0], row[1]))
            size += len(row[1])
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def _sent(items: DataFrame, block_chars: int) -> list[tuple[str, Broadcast]]:
    """The blocks of items, each of bounded size, as broadcasts with names of their own."""
    context = items.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast(block)) for block in _blocks(items, block_chars)]


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of about ``most`` bytes together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, chars_per_error: int = CHARS_PER_ERROR, max_errors: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, item_chars, end_char for every text of docs (doc_id, text) and item (item_id, text) that match.

    distance is the smallest over the text; end_char is where that place ends in the normalised text.
    """
    blocks = _sent(items, block_chars)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, HELD_BYTES):
            for name, sent in blocks:
                matcher = _matcher(name, sent, chars_per_error, max_errors)
                for batch in held:
                    rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for found in matcher.matches(text.as_py())]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS)], names=_NAMES)

    return own.mapInArrow(emit, _SCHEMA)


def drop_leaks(docs: DataFrame, items: DataFrame, chars_per_error: int = CHARS_PER_ERROR, max_errors: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (all columns) without the rows whose text holds an item; nothing is shuffled."""
    blocks = _sent(items, block_chars)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, HELD_BYTES):
            for name, sent in blocks:
                matcher = _matcher(name, sent, chars_per_error, max_errors)
                held = [batch.filter(pa.array([not matcher.matches(text or "") for text in batch.column(at).to_pylist()], pa.bool_())) for batch in held]
            yield from held

    return docs.mapInArrow(clean, docs.schema)
