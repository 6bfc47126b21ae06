"""Normalization and pre-tokenization: each operator as a native Column and as its twin on Python strings."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.slices import sliced
from wordloom.model import MARK, NormalizerSpec, PreTokenizerSpec, Unsupported
from wordloom.sources.charsmap import Charsmap

#: White space of the normalizer, and of pre-tokenizers and offsets (which also take line separators and the BOM).
SPACE = "\t-\r \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
WIDE_SPACE = SPACE + "\u2028\u2029\ufeff"
_SPACE_RUN = re.compile(f"[{SPACE}]+")
_SPACES = frozenset(chr(c) for c in (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))
WIDE_SPACES = _SPACES | {"\u2028", "\u2029", "\ufeff"}
CHUNKS = "array<struct<text:string,word_id:int>>"


def _java(chars: str) -> str:
    """A character class in ASCII, for regular expressions sent to the JVM."""
    return "".join(c if c == "-" else f"\\x{{{ord(c):X}}}" for c in chars)


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one space; one space at either edge goes."""
    return F.trim(F.regexp_replace(text, f"[{_java(SPACE)}]+", " "))


def dummy_prefix(text: Column) -> Column:
    """A space in front of a text that has none."""
    return F.when((text != "") & ~text.rlike(f"^[{_java(SPACE)}]"), F.concat(F.lit(" "), text)).otherwise(text)


def escape_whitespace(text: Column) -> Column:
    """N4"""
    return F.replace(text, F.lit(" "), F.lit(MARK))


def prepend(text: Column, prefix: str) -> Column:
    """N9"""
    return F.concat(F.lit(prefix), text)


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    """The replacement is literal."""
    return F.regexp_replace(text, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))


def charsmap_column(text: Column, blob: bytes) -> Column:
    """A character map, through Arrow batches."""

    held: list[Charsmap] = []

    def run(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(Charsmap.parse(blob))
        return pa.array([None if t is None else held[0].normalize(t) for t in batch.to_pylist()], pa.string())

    return sliced("string", run)(text)


def normalize(text: Column, spec: NormalizerSpec) -> Column:
    """The flag pipeline, or the list of operations where there is one."""
    if spec.operations:

        def step(t: Column, op) -> Column:
            if op.type == "Precompiled":
                return charsmap_column(t, op.charsmap)
            if op.type == "Prepend":
                return prepend(t, op.replacement)
            if op.type == "Replace":
                return replace_all(t, op.pattern, op.replacement)
            raise Unsupported(f"normalizer operation {op.type}")

        return F.when(text == "", text).otherwise(reduce(step, spec.operations, text))
    if spec.charsmap:
        text = charsmap_column(text, spec.charsmap)
    if spec.remove_extra_whitespaces:
        text = collapse_whitespace(text)
    if spec.add_dummy_prefix:
        text = dummy_prefix(text)
    return escape_whitespace(text) if spec.escape_whitespaces else text


def denormalize(text: Column, spec: NormalizerSpec) -> Column:
    """N5"""
    if spec.escape_whitespaces:
        text = F.replace(text, F.lit(MARK), F.lit(" "))
    return F.regexp_replace(text, "^ ", "") if spec.add_dummy_prefix else text


class TextNormalizer:
    """The same on Python strings."""

    def __init__(self, spec: NormalizerSpec):
        self.spec = spec
        self.map = Charsmap.parse(spec.charsmap) if spec.charsmap else None
        self.steps = []
        for op in spec.operations:
            if op.type == "Precompiled":
                self.steps.append(Charsmap.parse(op.charsmap).normalize)
            elif op.type == "Prepend":
                self.steps.append(lambda t, p=op.replacement: p + t)
            elif op.type == "Replace":
                self.steps.append(lambda t, p=re.compile(op.pattern), r=op.replacement: p.sub(lambda _: r, t))
            else:
                raise Unsupported(f"normalizer operation {op.type}")

    def normalize(self, text: str) -> str:
        if not text:
            return text
        if self.steps:
            return reduce(lambda t, f: f(t), self.steps, text)
        if self.map:
            text = self.map.normalize(text)
        if self.spec.remove_extra_whitespaces:
            text = _SPACE_RUN.sub(" ", text).strip(" ")
        if self.spec.add_dummy_prefix and text and text[0] not in _SPACES:
            text = " " + text
        return text.replace(" ", MARK) if self.spec.escape_whitespaces else text

    def denormalize(self, text: str) -> str:
        if self.spec.escape_whitespaces:
            text = text.replace(MARK, " ")
        return text[1:] if self.spec.add_dummy_prefix and text.startswith(" ") else text


def pretokenize(text: Column, spec: PreTokenizerSpec | None) -> Column:
    """Chunks (text, word_id) of a normalized text."""
    if spec is None or not spec.whitespace_split and not spec.use_metaspace:
        word = F.lit(None if spec is None else 0).cast("int")
        return F.array(F.struct(text.alias("text"), word.alias("word_id")))
    mark, wide = F.lit(spec.replacement), f"[{_java(WIDE_SPACE)}]"
    if spec.whitespace_split:
        words = F.filter(F.split(text, wide + "+"), lambda w: w != "")
        if not spec.use_metaspace:
            return F.transform(words, lambda w, i: F.struct(w.alias("text"), i.alias("word_id")))
        spaced = text.rlike("^" + wide)

        def marked(w: Column, i: Column) -> Column:
            bare = F.when(w.startswith(spec.replacement), F.substr(w, F.lit(len(spec.replacement) + 1))).otherwise(w)
            return F.struct(F.when(F.lit(spec.add_prefix_space) | (i > 0) | spaced, F.concat(mark, bare)).otherwise(bare).alias("text"), i.alias("word_id"))

        return F.transform(words, marked)
    quoted = re.escape(spec.replacement)
    text = replace_all(text, wide, spec.replacement)
    if spec.add_prefix_space:
        text = F.when((text != "") & ~text.startswith(spec.replacement), F.concat(mark, text)).otherwise(text)
    if not spec.split:
        return F.array(F.struct(text.alias("text"), F.lit(0).alias("word_id")))
    other = f"[^{_java(spec.replacement)}]+" if len(spec.replacement) == 1 else f"(?:(?!{quoted}).)+"
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?:{quoted})?{other}"), F.lit(0))
    return F.transform(parts, lambda w, i: F.struct(w.alias("text"), i.alias("word_id")))


class Chunk:
    """A piece of a normalized text with the source span of each of its characters."""

    __slots__ = ("text", "spans", "word", "marker", "with_marker")

    def __init__(self, text, spans, word, marker=0, with_marker=False):
        self.text, self.spans, self.word, self.marker, self.with_marker = text, spans, word, marker, with_marker


def chunks(text: str, spans: list, spec: PreTokenizerSpec | None) -> list[Chunk]:
    """W1 to W6 on a Python string."""
    if spec is None:
        return [Chunk(text, spans, None)]
    mark = spec.replacement
    size = len(mark)
    if spec.whitespace_split:
        out, i, spaced = [], 0, text[:1] in WIDE_SPACES and text != ""
        while i < len(text):
            if text[i] in WIDE_SPACES:
                i += 1
                continue
            j = i
            while j < len(text) and text[j] not in WIDE_SPACES:
                j += 1
            word, where = text[i:j], spans[i:j]
            if spec.use_metaspace and word.startswith(mark):
                word, where = word[size:], where[size:]
            lead = size if spec.use_metaspace and (spec.add_prefix_space or out or spaced) else 0
            out.append(Chunk(mark[:lead] + word, [None] * lead + where, len(out), lead))
            i = j
        return out
    if not spec.use_metaspace:
        return [Chunk(text, spans, 0)]
    spans = [s for c, s in zip(text, spans) for _ in range(size if c in WIDE_SPACES else 1)]
    text = "".join(mark if c in WIDE_SPACES else c for c in text)
    if spec.add_prefix_space and text and not text.startswith(mark):
        text, spans = mark + text, [None] * size + spans
    if not spec.split:
        return [Chunk(text, spans, 0, size if text.startswith(mark) else 0, True)]
    out, start = [], 0
    while start < len(text):
        body = start + size if text.startswith(mark, start) else start
        end = text.find(mark, body)
        end = len(text) if end < 0 else end
        if end > body:
            out.append(Chunk(text[start:end], spans[start:end], len(out), body - start, True))
        start = max(end, body)
    return out


_WIDE_RUN = re.compile("[" + re.escape("".join(sorted(WIDE_SPACES))) + "]+")


def chunk_texts(text: str, spec: PreTokenizerSpec | None) -> list[str]:
    """The texts of ``chunks`` alone."""
    if spec is None:
        return [text]
    if not spec.use_metaspace:
        return [w for w in _WIDE_RUN.split(text) if w] if spec.whitespace_split else [text]
    mark = spec.replacement
    if spec.whitespace_split:
        first = spec.add_prefix_space or text[:1] in WIDE_SPACES and text != ""
        return [(mark if first or i else "") + w.removeprefix(mark) for i, w in enumerate(w for w in _WIDE_RUN.split(text) if w)]
    text = _WIDE_RUN.sub(lambda m: mark * len(m[0]), text)
    if spec.add_prefix_space and text and not text.startswith(mark):
        text = mark + text
    if not spec.split:
        return [text]
    if len(mark) == 1:
        return re.findall(f"{re.escape(mark)}?[^{re.escape(mark)}]+", text)
    return [c.text for c in chunks(text, [None] * len(text), replace(spec, add_prefix_space=False))]
