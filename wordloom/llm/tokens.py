"""Exact and fast token ids and counts of the public tokenizers, inside one Python worker.

Byte-level BPE splits a text into pre-tokens that are encoded on their own, so
a count can come from any implementation of the same vocabulary, and ids can
be put together from cached ids of white-space-free chunks.  Both are used
only for texts of characters whose class, case and normal form all libraries
agree on; any other text, and any text that may hold a special token, goes to
the vocabulary's own library whole.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin letters, digits, punctuation and the usual white space.
_PLAIN = re.compile("[\t\n\r -~\u00a0-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
#: The same without \u0130, whose lower case is two characters, for Arrow's regular expressions.
_NOT_PLAIN = r"[^\t\n\r -~\x{a0}-\x{b1}\x{b4}-\x{b8}\x{ba}\x{bb}\x{bf}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]"
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Chunks that a worker remembers with their ids, and chunks that are encoded as one text.
_CACHE, _JOINED = 800_000, 500


def default_path(name: str) -> str:
    """Where the installed vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ByteCounter:
    """Token counts as the library of a byte-level .json vocabulary gives them."""

    def __init__(self, path: str):
        self.path, self.own, self.fast = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.basename(path) == "byte_bpe_50k.json" and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def count(self, text: str) -> int:
        if self.fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
            return len(self.fast.encode_ordinary(text))
        if self.own is None:
            self.own = _library(self.path)
        return len(self.own.encode(text, add_special_tokens=False).ids)


class PieceCounter:
    """Token counts of a sentencepiece .model vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.own.encode(text))


def counter(path: str) -> ByteCounter | PieceCounter:
    return PieceCounter(path) if path.endswith(".model") else ByteCounter(path)


class WordEncoder:
    """Ids of word_bpe_49k.json (lower case, white space dropped, pre-tokens on their own), for Arrow arrays of texts.

    Texts are split at white space and the distinct chunks of an array are numbered, all in Arrow.  Chunks that no
    array before held go to the library as one text; its word-end tokens show where each pre-token ends, and the
    number of pre-tokens in a chunk where the chunk ends.  A text's ids are then gathered by the numbers of its chunks.
    """

    def __init__(self, path: str):
        self.own = _library(path)
        self.fast = os.path.basename(path) == "word_bpe_49k.json"
        vocabulary = self.own.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.word_end[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.edge = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, chunks: pa.Array) -> None:
        low = pc.utf8_lower(chunks)
        words = pc.count_substring_regex(low, _PRE_TOKEN).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [" ".join(low.slice(at, _JOINED).to_pylist()) for at in range(0, len(low), _JOINED)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.own.encode_batch_fast(parts, add_special_tokens=False)])
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) == words.sum() and len(ids) == ends[-1]:
            size = np.diff(ends[np.cumsum(words) - 1], prepend=0)
        else:
            each = [self._exact(c) for c in chunks.to_pylist()]
            ids, size = np.concatenate(each), np.array([len(x) for x in each])
        self.known = pa.concat_arrays([self.known, chunks])
        self.ids = np.concatenate((self.ids, ids))
        self.edge = np.concatenate((self.edge, self.edge[-1] + np.cumsum(size)))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.utf8_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary
        if len(self.known) > _CACHE:
            self._forget()
        place = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        empty = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
        fresh = (place < 0) & ~empty
        if fresh.any():
            place[fresh] = len(self.known) + np.arange(int(fresh.sum()))
            self._learn(distinct.filter(pa.array(fresh)))
        # empty chunks (at the ends of a text) get the place behind the last one, without ids
        place[empty] = len(self.known)
        start, size = self.edge[np.minimum(place, len(self.known))], np.append(np.diff(self.edge), 0)[place]
        at = chunks.indices.to_numpy(zero_copy_only=False)
        sizes = size[at]
        stop = np.cumsum(sizes)
        ids = self.ids[np.repeat(start[at] - (stop - sizes), sizes) + np.arange(int(sizes.sum()))]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.concatenate(([0], stop))[offsets]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, little-endian and unsigned."""
        texts = texts.cast(pa.large_string())
        plain = pc.invert(pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _NOT_PLAIN))) if self.fast else pa.array(np.zeros(len(texts), bool))
        ids, edge = self._plain(texts.filter(plain))
        out, k = [], 0
        for text, quick in zip(texts, plain.to_pylist()):
            if quick:
                out.append(ids[edge[k] : edge[k + 1]])
                k += 1
            else:
                out.append(self._exact(text.as_py()))
        return out


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker, so that what it learns stays."""
    return WordEncoder(path)
