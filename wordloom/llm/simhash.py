"""Operator 10: SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has a bit for each bit that is set in over half of the XXH64
hashes of a text's word shingles.  Two fingerprints link when they differ in
at most 4 of 64 bits.  Candidates: the 64 bits are cut into five parts, of
which a linked pair has at least one in common; of the other bits, two
disjoint segments of 23 are decoded to nearby Golay codewords.  The pair has at
most 2 errors in one of them, and then shares a codeword key there.  So a
fingerprint has 10 times 1 or 6 keys (part, its bits, segment, codeword), and
pairs with a common key are verified on all 64 bits.

Only distinct fingerprints are compared.  A task emits a spanning forest of the
links in its buckets, never all pairs.  Members of a bucket of over ``max_bucket``
fingerprints go another exact way: all words within 2 bits of each, grouped;
fingerprints that share such a word are within 4 bits, and those within 4 bits
share one.

Null text is empty; a text without words has fingerprint zero, which links as
any other; rows with a null doc_id keep it and take the smallest doc_id of
their component (null if it has none).  Repeated rows give repeated results; a
component is named by its smallest doc_id, so ties cannot change it.  An empty
table gives an empty table.  Only doc_id and text are read, whatever other
columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import golay
from wordloom.llm.common import materialize, text_of
from wordloom.llm.components import connected_components
from wordloom.llm.windows import mix

MAX_BUCKET = 4096
#: Fingerprints that a task remembers as joined.
FOREST = 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PARTS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
_ONE = np.uint64(1)


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words of UTF-8 data; words end at ASCII white space."""
    words = data.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    first, last = start[: len(words) - size + 1], (start + length)[size - 1 :]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(len(part), 64)
        whole = len(part) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if whole < len(part):
            total += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fingerprints of 64 bits as signed longs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([majority(shingle_hashes(text.as_buffer().to_pybytes(), shingle)) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(emit, "doc_id long, fp long")


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into fp) of every key of every fingerprint (uint64)."""
    keys, rows = [], []
    for i, (lo, hi) in enumerate(_PARTS):
        part = (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        above = fp >> np.uint64(hi) if hi < 64 else np.zeros_like(fp)
        rest = (fp & np.uint64((1 << lo) - 1)) | (above << np.uint64(lo))
        for j in range(2):
            word = (rest >> np.uint64(23 * j)) & np.uint64((1 << 23) - 1)
            code = golay.keys(word)
            row, col = np.nonzero(code >= 0)
            keys.append(((i * 2 + j) << 25) | (part[row].astype(np.int64) << 12) | code[row, col])
            rows.append(row)
    return np.concatenate(keys).astype(np.int32), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            key, row = bucket_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "fp"])


def spanning_links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of fingerprints within ``distance`` bits."""
    left = np.unique(fp)
    out = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                out.extend((int(at), int(x)) for x in found)
                queue.extend(found)
                left = left[~near]
    return out


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Whole buckets from rows sorted by key; of a bucket past the limit, pieces marked as such."""
    key, fp, huge = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if huge is not None:
            end = int(np.searchsorted(key, huge, "right"))
            yield key[:end], fp[:end], True
            key, fp, huge = key[end:], fp[end:], huge if end == len(key) else None
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield key[:cut], fp[:cut], False
        key, fp = key[cut:], fp[cut:]
        if len(key) > limit:
            huge = int(key[-1])
            yield key, fp, True
            key, fp = key[:0], fp[:0]
    if len(key):
        yield key, fp, False


class _Forest:
    """Which fingerprints a task has already joined; a link between two of them says nothing new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def _top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A mask of the links that join two parts; what is forgotten beyond the bound is only sent again."""
        if len(self.up) > FOREST:
            self.up.clear()
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = self._top(x), self._top(y)
            if x != y:
                self.up[x] = y
                out[i] = True
        return out


def _links(distance: int, max_bucket: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for key, fp, huge in _runs(batches, max_bucket):
            if huge:
                yield _pairs(fp, fp)
                continue
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(edge)
            a, b = [], []
            # small buckets: neighbours at every step, for all buckets at once
            small = np.repeat(size <= 8, size)
            k, f = key[small], fp[small]
            for step in range(1, 8):
                hit = np.flatnonzero((k[step:] == k[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= distance))
                a.append(f[hit])
                b.append(f[hit + step])
            for i in np.flatnonzero(size > 8):
                part = fp[edge[i] : edge[i + 1]]
                if len(part) > max_bucket:
                    yield _pairs(part, part)
                elif found := spanning_links(part, distance):
                    x = np.array(found, np.uint64)
                    a.append(x[:, 0])
                    b.append(x[:, 1])
            if a and sum(map(len, a)):
                a, b = np.concatenate(a), np.concatenate(b)
                fresh = forest.new(a, b)
                if fresh.any():
                    yield _pairs(a[fresh], b[fresh])

    return emit


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _near_words(distance: int):
    """All words within half of ``distance`` bits of each fingerprint, and for an odd distance each edge between two words that differ in one bit."""
    bit = _ONE << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    moves = np.concatenate([np.zeros(1, np.uint64), bit, bit[i] ^ bit[j]][: distance // 2 + 1], axis=None)
    # an odd distance: fingerprints meet at an edge, named by the word with the edge's bit cleared and that bit
    edges = np.arange(64, dtype=np.uint64) if distance % 2 else None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 64):
                part = fp[at : at + 64]
                words = (part[:, None] ^ moves[None, :]).reshape(-1)
                if edges is not None:
                    words = mix((words[:, None] & ~bit[None, :]) ^ mix(edges + _ONE)[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.repeat(part, len(words) // len(part)).view(np.int64))], names=["key", "fp"])

    return emit


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: each fingerprint of a key links to the key's first one."""
    last_key, last_fp = None, None
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        head = fp[first].copy()
        if last_key is not None and key[0] == last_key:
            head[0] = last_fp
        head = np.repeat(head, np.diff(np.append(first, len(key))))
        last_key, last_fp = key[-1], head[-1]
        apart = head != fp
        if apart.any():
            both = np.unique(np.stack((head[apart], fp[apart])), axis=1)
            yield _pairs(both[0].view(np.uint64), both[1].view(np.uint64))


def links(distinct: DataFrame, distance: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``distinct`` (fp) within ``distance`` <= 4 bits."""
    if not 0 <= distance <= 4:
        raise ValueError("five parts serve distances up to 4")
    found = materialize(distinct.mapInArrow(_emit_keys, "key int, fp long").repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance, max_bucket), "a long, b long"), "links")
    hot = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return found
    stars = hot.mapInArrow(_near_words(distance), "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stars, "a long, b long")
    return found.where("a <> b").unionByName(stars)


def _components(prints: DataFrame, distance: int, max_bucket: int) -> DataFrame:
    """(fp, component_id) for every fingerprint: the smallest doc_id over all texts of its component."""
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    roots = connected_components(links(least.select("fp"), distance, max_bucket))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs (doc_id, text)."""
    prints = materialize(fingerprints(docs, shingle), "prints")
    component = _components(prints, distance, max_bucket)
    return prints.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
