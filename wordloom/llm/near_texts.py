"""Operator 10 as a filter: near-dedup of a corpus by SimHash and Golay codes, verified by true similarity.

Two texts link when the Jaccard similarity of their sets of word shingles is
``similarity`` or more; groups are the components of these links.  Steps:

1. Texts with one set of shingles are one node.  A node has a sketch of
   ``WORDS`` SimHash words of 64 bits, each from hashes mixed anew.
2. Every word has the keys of ``simhash`` (an exact part and the codewords near
   a segment); words that share a key and differ in at most ``NEAR_BITS`` bits
   give a candidate pair of nodes, kept if the whole sketches differ in at
   most ``SKETCH_BITS``.  Of a dense family only trees and what joins them are
   kept.  A pair of similarity 0.8 differs in 15 bits of a hundred and shares a
   key of one word 4 times in ten, of any of eight words 98 times in a hundred;
   at 0.85 and 0.9 that is 99 and more (simulated; the tests measure it).  A
   bucket of over ``max_bucket`` words goes to step 3 whole, as a star,
   whatever the bits say.
3. The nodes of each component of candidates meet in a task with their
   shingles, and links are found among all of them (not only the candidates)
   by prefix filter and verified on the whole sets.  A component of over
   ``max_set`` shingles is cut into blocks and each pair of blocks meets
   somewhere: the same answer, without a bound on the component.
4. Components of the verified links.

Shingles are those of ``simhash``: ASCII lower case, words end at ASCII white
space, a text of fewer words is one shingle; equality of shingles goes by
64-bit hashes.

Null text is empty; texts without words are one group.  Rows without doc_id
come after all others; rows of one doc_id and different texts are judged
apart, rows of one doc_id and one text leave one.  Ties are broken by doc_id,
then by a hash of the text, so the result does not depend on the order of the
rows.  An empty table gives an empty table; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import content_key, materialize, text_of, unused
from wordloom.llm.components import PART_EDGES, connected_components
from wordloom.llm.simhash import MAX_BUCKET, _pairs, _runs, bucket_keys, shingle_hashes, spanning_links
from wordloom.llm.windows import mix

SIMILARITY = 0.8
SHINGLE = 5
#: Words of a sketch (at most 8: the number of a word takes three bits of a key), and bits in which a word, and all of a sketch, may differ.
WORDS, NEAR_BITS, SKETCH_BITS = 8, 12, 128
MAX_SET = 4_000_000
#: Bits of a word up to which a candidate stands for the others of its tree.
SAME_BITS = 6
#: Pairs that a task remembers as sent.
_SENT = 500_000
_KEY = ["none", "id", "k", "k2"]
_WORDS = [f"w{i}" for i in range(WORDS)]


def shingle_set(data: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(data, size))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits, each bit set if it is in over half of the hashes of a set, mixed anew for each word."""
    total = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), 255 * 16):
        part = hashes[at : at + 255 * 16]
        many = np.stack([part, *(mix(part ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, WORDS))])
        bits = np.unpackbits(many.astype(">u8").view(np.uint8), axis=1).reshape(WORDS, len(part), 64)
        whole = len(part) // 255 * 255
        if whole:
            total += bits[:, :whole].reshape(WORDS, -1, 255, 64).sum(axis=2, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        total += bits[:, whole:].sum(axis=1, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), axis=1).view(">u8").reshape(WORDS).astype(np.uint64)


def _prints(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            words = np.zeros((WORDS, batch.num_rows), np.uint64)
            for i, text in enumerate(batch.column(4)):
                hashes = shingle_set(text.as_buffer().to_pybytes(), size)
                name = xxhash.xxh64_intdigest(hashes.tobytes(), 7)
                node[i], n[i] = name - 2**64 if name >= 2**63 else name, len(hashes)
                words[:, i] = sketch(hashes)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(node), pa.array(n), *map(pa.array, words.view(np.int64))], names=[*_KEY, "node", "n", *_WORDS])

    return emit


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for every key of every (k, fp), the number of the word in the key's upper bits."""
    for batch in batches:
        k, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            key, row = bucket_keys(part)
            key = key.view(np.uint32) | k[at : at + 4096][row].astype(np.uint32) << np.uint32(29)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int32)), pa.array(part[row].view(np.int64))], names=["key", "fp"])


def _candidates(max_bucket: int):
    """(k, a, b, sure) from rows sorted by key: links of a forest in each bucket; a star, marked sure, in one that is too large."""

    def batch_of(k: np.ndarray, a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), sure))], names=["k", "a", "b", "sure"])

    def word_of(key: np.ndarray) -> np.ndarray:
        return (key & 0xFFFFFFFF) >> 29

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int, int]] = set()
        star: tuple[int, np.uint64] | None = None
        for key, fp, huge in _runs(batches, max_bucket):
            if huge:
                if not len(key):
                    continue
                if star is None or star[0] != key[0]:
                    star = (int(key[0]), fp[0])
                yield batch_of(word_of(key), np.full(len(fp), star[1]), fp, True)
                continue
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(edge)
            found = []
            small = np.repeat(size <= 4, size)
            k, f = key[small], fp[small]
            for step in range(1, 4):
                hit = np.flatnonzero((k[step:] == k[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= NEAR_BITS))
                found.append((word_of(k[hit]), f[hit], f[hit + step]))
            for i in np.flatnonzero(size > 4):
                part = fp[edge[i] : edge[i + 1]]
                one = word_of(key[edge[i] : edge[i] + 1])
                if len(part) > max_bucket:
                    yield batch_of(np.full(len(part), one[0]), np.full(len(part), part[0]), part, True)
                elif pairs := spanning_links(part, NEAR_BITS):
                    x = np.array(pairs, np.uint64)
                    found.append((np.full(len(x), one[0]), x[:, 0], x[:, 1]))
            k, a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
            fresh = []
            for i, pair in enumerate(zip(k.tolist(), np.minimum(a, b).tolist(), np.maximum(a, b).tolist())):
                if pair not in sent:
                    fresh.append(i)
                    if len(sent) < _SENT:
                        sent.add(pair)
            if fresh:
                yield batch_of(k[fresh], a[fresh], b[fresh], False)

    return emit


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the candidates (k, a, b, sure) of a part those that say something new: a dense family has far more than words.

    Words that differ in few bits (``SAME_BITS``) grow trees, of which the links stay; other candidates stay where they
    join two trees, as do those of stars.
    """
    rows = list(batches)
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    k, a, b, sure = (table.column(i).to_numpy() for i in range(4))
    close = np.bitwise_count((a ^ b).view(np.uint64)) <= SAME_BITS
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x: tuple[int, int]) -> tuple[int, int]:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    keep = np.array(sure)
    for tight in (True, False):
        at = np.flatnonzero((close == tight) & ~sure)
        for i, word, x, y in zip(at.tolist(), k[at].tolist(), a[at].tolist(), b[at].tolist()):
            x, y = top((word, x)), top((word, y))
            if x != y:
                keep[i] = True
                if tight:
                    up[x] = y
    yield from table.filter(pa.array(keep)).to_batches()


def candidates(nodes: DataFrame, max_bucket: int) -> DataFrame:
    """(a, b): nodes of (node, w0, ...) whose sketches say that they may be similar, and stars of what is in one large bucket."""
    words = nodes.select("node", F.posexplode(F.array(*_WORDS)).alias("k", "fp"))
    heads = materialize(words.groupBy("k", "fp").agg(F.min("node").alias("head")), "words")
    found = heads.select("k", "fp").mapInArrow(_spread, "key int, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_candidates(max_bucket), "k int, a long, b long, sure boolean")
    pairs = materialize(found, "candidates")
    parts = max(2, -(-pairs.count() // PART_EDGES))
    pairs = materialize(pairs.repartition(parts).mapInArrow(_contracted, pairs.schema).distinct(), "candidates")
    ends = [heads.select("k", F.col("fp").alias(x), F.col("head").alias(f"n{x}")) for x in "ab"]
    near = pairs.join(ends[0], ["k", "a"]).join(ends[1], ["k", "b"]).select(F.col("na").alias("a"), F.col("nb").alias("b"), "sure")
    same = words.join(heads, ["k", "fp"]).select(F.col("head").alias("a"), F.col("node").alias("b"), F.lit(False).alias("sure"))
    both = near.unionByName(same).where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure"))
    sides = [nodes.select(F.col("node").alias(x), *[F.col(w).alias(f"{x}{w}") for w in _WORDS]) for x in "ab"]
    bits = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in _WORDS[1:]), F.bit_count(F.col(f"a{_WORDS[0]}").bitwiseXOR(F.col(f"b{_WORDS[0]}"))))
    return both.join(sides[0], "a").join(sides[1], "b").where(F.col("sure") | (bits <= SKETCH_BITS)).select("a", "b")


def _sets(size: int):
    """(root, lo, hi, node, hashes) of each row (node, root, blocks, text), for every pair of blocks that its node is in."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for node, root, blocks, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = shingle_set(text.as_buffer().to_pybytes(), size).tobytes()
                own = node % blocks
                for other in range(blocks):
                    out.append((root, min(own, other), max(own, other), node, data))
                    held += len(data)
                    if held > 8_000_000:
                        yield _set_batch(out)
                        out, held = [], 0
            if out:
                yield _set_batch(out)

    return emit


def _set_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["root", "lo", "hi", "node", "hashes"])


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all slices, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of sets (distinct, not empty) of Jaccard similarity or more."""
    size = np.array([len(x) for x in sets], np.int64)
    least = np.ceil(similarity * size - 1e-9).astype(np.int64)
    if len(sets) == 2:
        both = int(size.sum())
        union = len(np.unique(np.concatenate(sets)))
        return [(0, 1)] if both - union >= similarity * union - 1e-9 else []
    _, name, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    name, owner = rank[name], np.repeat(np.arange(len(sets)), size)
    name = name[np.lexsort((name, owner))]  # each set with its rarest first
    start = np.cumsum(size) - size
    # two sets that link share one of the first size - least + 1 names of each
    first = size - least + 1
    at = _slices(start, first)
    order = np.argsort(name[at], kind="stable")
    posted, holder = name[at][order], owner[at][order]
    edge = np.searchsorted(posted, np.arange(len(often) + 1))
    mark = np.zeros(len(often), bool)
    left = np.ones(len(sets), bool)
    remain = len(sets)
    out: list[tuple[int, int]] = []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        remain -= 1
        queue = [seed]
        while queue and remain:
            x = queue.pop()
            mine = name[start[x] : start[x] + first[x]]
            near = holder[_slices(edge[mine], edge[mine + 1] - edge[mine])]
            near = np.unique(near[left[near]])
            near = near[(size[near] >= least[x]) & (least[near] <= size[x])]
            if not len(near):
                continue
            mine = name[start[x] : start[x] + size[x]]
            mark[mine] = True
            for at in range(0, len(near), 1024):
                some = near[at : at + 1024]
                shared = np.add.reduceat(mark[name[_slices(start[some], size[some])]], np.cumsum(size[some]) - size[some], dtype=np.int64)
                hit = some[shared >= similarity * (size[x] + size[some] - shared) - 1e-9]
                left[hit] = False
                remain -= len(hit)
                queue.extend(hit.tolist())
                out.extend((x, int(y)) for y in hit)
            mark[mine] = False
    return out


def _verified(similarity: float):
    """Rows arrive sorted by (root, lo, hi, node)."""

    def of(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(sets) > 1 and (found := similar_links(sets, similarity)):
            name = np.array(nodes, np.int64)
            ends = np.array(found)
            yield _pairs(name[ends[:, 0]], name[ends[:, 1]])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []
        for batch in batches:
            for root, lo, hi, node, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, lo, hi) != group:
                    yield from of(nodes, sets)
                    group, nodes, sets = (root, lo, hi), [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(data, np.uint64))
        yield from of(nodes, sets)

    return settle


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, max_set: int = MAX_SET, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """docs (all columns) with the row of the smallest doc_id of each group."""
    names = docs.columns
    by = unused(docs, *_KEY)
    row = unused(docs, "row")[0]
    keys = content_key(text_of())
    named = docs.withColumns(dict(zip(by, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text_of())), *keys))))
    own = named.select(*[F.col(x).alias(y) for x, y in zip(by, _KEY)], text_of().alias("text"))
    prints = materialize(own.mapInArrow(_prints(shingle), f"none boolean, id long, k long, k2 int, node long, n long, {', '.join(f'{w} long' for w in _WORDS)}"), "prints")
    # one set has one sketch: any row of a node holds it
    nodes = materialize(prints.groupBy("node").agg(F.min(F.struct(*_KEY)).alias("first"), F.max("n").alias("n"), *[F.min(w).alias(w) for w in _WORDS]), "nodes")
    near = candidates(nodes.where("n > 0").select("node", *_WORDS), max_bucket)
    members = materialize(connected_components(near).join(nodes, "node").select("node", "root", "first.*", "n"), "members")
    blocks = members.groupBy("root").agg(F.sum("n").alias("n")).select("root", F.when(F.col("n") <= max_set, 1).otherwise(F.ceil(2 * F.col("n") / max_set)).cast("int").alias("blocks"))
    asked = own.join(members.join(blocks, "root").drop("n"), _KEY).select("node", "root", "blocks", "text")
    links = (
        asked.mapInArrow(_sets(shingle), "root long, lo int, hi int, node long, hashes binary")
        .repartition("root", "lo", "hi")
        .sortWithinPartitions("root", "lo", "hi", "node")
        .mapInArrow(_verified(similarity), "a long, b long")
    )
    roots = connected_components(links)
    heads = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    heads = materialize(heads.select(*[F.col(f"first.{x}").alias(y) for x, y in zip(_KEY, by)]), "heads")
    kept = named.join(heads, by, "left_semi")
    if kept.groupBy(*by).count().where("count > 1").isEmpty():
        return kept.select(*[F.col(f"`{x}`") for x in names])
    one = kept.groupBy(*by).agg(F.min_by(F.struct(*[F.col(f"`{x}`") for x in names]), F.xxhash64(*[F.col(f"`{x}`") for x in names])).alias(row))
    return one.select(*[F.col(row)[x].alias(x) for x in names])
