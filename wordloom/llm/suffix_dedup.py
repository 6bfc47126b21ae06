"""Operator 6: removal of every byte covered by a repeated string of ``min_len`` bytes.

Texts are UTF-8 bytes and matches never cross texts.  Four steps, all linear:

1. Each distinct text is cut into runs of windows with the same canonical
   anchor (see ``windows``); equal windows always meet in one anchor group.
   Runs over equal bytes that meet in one task cover each other at once, and
   one of them goes on.
2. Grouped by anchor: two runs over equal bytes cover each other; runs that
   differ from the others of their group only at an edge are left to step 3.
3. Their bytes are fetched, and each group goes through the threshold-bounded
   interval expansion on a Burrows-Wheeler transform (``bwt``).  A group whose
   bytes pass ``max_group`` is not brought together: its windows are dealt out
   by hashes of their own bytes and counted, the same answer without a bound
   on the group.
4. Covered spans are merged per text and cut out.

Equality of runs (steps 1, 2) and of windows (large groups) goes by 64-bit
anchor hashes together with 64-bit content hashes.

Null text is empty; texts shorter than ``min_len`` lose nothing; a text that
stands in two rows or more (the same doc_id twice included) and has
``min_len`` bytes loses all of them.  Of equal strings none is spared, so no
order of rows matters.  An empty table gives an empty table; columns of any
name pass through ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.bwt import repeated_starts
from wordloom.llm.common import content_key, materialize, text_of, unused
from wordloom.llm.windows import mix, prefix_sums, rolling, runs, span_hash

KGRAM = 64
#: Bytes that go through one transform, which takes about 100 times as many of memory; only a group on its own, of up to MAX_GROUP, may pass it.
BATCH = 1_000_000
#: Runs that a task settles at once, and those of one anchor group from which on it is settled in parts.
RUN_ROWS, HUGE_ROWS = 400_000, 2_000_000
MAX_GROUP = 2_000_000
_SEEN = 500_000
RUN_SCHEMA = "h long, c long, _k long, _k2 int, s int, n int"
FOUND_SCHEMA = "kind int, _k long, _k2 int, s int, e int, h long"
CONTEXT_SCHEMA = "h long, v long, _k long, _k2 int, s int, n int, b binary"
SETTLED_SCHEMA = "_k long, _k2 int, s int, e int"


def _unsigned(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _runs_of(min_len: int, kgram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies inside this task; what slips by is dropped in step 2
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            size = 0
            for key, key2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (key, key2) in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add((key, key2))
                data = np.frombuffer(text.as_buffer(), np.uint8)
                h, c, s, n = runs(data, min_len, kgram)
                for col, x in zip(cols, (_unsigned(h), _unsigned(c), np.full(len(h), key), np.full(len(h), key2, np.int32), s.astype(np.int32), n.astype(np.int32))):
                    col.append(x)
                size += len(h)
                if size > 200_000:
                    yield _joined_runs(*map(np.concatenate, cols))
                    cols, size = [[] for _ in range(6)], 0
            if size:
                yield _joined_runs(*map(np.concatenate, cols))

    return emit


def _joined_runs(h: np.ndarray, c: np.ndarray, k: np.ndarray, k2: np.ndarray, s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """The runs with one of each class (h, c).  Runs of a class with two places or more are all covered: they follow
    with n negative, dealt out by their texts and not by their anchor."""
    key = mix(h.view(np.uint64)) ^ c.view(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    tied = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    tied = tied[np.lexsort((s[tied], k2[tied], k[tied], c[tied], h[tied]))]
    keep, done = np.ones(len(h), bool), np.zeros(0, np.int64)
    if len(tied):
        fresh = np.concatenate(([True], (h[tied][1:] != h[tied][:-1]) | (c[tied][1:] != c[tied][:-1])))
        place = fresh | np.concatenate(([True], (k[tied][1:] != k[tied][:-1]) | (k2[tied][1:] != k2[tied][:-1]) | (s[tied][1:] != s[tied][:-1])))
        keep[tied[~fresh]] = False
        cls = np.cumsum(fresh) - 1
        done = tied[place & (np.bincount(cls, weights=place)[cls] > 1)]
    live = np.flatnonzero(keep)
    both = np.concatenate((live, done))
    deal = np.concatenate((h[live], mix(k[done].view(np.uint64) + s[done].astype(np.uint64)).view(np.int64)))
    size = np.concatenate((n[live], -n[done]))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, c[both], k[both], k2[both], s[both], size)], names=["h", "c", "_k", "_k2", "s", "n"])


def _settle_runs(min_len: int, run_rows: int = RUN_ROWS, huge_rows: int = HUGE_ROWS, max_group: int = MAX_GROUP):
    """Rows arrive sorted by (h, c, _k, _k2, s); groups are kept together up to ``huge_rows``.

    Rows out: covered runs (kind 0), and a run of each class that step 3 must see, in groups of up to ``max_group``
    bytes (kind 1) and in larger ones (kind 2).
    """

    def of(t: dict[str, np.ndarray], parted: int | None) -> pa.RecordBatch | None:
        """Whole groups; of the group ``parted`` only the rest, of which each class is shown to step 3."""
        h, c, k, k2, s, n = (t[x] for x in ("h", "c", "_k", "_k2", "s", "n"))
        if len(h) < 2 and h[0] != parted:
            return None
        fresh_h = np.concatenate(([True], h[1:] != h[:-1]))
        fresh_c = fresh_h | np.concatenate(([True], c[1:] != c[:-1]))
        twice = ~np.concatenate(([True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1]) | (s[1:] != s[:-1]))) & ~fresh_c
        cls = np.cumsum(fresh_c) - 1
        members = np.bincount(cls, weights=~twice).astype(np.int64)
        group_of_class = (np.cumsum(fresh_h) - 1)[fresh_c]
        classes = np.bincount(group_of_class)[group_of_class]
        covered = (members[cls] > 1) & ~twice
        unclear = fresh_c & (classes[cls] > 1)
        group = np.cumsum(fresh_h) - 1
        large = np.bincount(group, weights=unclear * (n + min_len))[group] > max_group
        if parted is not None:
            unclear |= fresh_c & (h == parted)
            large |= h == parted
        out = []
        for kind, mask in ((0, covered), (1, unclear & ~large), (2, unclear & large)):
            m = np.flatnonzero(mask)
            e = s[m] + n[m] - 1 + min_len if kind == 0 else n[m]
            out.append((np.full(len(m), kind, np.int32), k[m], k2[m], s[m], e.astype(np.int32), h[m]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["kind", "_k", "_k2", "s", "e", "h"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h", "c", "_k", "_k2", "s", "n")
        kept: list[dict[str, np.ndarray]] = []
        size, parted = 0, None
        for batch in batches:
            rows = {x: batch.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(names)}
            done = np.flatnonzero(rows["n"] < 0)
            if len(done):
                k, k2, s, n, h = (rows[x][done] for x in ("_k", "_k2", "s", "n", "h"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(len(done), np.int32), k, k2, s, (s - n - 1 + min_len).astype(np.int32), h)], names=["kind", "_k", "_k2", "s", "e", "h"])
                live = rows["n"] > 0
                rows = {x: y[live] for x, y in rows.items()}
            kept.append(rows)
            size += len(rows["n"])
            if size < run_rows:
                continue
            t = {x: np.concatenate([y[x] for y in kept]) for x in names}
            cut = int(np.searchsorted(t["h"], t["h"][-1]))  # the last group may go on
            if cut == 0 and size > huge_rows:
                # a huge group: whole classes of it are settled on their own, each shown to step 3
                cut = int(np.searchsorted(t["c"], t["c"][-1]))
                if cut == 0:
                    cut = size - 1  # one class: its last row stays to meet the next ones
                parted = t["h"][0]
                yield from _huge(t, cut, min_len)
            elif cut and (found := of({x: y[:cut] for x, y in t.items()}, parted)) is not None:
                yield found
            kept = [{x: y[cut:] for x, y in t.items()}]
            size -= cut
        if size:
            t = {x: np.concatenate([y[x] for y in kept]) for x in names}
            if (found := of(t, parted)) is not None:
                yield found

    return settle


def _huge(t: dict[str, np.ndarray], cut: int, min_len: int) -> Iterator[pa.RecordBatch]:
    """A part of one group with its next row: classes of two rows cover each other; one row of each goes on to step 3."""
    h, c, k, k2, s, n = (t[x] for x in ("h", "c", "_k", "_k2", "s", "n"))
    fresh = np.concatenate(([True], c[1:] != c[:-1]))
    cls = np.cumsum(fresh) - 1
    other = np.concatenate(([False], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1]) | (s[1:] != s[:-1]))) & ~fresh
    covered = (np.bincount(cls, weights=other) > 0)[cls]
    for kind, mask in ((0, covered), (2, fresh)):
        m = np.flatnonzero(mask[: cut + 1] if kind == 0 else mask[:cut])
        e = s[m] + n[m] - 1 + min_len if kind == 0 else n[m]
        if len(m):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(m), kind, np.int32), k[m], k2[m], s[m], e.astype(np.int32), h[m])], names=["kind", "_k", "_k2", "s", "e", "h"])


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops copies inside a task, so that a text with very many copies is sent once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if key not in seen:
                keep.append(i)
                if len(seen) < _SEEN:
                    seen.add(key)
        yield batch.take(pa.array(keep, pa.int32())) if len(keep) < batch.num_rows else batch


def _contexts(min_len: int):
    """(h, v, _k, _k2, s, n, b): the bytes of each run of a group (v is 0), and of a run of a large group each window,
    without bytes: h and v are then two hashes of the window."""

    def windows(key: int, key2: int, s: int, n: int, data: bytes) -> pa.RecordBatch:
        sums = prefix_sums(np.frombuffer(data, np.uint8))
        start, half = np.arange(n), min_len // 2
        w = span_hash(sums, start, start + min_len)
        v = mix(span_hash(sums, start, start + half) ^ (span_hash(sums, start + half, start + min_len) << np.uint64(1)))
        cols = (_unsigned(w), _unsigned(v), np.full(n, key), np.full(n, key2, np.int32), (s + start).astype(np.int32), np.ones(n, np.int32))
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(n, pa.binary())], names=["h", "v", "_k", "_k2", "s", "n", "b"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for key, key2, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = text.as_buffer().to_pybytes()
                for p in parts:
                    b = data[p["s"] : p["s"] + p["n"] - 1 + min_len]
                    if p["large"]:
                        yield windows(key, key2, p["s"], p["n"], b)
                        continue
                    for col, x in zip(out, (p["h"], 0, key, key2, p["s"], p["n"], b)):
                        col.append(x)
                    size += len(b)
                if size > 8_000_000:
                    yield _context_batch(out)
                    out, size = [[] for _ in range(7)], 0
            if out[0]:
                yield _context_batch(out)

    return cut


def _context_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["h", "v", "_k", "_k2", "s", "n", "b"])


class _Windows:
    """Windows sorted by (h, v, _k, _k2, s): those that stand at two places or more.  Only one is held from batch to batch."""

    def __init__(self, min_len: int):
        self.min_len = min_len
        self.last: np.ndarray | None = None  # the last row (h, v, _k, _k2, s)
        self.held = False  # whether it is the only place of its window so far, and not yet sent

    def found(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
        if self.last is not None:
            rows = np.concatenate((self.last[:, None], rows), axis=1)
        again = (rows[:, 1:] == rows[:, :-1]).all(axis=0)
        rows = rows[:, np.concatenate(([True], ~again))]  # a copy of a text from another task
        fresh = np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
        group = np.cumsum(fresh) - 1
        # what came before counts, but is sent once
        sent_before = self.last is not None and not self.held
        many = np.bincount(group)[group] > 1
        if sent_before:
            many |= group == 0
        send = many.copy()
        if sent_before:
            send[0] = False
        self.last, self.held = rows[:, -1].copy(), not many[-1]
        k, k2, s = rows[2:, send]
        if len(s):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, k2.astype(np.int32), s.astype(np.int32), (s + self.min_len).astype(np.int32))], names=["_k", "_k2", "s", "e"])


def _may_repeat(group: list[tuple], min_len: int, kgram: int) -> list[tuple]:
    """Runs of which no window can stand in another run of the group are left out.

    A window of min_len bytes holds the anchor and at least half of the other
    min_len - kgram bytes on one side of it; a run whose both halves are
    unlike all others' has no repeated window.
    """
    if len(group) < 2:
        return []
    half = (min_len - kgram) // 2
    left: dict[bytes, int] = {}
    right: dict[bytes, int] = {}
    sides = []
    for row in group:
        at = _anchor(row[4], row[3], min_len, kgram)
        a = row[4][at - half : at + kgram] if at >= half else None
        z = row[4][at : at + kgram + half] if at + kgram + half <= len(row[4]) else None
        sides.append((a, z))
        left[a] = left.get(a, 0) + (a is not None)
        right[z] = right.get(z, 0) + (z is not None)
    return [row for row, (a, z) in zip(group, sides) if left[a] > 1 or right[z] > 1]


def _anchor(b: bytes, n: int, min_len: int, kgram: int) -> int:
    """Where the anchor of a run stands: the last place of the smallest hash in its first window."""
    grams = rolling(prefix_sums(np.frombuffer(b[:min_len], np.uint8)), kgram)
    low = np.uint64((1 << 24) - 1)
    return int(len(grams) - 1 - np.argmin((grams & ~low)[::-1]))


def _settle_contexts(min_len: int, kgram: int, batch_bytes: int):
    """Rows of ``_contexts`` arrive sorted by (h, v, _k, _k2, s)."""

    def expand(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        data = np.frombuffer(b"\x00".join(r[4] for r in rows), np.uint8)
        again = repeated_starts(data, min_len)
        out: list[tuple] = []
        at = 0
        for k, k2, s, n, b in rows:
            hit = np.flatnonzero(again[at : at + n])
            if len(hit):
                ends = np.flatnonzero(np.append(np.diff(hit) > min_len, True))
                begin = np.append(0, ends[:-1] + 1)
                out.extend((k, k2, s + int(hit[i]), s + int(hit[j]) + min_len) for i, j in zip(begin, ends))
            at += len(b) + 1
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["_k", "_k2", "s", "e"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        ready_bytes = 0
        group: list[tuple] = []
        h0, last = None, None
        windows = _Windows(min_len)

        def close(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            """The group waits with others; those that would pass ``batch_bytes`` together with it are expanded before."""
            nonlocal ready, ready_bytes
            more = _may_repeat(group, min_len, kgram)
            size = sum(len(r[4]) + 1 for r in more)
            if ready_bytes + size > batch_bytes:
                yield from expand(ready)
                ready, ready_bytes = [], 0
            ready += more
            ready_bytes += size

        for batch in batches:
            alone = pc.is_null(batch.column(6))
            if alone.true_count:
                yield from windows.found(batch.filter(alone))
                batch = batch.filter(pc.invert(alone))
            for h, _, k, k2, s, n, b in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, k, k2, s) == last:
                    continue  # a copy of a text from another task
                last = (h, k, k2, s)
                if h != h0:
                    yield from close(group)
                    group, h0 = [], h
                group.append((k, k2, s, n, b))
        yield from close(group)
        yield from expand(ready)

    return settle


def repeated_spans(docs: DataFrame, text: str = "text", min_len: int = 200, kgram: int = KGRAM, batch_bytes: int = BATCH, max_group: int = MAX_GROUP, run_rows: int = RUN_ROWS, huge_rows: int = HUGE_ROWS) -> DataFrame:
    """(_k, _k2, spans): for each distinct text with repeats inside or in other distinct texts, its covered byte spans.

    Spans may touch or overlap; texts are named by ``common.content_key``.
    """
    if not 8 <= kgram <= min_len:
        raise ValueError("kgram must lie between 8 and min_len")
    body = text_of(text)
    texts = docs.select(*content_key(body), body.alias("_t")).where(F.octet_length("_t") >= min_len)
    found = (
        texts.mapInArrow(_runs_of(min_len, kgram), RUN_SCHEMA)
        .repartition("h")
        .sortWithinPartitions("h", "c", "_k", "_k2", "s")
        .mapInArrow(_settle_runs(min_len, run_rows, huge_rows, max_group), FOUND_SCHEMA)
    )
    found = materialize(found, "runs")
    asked = found.where("kind > 0").groupBy("_k", "_k2").agg(F.collect_list(F.struct("h", "s", F.col("e").alias("n"), (F.col("kind") == 2).alias("large"))).alias("parts"))
    settled = (
        texts.mapInArrow(_distinct_texts, texts.schema)
        .join(asked, ["_k", "_k2"])
        .mapInArrow(_contexts(min_len), CONTEXT_SCHEMA)
        .repartition("h")
        .sortWithinPartitions("h", "v", "_k", "_k2", "s")
        .mapInArrow(_settle_contexts(min_len, kgram, batch_bytes), SETTLED_SCHEMA)
    )
    parts = ["_k", "_k2", "s", "e"]
    spans = found.where("kind = 0").select(parts).unionByName(materialize(settled, "contexts"))
    return spans.groupBy("_k", "_k2").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))


def merge_spans(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, in order; touching spans are one."""
    out: list[tuple[int, int]] = []
    for p in spans:
        s, e = p["s"], min(p["e"], n)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _with_spans(docs: DataFrame, text: str, min_len: int, **options) -> DataFrame:
    """docs with two columns behind its own: how many rows have the row's text, and its spans."""
    keys = content_key(text_of(text))
    k, k2, n, spans = unused(docs, "k", "k2", "copies", "spans")
    copies = docs.select(*keys).groupBy("_k", "_k2").agg(F.count("*").alias("copies"))
    info = copies.join(repeated_spans(docs, text, min_len, **options), ["_k", "_k2"], "left")
    info = info.select(F.col("_k").alias(k), F.col("_k2").alias(k2), F.col("copies").alias(n), F.col("spans").alias(spans))
    return docs.withColumns({k: keys[0], k2: keys[1]}).join(info, [k, k2], "left").select(*[F.col(f"`{x}`") for x in [*docs.columns, n, spans]])


def _cut(data: bytes, copies: int, spans: list[dict] | None, min_len: int) -> list[tuple[int, int]]:
    if copies > 1 and len(data) >= min_len:
        return [(0, len(data))]
    return merge_spans(spans or [], len(data))


def repeat_report(docs: DataFrame, min_len: int = 200, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text)."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, copies, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = text.as_buffer().to_pybytes()
                gone = _cut(data, copies, spans, min_len)
                kept, at = hashlib.sha256(), 0
                for s, e in gone:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                rows.append((doc, len(data), sum(e - s for s, e in gone), len(gone), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return _with_spans(own, "text", min_len, **options).mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, min_len: int = 200, **options) -> DataFrame:
    """docs (all columns) without the covered bytes of text; a character that is only partly covered stays.

    n_chars, where docs has it, counts the characters of the text that is left.
    """
    names = docs.columns
    spare = docs.withColumn("text", text_of())
    schema = spare.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_text = names.index("text")
        for batch in batches:
            left = []
            for text, copies, spans in zip(batch.column(at_text), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                data = text.as_buffer().to_pybytes()
                out, at = [], 0
                for s, e in _cut(data, copies, spans, min_len):
                    while s < e and data[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
                        e -= 1
                    out.append(data[at:s])
                    at = e
                out.append(data[at:])
                left.append(b"".join(out).decode())
            cols = [batch.column(i) for i in range(len(names))]
            cols[at_text] = pa.array(left, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([len(x) for x in left], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return _with_spans(spare, "text", min_len, **options).mapInArrow(clean, schema)
