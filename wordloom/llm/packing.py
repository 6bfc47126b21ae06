"""Operator 3: packing documents into sequences by minimum bin slack.

A document's ids (with its end id) are cut into whole windows and one rest;
rests are packed.  Only the histogram of rest lengths reaches the driver: at
most ``window`` rows, whatever the input.  There, each round builds the
multiset of remaining lengths that fills a window closest to its capacity, by
a bitset subset-sum with bounded counts and backtracking, and uses it as
often as the counts allow.  Rests are then numbered within their length in
two steps (inside buckets of a hash, then buckets by their counts), and the
number picks the sequence and the place in it.

Null text is empty and still has its end id.  Repeated rows, also of one
doc_id, are packed apiece; which of equal rows takes which place is open, as
nothing tells them apart.  Of multisets that fill a window as well, the one
with the longest lengths is taken.  An empty table gives an empty table.
Only doc_id and text are read, whatever other columns are named.  Every id
lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import materialize, text_of
from wordloom.llm.tokens import default_path, word_encoder

WINDOW = 4096
END = (2).to_bytes(4, "little")
#: Text that a worker encodes at once.
SLICE_BYTES = 8_000_000
#: Buckets of a length in the numbering: no task sees a length whole.
SALTS = 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt int"


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, times) of a multiset of lengths, within their counts, whose sum is closest to capacity.

    Longer lengths come first; as soon as they reach the capacity, shorter ones are not looked at.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= capacity), reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & mask
            left -= take
            chunk *= 2
            if reach >> capacity:
                break
        if reach >> capacity:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, multiset) of each round; together they use every length as often as it is counted.

    Each round must hold the longest remaining length, as the hardest to place; the rest of the window is filled closest.
    """
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        out.append((times, sorted(chosen.items(), reverse=True)))
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


def _slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about ``most`` bytes together; a longer text is one run."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    yield start, len(sizes) - start


def _cut(vocabulary: str, window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for whole in batches:
            for first, count in _slices(whole.column(1)):
                batch, rows = whole.slice(first, count), []
                for doc, salt, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoder.encode(batch.column(1))):
                    n = len(ids) + 1
                    for at in range(0, n, window):
                        part = ids[at : at + window]
                        crc = zlib.crc32(part)
                        last = at + window >= n
                        rows.append((doc, at, len(part) + last, zlib.crc32(END, crc) if last else crc, n, salt))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
        # the worker goes on to other tasks and stages
        pa.default_memory_pool().release_unused()

    return emit


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_path("word_bpe_49k.json")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("salt"))
    cut = materialize(own.mapInArrow(_cut(vocabulary, window), PIECES), "pieces")

    # (length, salt) counts: at most window * SALTS rows; lengths alone: at most window rows
    salted = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in salted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, base, taken = [], 0, {}
    for times, chosen in plan(histogram, window):
        offset = 0
        for length, n in chosen:
            first = taken.get(length, 0)
            # pieces first .. first + times * n of this length: n in each of the sequences base .. base + times
            places.append((length, first, first + times * n, n, base, offset))
            taken[length] = first + times * n
            offset += length * n
        base += times
    where = spark.createDataFrame(places, "length long, low long, high long, each long, base long, at long").groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "base", "at"))).alias("where"))

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).join(F.broadcast(where), "length")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))
    hit = ranked.withColumn("p", F.element_at(F.filter("where", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"])), 1)).withColumn("i", F.col("rank") - F.col("p.low"))
    return hit.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p.base") + F.floor(F.col("i") / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.at") + F.col("i") % F.col("p.each") * F.col("length")).cast("long").alias("offset"),
    )
