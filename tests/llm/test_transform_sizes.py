"""Operator 6: what goes through one transform is bounded by batch_bytes, or is one group."""

import random

import pyarrow as pa

from wordloom.llm import suffix_dedup


def contexts(sizes):
    """A group for each size: two texts over the same bytes and one over others."""
    r, rows = random.Random(6), []
    for h, size in enumerate(sizes):
        own = [bytes(r.choice(b"abcdefgh") for _ in range(size)) for _ in range(2)]
        rows += [(h, 0, 10 * h + i, 0, 5, size - 19, b) for i, b in enumerate((own[0], own[0], own[1]))]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["h", "v", "_k", "_k2", "s", "n", "b"])


def test_groups_do_not_pass_the_bound_together(monkeypatch):
    sizes = [400, 400, 30, 900, 100, 100, 400, 300]  # two of each go through a transform
    seen, real = [], suffix_dedup.repeated_starts
    monkeypatch.setattr(suffix_dedup, "repeated_starts", lambda data, n: seen.append(len(data)) or real(data, n))
    rows = contexts(sizes)

    def spans(batch_bytes):
        return sorted(tuple(x.values()) for b in suffix_dedup._settle_contexts(20, 8, batch_bytes)(iter([rows])) for x in b.to_pylist())

    whole = spans(1_000_000)
    assert len(seen) == 1 and whole == sorted((10 * h + i, 0, 5, 5 + size) for h, size in enumerate(sizes) for i in (0, 1))
    seen.clear()
    assert spans(1000) == whole
    assert max(seen) == 2 * 900 + 1  # the group that passes 1000 on its own, alone
    assert sorted(seen)[-2] <= 1000
