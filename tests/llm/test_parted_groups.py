"""Operator 6: an anchor group that is settled in parts shows each of its classes to step 3."""

import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm.suffix_dedup import _settle_runs, _Windows


def settled(classes, batch, run_rows, huge_rows):
    """(covered keys, classes shown to step 3); classes are sizes, class c's runs have the keys 1000 * c + i."""
    c = np.repeat(np.arange(len(classes)), classes)
    k = np.concatenate([1000 * i + np.arange(n) for i, n in enumerate(classes)])
    cols = [np.full(len(c), 7), c, k, np.zeros(len(c), np.int32), np.zeros(len(c), np.int32), np.ones(len(c), np.int32)]
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "c", "_k", "_k2", "s", "n"])
    out = list(_settle_runs(20, run_rows, huge_rows)(rows.slice(at, batch) for at in range(0, len(c), batch)))
    found = [(kind, key) for b in out for kind, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    return {key for kind, key in found if kind == 0}, {key // 1000 for kind, key in found if kind > 0}


@pytest.mark.parametrize("classes", [[1] * 50 + [180], [1] * 230, [1] * 210 + [1], [3] * 70 + [1], [250], [1] * 205 + [40, 2, 1]])
@pytest.mark.parametrize("batch", [1, 7, 64])
def test_every_class_is_shown(classes, batch):
    covered, shown = settled(classes, batch, 40, 200)
    assert shown == set(range(len(classes)))
    assert covered == {1000 * i + j for i, n in enumerate(classes) if n > 1 for j in range(n)}


@pytest.mark.parametrize("batch", [1, 2, 3, 50])
def test_windows_at_two_places_are_found(batch):
    r = np.random.default_rng(batch)
    rows = sorted((int(h), int(v), int(k), 0, int(s)) for h, v, k, s in r.integers(0, 4, (60, 4)))
    cols = [pa.array([x[i] for x in rows], pa.int64() if i < 3 else pa.int32()) for i in range(5)]
    table = pa.RecordBatch.from_arrays(cols, names=["h", "v", "_k", "_k2", "s"])
    windows, got = _Windows(20), []
    for at in range(0, len(rows), batch):
        for b in windows.found(table.slice(at, batch)):
            got += [tuple(x.values()) for x in b.to_pylist()]
    places = {}
    for h, v, k, k2, s in rows:
        places.setdefault((h, v), set()).add((k, k2, s))
    assert sorted(got) == sorted((k, k2, s, s + 20) for at in places.values() if len(at) > 1 for k, k2, s in at)
