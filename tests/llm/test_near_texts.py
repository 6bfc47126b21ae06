"""Near-dedup by true similarity, against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.tables import documents, empty, words
from tests.llm.test_duplicates import near_rows
from wordloom.llm import near_texts


def edited(base, edits, seed):
    """base with words changed at places at least six apart: each takes five shingles."""
    out = list(base)
    for at in random.Random(seed).sample(range(5, len(base) - 5, 6), edits):
        out[at] = f"edit{seed}x{at}"
    return " ".join(out)


def jaccard(a, b):
    a, b = (set(near_texts.shingle_set((t or "").encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, similarity=0.8):
    """The (doc_id, text) rows that stay."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= similarity:
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return groups.values()


def check(rows, got):
    groups = list(brute(rows))
    assert len(got) == len(groups)
    for group in groups:
        ids = [d for d, _ in group if d is not None]
        stay = [x for x in got if x in group]
        assert len(stay) == 1 and stay[0][0] == (min(ids) if ids else None)


def test_pairs_from_0_8_are_found(spark):
    rows = []
    for i in range(150):
        base = words(5000 + i, 300).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, edited(base, 5 + i % 3, i))]
    low = [jaccard(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(150)]
    assert sum(0.8 <= x < 0.85 for x in low) >= 90
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()}
    assert kept == {2 * i for i in range(150)} | {2 * i + 1 for i in range(150) if low[i] < 0.8}


def test_pairs_of_each_band(spark):
    """Candidates come from Golay keys of eight words: nearly all pairs at 0.8 have one, and no pair below is linked."""
    rows = []
    for i in range(300):
        base = words(5000 + i, 300).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, edited(base, 1 + i % 7, i))]
    low = [jaccard(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(300)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()}
    assert {2 * i for i in range(300)} | {2 * i + 1 for i in range(300) if low[i] < 0.8} <= kept
    for least, most, share in ((0.8, 0.85, 0.92), (0.85, 0.9, 0.95), (0.9, 1, 1)):
        band = [i for i in range(300) if least <= low[i] < most]
        caught = sum(2 * i + 1 not in kept for i in band)
        print(f"near copies of similarity {least} to {most}: {caught} of {len(band)} caught")
        assert len(band) >= 40 and caught >= share * len(band)


def test_sketches_of_one_set_in_any_block(spark):
    r = random.Random(4)
    for n in (0, 1, 2, 254, 255, 256, 5000):
        hashes = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
        own = near_texts.sketch(hashes)
        for k in range(near_texts.WORDS):
            mixed = [int(x) for x in (near_texts.mix(hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) if k else hashes)]
            assert int(own[k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > n)


def test_family_below_0_8_stays(spark):
    base = words(77, 300).split()
    rows = [(i, edited(base, 5, i)) for i in range(150)]
    between = [jaccard(rows[i][1], rows[j][1]) for i in range(150) for j in range(i)]
    assert np.mean([0.6 < x < 0.8 for x in between]) > 0.9
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()
    check(rows, [(r["doc_id"], r["text"]) for r in got])
    assert len(got) > 75


@pytest.mark.parametrize("bounds", [{}, {"max_set": 600}, {"max_set": 600, "max_bucket": 2}])
def test_keep_first(spark, bounds):
    rows = near_rows()
    docs = documents(spark, rows)
    got = near_texts.keep_first(docs, **bounds)
    assert got.columns == docs.columns
    check(rows, [(r["doc_id"], r["text"]) for r in got.collect()])


def test_empty(spark):
    assert near_texts.keep_first(empty(spark)).collect() == []


def test_similar_links():
    r = random.Random(6)
    for _ in range(200):
        base = r.sample(range(60), r.randrange(1, 40))
        sets = {tuple(sorted(set(r.sample(base, r.randrange(max(1, len(base) - 4), len(base) + 1)) + r.sample(range(60), r.randrange(3))))) for _ in range(r.randrange(2, 25))}
        sets = [np.array(x, np.uint64) for x in sorted(sets)]
        if len(sets) < 2:
            continue
        near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
        found = near_texts.similar_links(sets, 0.8)
        assert all(near(sets[a], sets[b]) for a, b in found)
        root = list(range(len(sets)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in found:
            assert find(a) != find(b)
            root[find(a)] = find(b)
        assert all(find(i) == find(j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j]))
