"""Operators 6, 10 and 1 against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash

from tests.llm.tables import documents, empty, plain, texts, words
from wordloom.llm import bwt, components, decontaminate, golay, simhash, suffix_dedup


def covered(rows, min_len=200):
    seen = defaultdict(int)
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        for i in range(len(b) - min_len + 1):
            seen[b[i : i + min_len]] += 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - min_len + 1):
            if seen[b[i : i + min_len]] > 1:
                gone[i] += 1
                gone[i + min_len if i + min_len < len(b) else len(b)] -= 1
        out.append(np.cumsum(gone)[: len(b)] > 0)
    return data, out


def brute_repeats(rows, min_len=200):
    data, masks = covered(rows, min_len)
    out = []
    for (doc, _), b, m in zip(rows, data, masks):
        starts = int((m & ~np.concatenate(([False], m[:-1]))).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~m]) if len(b) else b""
        out.append((doc, len(b), int(m.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return plain(out)


def repeat_rows():
    r = random.Random(5)
    passage, other = words(50, 70), words(51, 45)
    rows = texts()
    rows[15] = (13, words(13, 3000))
    rows += [(600 + i, words(600 + i, r.randrange(5, 60)) + f" {passage} " + words(700 + i, 20)) for i in range(12)]
    rows += [(650 + i, other * (i + 1) + words(650 + i, 10) + passage[i : 230 + i]) for i in range(6)]
    rows += [(680, "ab" * 99), (681, "ab" * 100), (682, "ab" * 101), (683, "0" * 199), (684, "0" * 199), (685, "1" * 200), (686, "ü" * 101), (687, "x" + "ü" * 101)]
    return rows


def test_suffix_dedup(spark):
    rows = repeat_rows()
    expected = brute_repeats(rows)
    assert plain(suffix_dedup.repeat_report(documents(spark, rows)).collect()) == expected
    # small groups and huge ones must agree
    assert plain(suffix_dedup.repeat_report(documents(spark, rows), batch_bytes=2000, max_group=1500).collect()) == expected
    assert plain(suffix_dedup.repeat_report(documents(spark, rows), batch_bytes=2000, max_group=1500, run_rows=40, huge_rows=120).collect()) == expected
    assert suffix_dedup.repeat_report(empty(spark)).collect() == []


def test_suffix_dedup_small_windows(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randrange(0, 60)))) for i in range(60)]
    got = suffix_dedup.repeat_report(documents(spark, rows), 16, kgram=8)
    assert plain(got.collect()) == brute_repeats(rows, 16)


def test_drop_repeats_keeps_characters_whole(spark):
    rows = repeat_rows()
    docs = documents(spark, rows)
    got = suffix_dedup.drop_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    _, masks = covered(rows)
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got.collect())
    want = []
    for (d, t), m in zip(rows, masks):
        out, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not m[at : at + n].all():
                out.append(c)
            at += n
        want.append((d is None, d or 0, "".join(out)))
    assert left == sorted(want)
    assert suffix_dedup.drop_repeats(empty(spark)).collect() == []


def test_bwt_repeats():
    r = random.Random(3)
    for trial in range(60):
        n, k = r.randrange(0, 120), r.randrange(1, 12)
        data = bytes(r.choice(b"abc") for _ in range(n))
        got = bwt.repeated_starts(np.frombuffer(data, np.uint8), k)
        for i in range(n - k + 1):
            assert got[i] == (sum(data[j : j + k] == data[i : i + k] for j in range(n - k + 1)) > 1), (data, k, i)


def print_of(text, size=4):
    import re

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] if len(ws) >= size else [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def near_rows():
    rows = texts()
    for i in range(30):
        base = words(800 + i % 5, 200).split()
        for k in range(i // 5):
            base[(37 * k + i) % 200] = f"edit{i}x{k}"
        rows.append((900 - i, " ".join(base)))
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    prints = [print_of(t) for _, t in rows]
    expected = plain((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, brute_components([d for d, _ in rows], prints)))
    assert plain(simhash.near_duplicates(documents(spark, rows)).collect()) == expected
    assert plain(simhash.near_duplicates(documents(spark, rows), max_bucket=3).collect()) == expected  # every bucket is a hot one
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_links_find_all_within_distance(spark):
    r = random.Random(4)
    centre = [r.getrandbits(64) for _ in range(40)]
    prints = centre + [c ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) for c in centre for _ in range(6)]
    prints = sorted(set(prints))
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    for distance, bucket in ((4, 4096), (4, 2), (3, 2), (2, 2), (1, 2), (0, 2)):
        got = simhash.links(spark.createDataFrame(signed, "fp long"), distance, bucket).collect()
        ids = list(range(len(prints)))
        root = {p: i for i, p in enumerate(prints)}
        merged = ids[:]

        def find(i):
            while merged[i] != i:
                i = merged[i]
            return i

        for a, b in got:
            a, b = a % 2**64, b % 2**64
            assert (a ^ b).bit_count() <= distance
            merged[find(root[a])] = find(root[b])
        want = brute_components(ids, prints, distance)
        same = {}
        assert all(same.setdefault(find(i), w) == w for i, w in enumerate(want)) and len(set(same.values())) == len(same)


def test_golay_keys_share_within_two_bits():
    r = random.Random(1)
    moves = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    base = np.array([r.getrandbits(23) for _ in range(300)], np.int64)
    own = golay.keys(base)
    for m in moves:
        other = golay.keys(base ^ m)
        assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2)).all()
    # all syndromes: any two words of distance 2 share a key, by linearity shown on one word of each coset
    coset = np.arange(1 << 11, dtype=np.int64)
    own = golay.keys(coset)
    for m in moves:
        assert ((own[:, :, None] == golay.keys(coset ^ m)[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99), (7, 7), (200, 201), (200, 201), (None, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def edit_distance(pattern, text):
    """Smallest distance of pattern to a substring of text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        best = min(best, row[-1])
    return best


def test_myers():
    r = random.Random(2)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randrange(4, 12)))
        t = "".join(r.choice("abc") for _ in range(r.randrange(0, 25)))
        got = decontaminate.myers(decontaminate.myers_masks(p), len(p), t, 3)
        want = edit_distance(p, t)
        assert (got[0] if got else None) == (want if want <= 3 else None)


ITEMS = [(0, words(70, 30)), (1, "The quick, brown fox jumps over the lazy dog again and again."), (2, None), (3, ""), (4, "?!"), (5, words(71, 12)), (5, words(71, 12)), (6, "漢字の文章 " * 5), (7, "the"), (8, "Brown-Fox")]


def leak_rows():
    item = ITEMS[0][1]
    edited = list(item)
    for at in (10, 50, 90):
        edited[at] = "#" if at == 50 else "q"
    cut = item[: len(item) // 2]
    return texts() + [(700, words(72, 40) + " " + item + " " + words(73, 40)), (701, words(74, 9) + " " + "".join(edited).upper() + " x"), (702, cut), (703, "the quick brown-fox jumped over the lazy dog; again and again"), (704, ITEMS[7][1]), (705, item + item), (706, "other weather"), (707, "at the end"), (708, "the"), (709, "lathe the")]


def test_decontamination(spark):
    rows = leak_rows()
    rows[15] = (13, words(13, 2000))
    items = spark.createDataFrame([(*x, "extra") for x in ITEMS], "item_id long, text string, doc_id string")
    want = []
    for d, t in rows:
        text = decontaminate.normalised(t or "")
        for i, raw in ITEMS:
            item = decontaminate.normalised(raw or "")
            if item and len(item) < 16 and f" {item} " not in f" {text} ":
                continue
            if item and (best := edit_distance(item, text)) <= decontaminate.budget(item):
                want.append((d, i, best, len(item)))
    for block in (4_000_000, 100):
        got = decontaminate.find_leaks(documents(spark, rows), items, block_chars=block)
        assert plain(r[:4] for r in got.collect()) == plain(want)
    docs = documents(spark, rows)
    left = decontaminate.drop_leaks(docs, items)
    assert left.columns == docs.columns
    leaked = {(d) for d, *_ in want}
    assert leaked >= {700, 701, 703, 704, 705} and 702 not in leaked
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(d for d, _ in rows if d is not None and d not in leaked)
    assert decontaminate.find_leaks(empty(spark), items).collect() == [] and decontaminate.find_leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == len(rows)
