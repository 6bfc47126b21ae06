"""Operators 2, 4, 8, 9 and 3 against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.tables import documents, empty, plain, texts
from wordloom.llm import licenses, packing, quality_rules, sharding, token_cache, tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def base_hits(words):
    out = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return out


def brute_licenses(rows):
    """The method in plain words: for each text and template, all offsets, and the weight of the template's rare words near each."""
    split = [license_words(t) for _, t in rows]
    idf = lambda w: math.log(1 + (len(rows) + 1) / (sum(w in ws for ws in split) + 1))
    rare = []
    for _, text, _ in licenses.TEMPLATES:
        ws = license_words(text)
        first = {w: i for i, w in reversed(list(enumerate(ws)))}
        top = sorted(first, key=lambda w: (-idf(w), first[w]))[: min(12, max(4, len(ws) // 8))]
        rare.append({w: idf(w) / sum(map(idf, top)) for w in top})
    out = []
    for (doc, _), ws in zip(rows, split):
        hits = base_hits(ws)
        base = {b for _, b in hits}
        share, found = {}, set()
        for (label, text, phrases), weights in zip(licenses.TEMPLATES, rare):
            template = license_words(text)
            seen = {(i - at, w) for i, w in enumerate(ws) if w in weights for at, x in enumerate(template) if x == w}
            for low in {low for shift, _ in seen for low in (shift // 8 * 8, (shift + 4) // 8 * 8 - 4)}:
                weight = sum(weights[w] for w in {w for shift, w in seen if low <= shift < low + 8})
                share[label] = max(share.get(label, 0), weight)
                near = any(ws[i : i + len(p)] == p for p in map(str.split, phrases) for i in range(max(0, low - 4), low + len(template) + 12))
                if weight >= 0.6 - 1e-9 and near:
                    found.add(label)
        at = [i for i, _ in hits]
        score = max((min(1.0, share[x]) for x in base | found if x in share), default=0.0)
        out.append((doc, len(ws), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), round(score, 5)))
    return out


LICENCES = [
    "released under the MIT license, all rights reserved. ALL RIGHTS  reserved", "cc-by cc by 4.0", "Licensed under CC BY-NC 4.0", "GNU General Public License version 3: licensed under the gnu general public license version 3",
    "licensed under the Apache License, Version 2.0 (the License)", "Apache the licensed version", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit license", "cc by", "all rights", "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "x " * 500 + licenses._MIT, licenses._MIT.replace("merge, ", "").replace("Software is furnished", "Software may be furnished and given"), " ".join(reversed(licenses._ISC.split())), licenses._GNU.format("General", "3", "General") + " " + "y " * 50 + licenses._ZLIB,
]


def test_license_scan(spark):
    rows = texts() + [(100 + i, t) for i, t in enumerate(LICENCES)] + [(103, LICENCES[3])]
    got = [(*r[:7], round(r[7], 5)) for r in licenses.scan(documents(spark, rows)).collect()]
    assert plain(got) == plain(brute_licenses(rows))
    by = {r[0]: r for r in got}
    assert by[100][6] == "mit,reserved" and "gpl-3.0" in by[103][6] and "apache-2.0" in by[104][6] and by[105][6] == ""
    assert by[111][6] == by[112][6] == "mit" and by[113][6] == "" and {"gpl-3.0", "zlib"} <= set(by[114][6].split(","))
    assert by[111][7] == 1 and 0.6 <= by[112][7] <= 1 and 0 < by[108][7] < 1 and by[109][7] == 0
    assert licenses.scan(empty(spark)).collect() == []


def brute_quality(doc, text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for k in range(3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return doc, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics(spark):
    rows = texts() + [(200, "a b c a b c a b c"), (201, "a a a a a"), (202, "x\n x\nx\n\n\t\nx"), (203, "p q r s p q r")]
    got = quality_rules.judge(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert plain(r[:7] for r in got.collect()) == plain(brute_quality(*r) for r in rows)
    assert all(r["kept"] != r["base_failed"] for r in got.collect())  # no labels, no rules
    assert quality_rules.judge(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_quality_rules_learn(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(80))) for i in range(150)]
    bad = [(1000 + i, " ".join(f"w|{i}|{k}##" for k in range(80))) for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:100]] + [(i, 0) for i, _ in bad[:70]] + [(None, 0), (5000, 0), (0, None)], "doc_id long, quality int")
    docs = documents(spark, good + bad)
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert all(verdict[i] for i, _ in good) and not any(verdict[i] for i, _ in bad)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in good]


def test_decision_list_orders_and_prunes():
    rows = [((float(i), float(i % 7), 0, 0, 0, 0, 0, 0), i >= 200) for i in range(300)]
    rules = quality_rules.learn(rows)
    assert rules and all(quality_rules._covers(rules[0], x) == bad for x, bad in rows)
    assert quality_rules.learn([(r, False) for r, _ in rows]) == [] and quality_rules.learn([]) == []


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = texts() + [(i * 7919, str(i)) for i in range(300)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    assert plain(r[:6] for r in got) == plain((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", jump(-1 if d is None else d, 24), None) [:5] + (next_slot,) for d, t, next_slot in _slots(rows, got))
    for r in got:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert r["grown_shard"] == jump(key, 25) and r["grown_shard"] in (r["shard"], 24)
    for shard in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty(spark)).collect() == []


def _slots(rows, got):
    """Slots are checked for gaps apart; here each row takes one of those given to its like."""
    left = defaultdict(list)
    for r in got:
        left[r["doc_id"], r["text_crc32"]].append(r["slot"])
    return [(d, t, left[d, zlib.crc32((t or "").encode())].pop()) for d, t in rows]


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    odd = ["<|endoftext|> a <|endoftext|>", "can't WON'T  it's x　y\n\n z", "ﬁ ① ٣ ​ x", "\u0000\u0001 \x85  x", "don’t", "é naïve", "🙂🙂 ok", "a" * 3000]
    rows = texts() + [(300 + i, t) for i, t in enumerate(odd)]
    expected = plain((d, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows)
    assert plain(token_cache.count_tokens(documents(spark, rows)).collect()) == expected
    cache = str(tmp_path / "cache")
    assert plain(token_cache.count_tokens(documents(spark, rows[:10]), cache=cache).collect()) == plain((d, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows[:10])
    before = spark.read.parquet(cache).count()
    assert plain(token_cache.count_tokens(documents(spark, rows), cache=cache).collect()) == expected
    after = spark.read.parquet(cache)
    assert before < after.count() == after.select("digest").distinct().count() == len({t or "" for _, t in rows})
    assert plain(token_cache.count_tokens(documents(spark, rows), cache=cache).collect()) == expected and spark.read.parquet(cache).count() == after.count()
    assert token_cache.count_tokens(empty(spark)).collect() == []


def test_token_counts_sentencepiece(spark):
    import sentencepiece

    path = tokens.default_path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r[0]: r[2] for r in token_cache.count_tokens(documents(spark, texts()[:6]), path).collect()}
    assert got == {d: len(own.encode(t)) for d, t in texts()[:6]}


def check_packing(rows, got):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_path("word_bpe_49k.json"))
    need = Counter()
    for d, t in rows:
        need[d, tuple([*own.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    by = defaultdict(list)
    for (d, ids), n in need.items():
        by[d].append((ids, n))
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    want = Counter()
    for (d, ids), n in need.items():
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[d, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)] += n
    assert pieces == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(seq) == list(range(len(seq)))
    return sum(r["length"] for r in got), len(seq)


def test_packing(spark):
    rows = texts() + [(400 + i, " ".join(["alpha beta"] * (i % 37))) for i in range(400)] + [(500, "ǅ ﬁ <|endoftext|> İ"), (501, "it's 12 don't _x_ a b")]
    total, used = check_packing(rows, packing.pack(documents(spark, rows)).collect())
    assert used <= -(-total // 4096) + 1
    assert packing.pack(empty(spark)).collect() == []


def test_bin_slack_plan():
    counts = {5: 3, 4: 4, 3: 2, 7: 1, 1: 1}
    used = Counter()
    for times, chosen in packing.plan(counts, 10):
        assert sum(x * n for x, n in chosen) <= 10
        for x, n in chosen:
            used[x] += times * n
    assert used == counts
    for capacity in range(1, 24):
        best = max(sum(x) for x in _subsets([5, 5, 5, 4, 4, 4, 4, 3, 3, 7, 1]) if sum(x) <= capacity)
        assert sum(x * n for x, n in packing.fullest(counts, capacity)) == best


def _subsets(items):
    out = {()}
    for x in items:
        out |= {tuple(sorted((*s, x))) for s in out}
    return out


@pytest.mark.parametrize("bad", [0, -1])
def test_shards_must_be(spark, bad):
    with pytest.raises(ValueError):
        sharding.jump_hash(spark.range(1)["id"], bad)
