"""Small tables with the odd rows that every operator must stand."""

import random

#: Extra columns under names that operators use inside.
CLASH = ("_k", "_k2", "_t", "_n", "spans", "_head", "_bad", "fp", "key", "label", "score", "host", "shard", "rank", "where", "w", "h", "n_words", "salt", "digest", "path", "component_id", "rule", "b0", "length", "__copies", "__spans", "__k", "__k2", "__id", "__row", "__none", "__bad", "__b", "_key", "___k")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in CLASH)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w" + "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) if r.random() < 0.5 else f"t{r.randrange(vocabulary)}" for _ in range(n))


def texts():
    a, b, passage = words(1, 120), words(2, 90), words(3, 60)
    near = a.split()
    near[40] = "changed"
    rows = [
        (1, a), (2, a), (3, " ".join(near)), (4, b), (5, passage + " " + words(5, 80)), (6, words(6, 70) + " " + passage), (7, None), (8, ""), (9, " \t\n"),
        (10, "one"), (11, "one two three"), (None, words(11, 60)), (None, None), (12, b), (12, b), (13, words(13, 30_000)), (14, "é" * 300 + " ä ß " + "漢字" * 200), (15, "x" * 450),
        (16, "ab " * 400), (17, "A B c a b C a B c\nsame line\nsame line\n\nother|line #1"), (-3, words(17, 55)), (2**62, words(18, 52) + " licensed under CC BY 4.0"), (18, a + " " + words(19, 3)),
    ]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(d, t, "en" if i % 3 else None, None if i % 4 else "web", None if t is None else len(t), *(["x", None][i % 2] for _ in CLASH)) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
