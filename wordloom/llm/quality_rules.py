"""Operator 4: quality rules by learned decision lists, in native expressions.

Statistics of every whole text are built-in array and string functions.  A
list of rules for the rejected class is fitted to a bounded sample of labelled
rows (``SAMPLE`` of them, those with the smallest hash of doc_id): sequential
covering grows a conjunction of thresholds by information gain on one part of
the sample, prunes it from the end on the other, and keeps it while it is
precise there.  The list becomes one ordered CASE expression.

Words are told apart in windows of three by a 64-bit hash of the three.

Null text has no words (and so fails the base rules).  Rows are judged apiece,
each on its own text; of rows that repeat a labelled doc_id one teaches.
Labels that are null or name no document do no harm, contradicting ones count
as bad; without labels the list is empty and the base rules decide alone.  Of
conditions of equal gain the first in the order of the features and the
thresholds is taken.  An empty table gives an empty table; only doc_id and
text are read, and columns of any name pass through ``keep_good``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import in_hash_order, materialize, smallest_hashes, text_of

SAMPLE = 20_000
MIN_WORDS = 50
#: A rule is kept if at least this share of the rows it covers in the pruning part is rejected.
PRECISION = 0.97
MAX_RULES = 12
MAX_CONDITIONS = 3
_SPACE = r"[ \t-\r]+"
FEATURES = ("word_len", "symbols_a_word", "dup_lines_a_word", "repeated", "upper_a_char", "marks_a_word", "pipes_a_word", "digits_a_char")


def statistics(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the features and the columns ``also`` of each row of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, text_of().alias("t"))
    words = own.select("doc_id", *also, "t", F.array_remove(F.split("t", _SPACE), "").alias("w"))
    counted = words.select(
        "doc_id",
        *also,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("upper"),
        F.regexp_count("t", F.lit("[!?]")).alias("marks"),
        F.regexp_count("t", F.lit(r"\|")).alias("pipes"),
        F.regexp_count("t", F.lit("[0-9]")).alias("digits"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    base = counted.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")).drop("lines")
    none = F.array().cast("array<bigint>")
    grams = base.select("*", F.when(F.size("w") < 4, none).otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("g")).drop("w")
    # texts whose windows all differ are done; others sort (window, place)
    empty = F.array().cast("array<struct<g:bigint,i:int>>")
    placed = grams.select("*", F.when(F.size(F.array_distinct("g")) == F.size("g"), empty).otherwise(F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("s")).drop("g")
    twice = F.filter("s", lambda x, k: x["g"].eqNullSafe(F.get("s", k - 1)["g"]) | x["g"].eqNullSafe(F.get("s", k + 1)["g"]))
    places = placed.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p")).drop("s")
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-9).alias("last"), zero.alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    done = places.select("*", covered.alias("n_repeat_words")).drop("p")
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("word_len"), (F.col("n_symbols") / n).alias("symbols_a_word"), (F.col("n_dup_lines") / n).alias("dup_lines_a_word"),
        (F.col("n_repeat_words") / n).alias("repeated"), (F.col("upper") / chars).alias("upper_a_char"), (F.col("marks") / n).alias("marks_a_word"),
        (F.col("pipes") / n).alias("pipes_a_word"), (F.col("digits") / chars).alias("digits_a_char"), *also,
    )


Condition = tuple[int, bool, float]  # feature, whether at least the threshold, threshold


def _covers(rule: list[Condition], row: tuple[float, ...]) -> bool:
    return all((row[f] >= t) if up else (row[f] < t) for f, up, t in rule)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best_condition(rows: list[tuple[tuple[float, ...], bool]]) -> tuple[float, Condition] | None:
    p0 = sum(bad for _, bad in rows)
    n0 = len(rows) - p0
    best = None
    for f in range(len(rows[0][0])):
        values = sorted((x[f], bad) for x, bad in rows)
        p = n = 0
        for i, (v, bad) in enumerate(values):
            if i and v > values[i - 1][0]:
                cut = (v + values[i - 1][0]) / 2
                for up, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    g = _gain(a, b, p0, n0)
                    if best is None or g > best[0]:
                        best = (g, (f, up, cut))
            p += bad
            n += not bad
    return best


def learn(rows: list[tuple[tuple[float, ...], bool]], precision: float = PRECISION) -> list[list[Condition]]:
    """An ordered list of conjunctions for the bad class; rows are (features, whether bad), in a fixed order."""
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if not i % 3]
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and any(bad for _, bad in grow):
        rule: list[Condition] = []
        left = grow
        while len(rule) < MAX_CONDITIONS and not all(bad for _, bad in left):
            found = _best_condition(left)
            if found is None or found[0] <= 0:
                break
            rule.append(found[1])
            left = [r for r in left if _covers([found[1]], r[0])]
        best = None
        for length in range(1, len(rule) + 1):  # pruned from the end
            hit = [bad for x, bad in prune if _covers(rule[:length], x)]
            worth = (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0
            if best is None or worth > best[0]:
                best = (worth, length, len(hit), sum(hit))
        if best is None or best[2] < 3 or best[3] < precision * best[2]:
            break
        rule = rule[: best[1]]
        rules.append(rule)
        grow = [r for r in grow if not _covers(rule, r[0])]
        prune = [r for r in prune if not _covers(rule, r[0])]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional expression: the number of the first rule that fires, or null."""
    out = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for f, up, cut in rule:
            col = F.col(FEATURES[f])
            test = test & ((col >= cut) if up else (col < cut))
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def describe(rules: list[list[Condition]]) -> list[str]:
    return [" and ".join(f"{FEATURES[f]} {'>=' if up else '<'} {cut:.6g}" for f, up, cut in rule) for rule in rules]


def sample_of(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality) of the ``sample`` labelled ids of smallest hash; an id with contradicting labels counts as bad."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    near = smallest_hashes(known, ["doc_id"], sample).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return near.orderBy(*in_hash_order(["doc_id"])).limit(sample)


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules from labels (doc_id, quality) of documents in stats; a bounded sample reaches the driver, a row for each id."""
    marked = stats.where(f"n_words >= {MIN_WORDS}").join(sample_of(labels, sample), "doc_id")
    rows = marked.groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "quality")).alias("x")).select(F.xxhash64("doc_id"), "doc_id", "x.*").collect()
    rows.sort()  # the parts of the sample go by a hash of doc_id
    return learn([(tuple(r[2:-1]), r[-1] == 0) for r in rows])


def base_failed() -> Column:
    """Over the columns of ``statistics``."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules from the labelled ones of docs (doc_id, text): statistics of those of the sample only, whose ids are sent to all tasks."""
    known = materialize(sample_of(labels, sample), "known")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fit(statistics(own.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")), known, sample)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule and the columns ``also`` of each row of docs.

    Nothing is shuffled but the sample: the rules are learned first and judge each row where it is read.
    """
    rules = learned(docs, labels, sample)
    out = statistics(docs, also).select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule", *also)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (all columns) without the rows that the rules reject.

    Each row is judged on its own text, whatever other rows have its doc_id or have none.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row"))
    # a filter that is pushed below the statistics would compute them anew for each of its terms; none is pushed below a row's number
    kept = judge(rows, labels, sample, ("_row",)).withColumn("_n", F.monotonically_increasing_id()).where("kept and _n >= 0")
    return kept.select(*[F.col("_row")[x].alias(x) for x in docs.columns])
