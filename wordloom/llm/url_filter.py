"""Operator 7: URL filter: longest rule, else gradient-boosted trees on lexical features, in native expressions.

Rules (host, path, verdict) are a bounded list and become one conditional
expression.  URLs that no rule fits go to boosted regression trees over
length, depth, digit ratio, entropy, parameter counts and suffix statistics.
The trees are fitted on the driver to a bounded sample (``SAMPLE`` distinct
URLs of smallest hash) of labelled URLs, and applied as nested conditionals.
A third of the sample, held out, tells how many trees are worth keeping: none
where the features say nothing of the labels.

Labels are given as a table (url, blocked).  ``labels_of_pages`` makes one
from what the pages say: a URL is blocked where the text of its page fails the
quality rules (operator 4) that are learned from labelled documents.  No rule
and no word of the URL itself takes part.  Without labels, and where all
labels agree, the trees have nothing to tell: the verdict is that of most
labels, allow if there are none.

A null url and one without :// have an empty host and path; the trees judge
them as any other.  Repeated rows are judged apiece; a URL with contradicting
labels counts as blocked.  Of rules as long as each other the one listed first
wins.  An empty table gives an empty table.  Only page_id, url (and for labels
html) are read, whatever other columns are named.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import quality_rules
from wordloom.llm.common import ASCII_LOWER, ASCII_UPPER, in_hash_order, materialize, smallest_hashes

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: URLs that teach the trees, and labelled documents that teach the rules behind their labels.
SAMPLE, DOC_SAMPLE = 8_000, 8_000
TREES, DEPTH, RATE = 40, 3, 0.3
SUFFIXES = 64
FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "hyphens", "digits", "entropy", "params", "query_len", "suffix_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of two as long the one listed first; nulls where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def with_features(df: DataFrame) -> DataFrame:
    """df (url, host, path) with all features but suffix_rate, and suffix."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    n = F.char_length("host")
    # the characters of the host, and how often each stands there
    marked = df.withColumn("chars", F.filter(F.split("host", ""), lambda c: c != ""))
    counted = marked.withColumn("counts", F.transform(F.array_distinct("chars"), lambda c: F.size(F.filter("chars", lambda x: x == c)).cast("double"))).drop("chars")
    told = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c * F.log2(c))
    entropy = F.when(F.size("counts") > 0, F.log2(n) - told / n).otherwise(0.0)
    return counted.withColumns({
        "url_len": F.char_length(url).cast("double"), "host_len": n.cast("double"), "path_len": F.char_length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"), "labels": F.regexp_count("host", F.lit(r"\.")).cast("double"),
        "hyphens": F.regexp_count("host", F.lit("-")).cast("double"), "digits": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.char_length(url), F.lit(1)),
        "entropy": entropy, "params": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0), "query_len": F.char_length(query).cast("double"),
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
    }).drop("counts")


class Trees:
    """Boosted regression trees for the logistic loss, grown level by level over quantile cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        rate0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = math.log(rate0 / (1 - rate0))
        self.trees: list = []
        if not len(y) or y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            score = score + self._apply(tree, x)

    def _grow(self, x, grad, hess, cuts, rows, depth, rate):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(rate * g / (h + 1.0))
        if not depth or len(rows) < 20:
            return leaf
        best = (1e-6, None, None)
        for f, at in enumerate(cuts):
            slot = np.searchsorted(at, x[rows, f], side="right")
            gl = np.cumsum(np.bincount(slot, grad[rows], len(at) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, hess[rows], len(at) + 1))[:-1]
            nl = np.cumsum(np.bincount(slot, minlength=len(at) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 10) | (len(rows) - nl < 10)] = 0
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), f, float(at[i]))
        if best[1] is None:
            return leaf
        left = x[rows, best[1]] < best[2]
        return best[1], best[2], self._grow(x, grad, hess, cuts, rows[left], depth - 1, rate), self._grow(x, grad, hess, cuts, rows[~left], depth - 1, rate)

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] < cut, self._apply(low, x), self._apply(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def best_count(self, x: np.ndarray, y: np.ndarray) -> int:
        """Of how many of the first trees the logarithmic loss on other rows is smallest."""

        def loss(score: np.ndarray) -> float:
            return float(np.logaddexp(0, np.where(y > 0, -score, score)).mean())

        score = np.full(len(y), self.base)
        losses = [loss(score)]
        for tree in self.trees:
            score = score + self._apply(tree, x)
            losses.append(loss(score))
        return int(np.argmin(losses))

    def column(self) -> Column:
        """The summed score as an expression over FEATURES."""

        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, low, high = tree
            return F.when(F.col(FEATURES[f]) < cut, of(low)).otherwise(of(high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + of(tree)
        return out


def _blocked(rows: list) -> np.ndarray:
    return np.array([float(r[-1]) for r in rows])


class UrlModel:
    """Suffix statistics and trees from labelled rows of (FEATURES[:-1], suffix, blocked)."""

    def __init__(self, rows: list):
        # as many trees as serve rows that they have not seen: none where the features tell nothing
        seen, held = [r for i, r in enumerate(rows) if i % 3], rows[::3]
        self._count_suffixes(seen)
        first = Trees(self._matrix(seen), _blocked(seen))
        count = first.best_count(self._matrix(held), _blocked(held)) if held else 0
        self._count_suffixes(rows)
        self.trees = Trees(self._matrix(rows), _blocked(rows), count)

    def _count_suffixes(self, rows: list) -> None:
        self.prior = float(_blocked(rows).mean()) if rows else 0.5
        tally: dict[str, list[float]] = {}
        for r in rows:
            t = tally.setdefault(r[-2], [0.0, 0.0])
            t[0] += r[-1]
            t[1] += 1
        common = sorted(tally, key=lambda s: (-tally[s][1], s))[:SUFFIXES]
        self.rate = {s: (tally[s][0] + 20 * self.prior) / (tally[s][1] + 20) for s in common}

    def _matrix(self, rows: list) -> np.ndarray:
        return np.array([[*map(float, r[:-2]), self.rate.get(r[-2], self.prior)] for r in rows]).reshape(len(rows), len(FEATURES))

    def suffix_rate(self) -> Column:
        out = None
        for s, v in self.rate.items():
            out = F.when(F.col("suffix") == s, v) if out is None else out.when(F.col("suffix") == s, v)
        return F.lit(self.prior) if out is None else out.otherwise(self.prior)


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """From labelled (url, host, path, blocked); the sample is of distinct URLs and reaches the driver."""
    distinct = smallest_hashes(labelled, ["url"], sample).groupBy("url", "host", "path").agg(F.max("blocked").alias("blocked"))
    chosen = distinct.orderBy(*in_hash_order(["url"])).limit(sample)
    return UrlModel(with_features(chosen).select(*FEATURES[:-1], "suffix", F.col("blocked").cast("int")).collect())


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles and tags, for its statistics only (operator 5 extracts the main text)."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(p|div|h[1-6]|li|br|tr|article|section)\b[^>]*>", "\n"), r"<[^>]*>", " ")


def labels_of_pages(pages: DataFrame, docs: DataFrame, doc_labels: DataFrame, sample: int = SAMPLE, doc_sample: int = DOC_SAMPLE) -> DataFrame:
    """(url, blocked) for a bounded sample of the pages' URLs (page_id, url, html): whether the page's text fails rules learned from docs (doc_id, text) and doc_labels (doc_id, quality)."""
    rules = quality_rules.learned(docs, doc_labels, doc_sample)
    named = pages.where("url is not null").select("url", page_text(F.col("html")).alias("text"))
    near = smallest_hashes(named, ["url"], sample).withColumn("doc_id", F.lit(0))
    judged = quality_rules.statistics(near, ("url",)).select("url", (quality_rules.base_failed() | quality_rules.verdict(rules).isNotNull()).alias("blocked"))
    return materialize(judged, "url-labels")


def judge_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row of pages (page_id, url), by trees that are fitted to labels (url, blocked)."""
    host, path = parts(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    scored = own.select("page_id", "host", "path", rule.alias("rule"), said.alias("_said"), F.lit(0.0).alias("score"))
    if labels is not None:
        labelled = labels.where("url is not null and blocked is not null").select("url", host.alias("host"), path.alias("path"), F.col("blocked").cast("boolean").alias("blocked"))
        model = train(labelled, sample)
        marked = with_features(own).withColumn("suffix_rate", model.suffix_rate())
        scored = marked.select("page_id", "host", "path", rule.alias("rule"), said.alias("_said"), (1 / (1 + F.exp(-model.trees.column()))).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
