"""Repeats of a minimum length by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Suffixes are sorted by their first ``min_len`` bytes and more (prefix doubling),
the transform is taken from that order, and a breadth-first backward extension
derives common-prefix lengths by increasing value: all intervals of strings of
length l are extended by every byte that precedes them, and a border reached
for the first time gets the value l.  The expansion stops at ``min_len``;
borders without a value join suffixes that share ``min_len`` bytes or more.
"""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by at least their first ``depth`` bytes (short suffixes are padded with zeros)."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    have = 8
    while have < depth:
        # only suffixes that still tie are sorted again, inside their own places
        ends = np.append(fresh[1:], True)
        tied = np.flatnonzero(~(fresh & ends))
        if not len(tied):
            break
        at = order[tied]
        group = rank[at]
        far = at + have
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        inner = np.argsort((group << 32) | second, kind="stable")
        at, group, second = at[inner], group[inner], second[inner]
        order[tied] = at
        start = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        fresh[tied] = start
        rank[at] = tied[np.flatnonzero(start)[np.cumsum(start) - 1]]
        have *= 2
    return order


class _Wavelet:
    """A wavelet matrix over a transform: which symbols stand in an interval, and their ranks."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.split = [], []
        level = symbols
        for b in range(self.bits - 1, -1, -1):
            one = (level >> np.uint8(b)) & np.uint8(1)
            count = np.zeros(len(level) + 1, np.int32)
            np.cumsum(1 - one, out=count[1:], dtype=np.int32)
            self.zeros.append(count)
            self.split.append(int(count[-1]))
            level = np.concatenate((level[one == 0], level[one == 1]))
        counts = np.bincount(symbols, minlength=1 << self.bits)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # C[c], by symbol
        codes = np.arange(1 << self.bits)
        shown = sum(((codes >> i) & 1) << (self.bits - 1 - i) for i in range(self.bits))
        by_bottom = np.argsort(shown)
        bottom = np.empty(1 << self.bits, np.int64)
        bottom[by_bottom] = np.concatenate(([0], np.cumsum(counts[by_bottom])))[:-1]
        self.bottom = bottom

    def extend(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + w for every interval of w and every symbol c that stands in it."""
        code = np.zeros(len(left), np.int64)
        for count, split in zip(self.zeros, self.split):
            l0, r0 = count[left].astype(np.int64), count[right].astype(np.int64)
            l1, r1 = left - l0 + split, right - r0 + split
            a, b = r0 > l0, r1 > l1
            left, right = np.concatenate((l0[a], l1[b])), np.concatenate((r0[a], r1[b]))
            code = np.concatenate((code[a] * 2, code[b] * 2 + 1))
        start = self.first[code] - self.bottom[code]
        return left + start, right + start


def repeated_starts(data: np.ndarray, min_len: int) -> np.ndarray:
    """A flag for each position: whether the ``min_len`` bytes from it also start elsewhere in data.

    Positions within ``min_len`` of the end of data, or whose bytes cross a
    border between joined texts, carry no meaning and are for the caller to drop.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, bool)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    if len(used) > 255:
        raise ValueError("at most 255 distinct byte values; UTF-8 has 243")
    dense = np.zeros(256, np.uint8)
    dense[used] = np.arange(1, len(used) + 1)
    data = np.append(dense[data], np.uint8(0))  # the one smallest symbol ends the text
    n += 1
    order = suffix_order(data, min_len)
    symbols = data[order - 1]
    tree = _Wavelet(symbols, len(used) + 1)
    lf_order = np.argsort(symbols, kind="stable")
    lf = np.empty(n, np.int64)
    lf[lf_order] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(min_len):
        single = right - left == 1
        one = lf[left[single]]
        many_left, many_right = tree.extend(left[~single], right[~single])
        left = np.concatenate((one, many_left))
        right = np.concatenate((one + 1, many_right))
        new = ~known[right]
        left, right = left[new], right[new]
        if not len(left):
            break
        known[right] = True
    out = np.zeros(n, bool)
    out[order] = ~(known[:-1] & known[1:])
    return out[:-1]
