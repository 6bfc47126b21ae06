"""Vectorised rolling hashes, window minimisers and context runs over UTF-8 bytes.

Every window of ``min_len`` bytes has one canonical anchor: the ``kgram``-byte
string inside it with the smallest hash (the last one on ties).  Equal windows
therefore have equal anchors at equal relative places, so comparing windows
group by group of equal anchors loses no match.  Consecutive windows of one
text with the same anchor form a run; a run is described by its anchor hash,
its first window and a hash of all bytes that its windows span.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240611)
_TABLE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_POW_CACHE: dict[str, np.ndarray] = {}
#: Bytes hashed at once; positions inside a block take the low 24 bits of a key.
BLOCK = 1 << 22
_LOW = np.uint64((1 << 24) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    have = _POW_CACHE.get("p")
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            power = np.full(size, _BASE, dtype=np.uint64)
            power[0] = 1
            back = np.full(size, inverse, dtype=np.uint64)
            back[0] = 1
            _POW_CACHE["p"] = np.multiply.accumulate(power)
            _POW_CACHE["i"] = np.multiply.accumulate(back)
    return _POW_CACHE["p"], _POW_CACHE["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the polynomial's strong high bits over all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xA0761D6478BD642F)
        return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of table[byte] * base**position; n + 1 of them."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end); equal strings have equal hashes wherever they stand."""
    _, back = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def rolling(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, by their starts."""
    n = len(sums) - size
    _, back = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[size:] - sums[:n]) * back[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(data: np.ndarray, min_len: int, kgram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window start, number of windows) of each run of one text."""
    n = len(data)
    if n < min_len:
        z = np.zeros(0, dtype=np.uint64)
        return z, z, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    parts, width = [], min_len - kgram + 1
    for at in range(0, n - min_len + 1, BLOCK):
        block = data[at : at + BLOCK + min_len - 1]
        sums = prefix_sums(block)
        grams = rolling(sums, kgram)
        keys = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
        best = sliding_min(keys, width)
        first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        count = np.diff(np.append(first, len(best)))
        anchor = (_LOW - (best[first] & _LOW)).astype(np.int64)
        parts.append((grams[anchor], span_hash(sums, first, first + count - 1 + min_len), first + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts))
