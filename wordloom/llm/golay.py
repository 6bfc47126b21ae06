"""The binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

The code is perfect: every word lies within 3 bits of one codeword.  The keys
of a word are the indices of the codewords nearest to it and to its 23
neighbours: one key, or six.  Two words that differ in at most 2 bits share a
key (``tests/llm`` proves it over all syndromes and error patterns).
"""

from __future__ import annotations

import numpy as np

_GENERATOR = 0b101011100011


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = np.array([_syndrome(x) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([_syndrome(x << 12) for x in range(1 << 11)], dtype=np.int64)
    bit = [1 << i for i in range(23)]
    leader = {0: 0}
    for i in range(23):
        leader[_syndrome(bit[i])] = bit[i]
        for j in range(i):
            leader[_syndrome(bit[i] | bit[j])] = bit[i] | bit[j]
            for k in range(j):
                leader[_syndrome(bit[i] | bit[j] | bit[k])] = bit[i] | bit[j] | bit[k]
    moves = np.full((1 << 11, 6), -1, dtype=np.int64)
    for s in range(1 << 11):
        near = {leader[s]} | {bit[i] ^ leader[s ^ _syndrome(bit[i])] for i in range(23)}
        moves[s, : len(near)] = sorted(near)
    return low, high, moves


LOW, HIGH, MOVES = _tables()


def keys(words: np.ndarray) -> np.ndarray:
    """Codeword indices (0 to 4095) of each 23-bit word, six columns, -1 where there are fewer."""
    words = words.astype(np.int64)
    moves = MOVES[LOW[words & 0xFFF] ^ HIGH[words >> 12]]
    return np.where(moves < 0, -1, (words[:, None] ^ moves) >> 11)
