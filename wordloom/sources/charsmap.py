"""Precompiled character maps: a double-array trie over UTF-8 bytes and a pool of replacements."""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

from wordloom.model import FormatError


class Charsmap:
    def __init__(self, units: np.ndarray, pool: bytes):
        self.units, self.pool = units, pool

    @staticmethod
    def parse(blob: bytes) -> Charsmap:
        if len(blob) < 4:
            raise FormatError("charsmap of fewer than 4 bytes")
        (size,) = struct.unpack_from("<I", blob)
        if size > len(blob) - 4:
            raise FormatError("charsmap trie exceeds its data")
        if size % 4:
            raise FormatError("charsmap trie size is not a multiple of 4")
        return Charsmap(np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :])

    def to_bytes(self) -> bytes:
        return struct.pack("<I", 4 * len(self.units)) + self.units.astype("<u4").tobytes() + self.pool

    @cached_property
    def _list(self) -> list[int]:
        return self.units.tolist()

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(bytes matched, place in the pool) of the longest key at a position."""
        units = self._list
        if not units:
            return None
        node = _jump(units[0])
        best = None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= _jump(unit)
            if unit >> 8 & 1 and node < len(units):
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        return best

    def normalize(self, text: str) -> str:
        """Leftmost-longest replacement; characters without a key stay."""
        data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit:
                end = self.pool.find(b"\0", hit[1])
                out.append(self.pool[hit[1] : len(self.pool) if end < 0 else end])
                at += hit[0]
            else:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                out.append(data[at : at + size])
                at += size
        return b"".join(out).decode("utf-8", "replace")

    @staticmethod
    def build(mapping: dict[str, str]) -> Charsmap:
        """A map from its pairs, for models made in memory."""
        pool, place = bytearray(), {}
        for value in mapping.values():
            if value not in place:
                place[value] = len(pool)
                pool += value.encode() + b"\0"
        trie: dict = {}
        for key, value in mapping.items():
            node = trie
            for b in key.encode():
                node = node.setdefault(b, {})
            node[-1] = place[value]
        units, taken = [0] * 256, [True] + [False] * 255
        bases: set[int] = set()  # units name no parent, so that no two nodes may share one

        def room(n: int) -> None:
            while len(units) < n:
                units.extend([0] * 256)
                taken.extend([False] * 256)

        def lay(node: dict, at: int) -> None:
            labels = [0 if c < 0 else c for c in node]
            base = 1
            while True:
                room((base | 255) + 1)
                if base not in bases and not any(taken[base ^ c] for c in labels) and _fits(at ^ base):
                    bases.add(base)
                    break
                base += 1
            for c in labels:
                taken[base ^ c] = True
            units[at] |= _offset(at ^ base)
            if -1 in node:
                units[at] |= 1 << 8
                units[base] = node[-1] | 1 << 31
            for c, child in node.items():
                if c >= 0:
                    units[base ^ c] = c
                    lay(child, base ^ c)

        if trie:
            lay(trie, 0)
        return Charsmap(np.array(units, "<u4"), bytes(pool))


def _jump(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


def _fits(offset: int) -> bool:
    return offset < 1 << 21 or offset & 0xFF == 0 and offset < 1 << 29


def _offset(offset: int) -> int:
    return offset << 10 if offset < 1 << 21 else offset << 2 | 1 << 9
