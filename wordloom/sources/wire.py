"""Protocol-buffer wire format: the few primitives a model file needs, both ways."""

from __future__ import annotations

import struct

VARINT, FIXED64, BYTES, GROUP, END_GROUP, FIXED32 = range(6)


class WireError(ValueError):
    """Truncated or malformed data."""


class Reader:
    def __init__(self, data: bytes, start: int = 0, end: int | None = None):
        self.data, self.start, self.at, self.end = data, start, start, len(data) if end is None else end

    @property
    def done(self) -> bool:
        return self.at >= self.end

    def seek(self, at: int) -> None:
        if not 0 <= at <= self.end - self.start:
            raise WireError(f"position {at} is outside the data")
        self.at = self.start + at

    def reset(self) -> None:
        self.at = self.start

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise WireError("truncated data")
        self.at += n
        return self.data[self.at - n : self.at]

    def rest(self) -> bytes:
        return self.take(self.end - self.at)

    def varint(self) -> int:
        value = 0
        for shift in range(0, 70, 7):
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value & (2**64 - 1)
        raise WireError("varint of more than 64 bits")

    def signed(self) -> int:
        """Two's complement, without zigzag."""
        value = self.varint()
        return value - 2**64 if value >= 2**63 else value

    def tag(self) -> tuple[int, int] | None:
        if self.done:
            return None
        value = self.varint()
        return value >> 3, value & 7

    def fixed32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def fixed64(self) -> int:
        return struct.unpack("<Q", self.take(8))[0]

    def float(self) -> float:
        return struct.unpack("<f", self.take(4))[0]

    def double(self) -> float:
        return struct.unpack("<d", self.take(8))[0]

    def bool(self) -> bool:
        return self.varint() != 0

    def bytes(self) -> bytes:
        return self.take(self.varint())

    def string(self) -> str:
        return self.bytes().decode("utf-8", "replace")

    def message(self) -> Reader:
        n = self.varint()
        start = self.at
        self.take(n)
        return Reader(self.data, start, start + n)

    def packed(self, read: str) -> list:
        inner, out = self.message(), []
        while not inner.done:
            out.append(getattr(inner, read)())
        return out

    def skip(self, kind: int) -> None:
        if kind == VARINT:
            self.varint()
        elif kind == FIXED64:
            self.take(8)
        elif kind == BYTES:
            self.bytes()
        elif kind == FIXED32:
            self.take(4)
        elif kind == GROUP:
            while (tag := self.tag()) is not None and tag[1] != END_GROUP:
                self.skip(tag[1])
        elif kind != END_GROUP:
            raise WireError(f"unknown wire type {kind}")


class Writer:
    def __init__(self):
        self.out = bytearray()

    def varint(self, value: int) -> Writer:
        value &= 2**64 - 1
        while value > 0x7F:
            self.out.append(value & 0x7F | 0x80)
            value >>= 7
        self.out.append(value)
        return self

    def number(self, field: int, value: int) -> Writer:
        return self.varint(field << 3 | VARINT).varint(value)

    def single(self, field: int, value: float) -> Writer:
        self.varint(field << 3 | FIXED32)
        self.out += struct.pack("<f", value)
        return self

    def blob(self, field: int, value: bytes | str) -> Writer:
        value = value.encode() if isinstance(value, str) else value
        self.varint(field << 3 | BYTES).varint(len(value))
        self.out += value
        return self
