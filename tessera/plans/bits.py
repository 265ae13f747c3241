"""Bit streams, most significant bit first, and the primitive values on them."""

from __future__ import annotations


def width(n: int) -> int:
    """Bits that tell n values apart."""
    return max(0, n - 1).bit_length()


class Writer:
    """Bits are gathered in an integer and moved out in whole bytes."""

    def __init__(self, aligned: bool = False):
        self.out, self._acc, self._n, self.aligned = bytearray(), 0, 0, aligned

    def bits(self, value: int, n: int) -> None:
        self._acc = self._acc << n | value
        self._n += n
        if self._n >= 8:
            rest = self._n % 8
            self.out += (self._acc >> rest).to_bytes((self._n - rest) // 8, "big")
            self._acc &= (1 << rest) - 1
            self._n = rest

    def align(self) -> None:
        if self._n:
            self.bits(0, 8 - self._n)

    def number(self, value: int, n: int) -> None:
        """An n-bit number; in aligned streams in whole bytes, the lowest first."""
        if self.aligned:
            self.align()
            self.out += value.to_bytes((n + 7) // 8, "little")
        else:
            self.bits(value, n)

    def unsigned(self, value: int) -> None:
        """Groups of seven bits, the lowest first, each but the last marked."""
        if value < 0:
            raise ValueError("unsigned value below zero")
        while value > 127:
            self.bits(value & 127 | 128, 8)
            value >>= 7
        self.bits(value, 8)

    def integer(self, value: int) -> None:
        self.number(int(value < 0), 1)
        self.unsigned(~value if value < 0 else value)

    def string(self, text: str, offset: int = 0) -> None:
        """Its length in code points, plus an offset, then the code points."""
        self.unsigned(len(text) + offset)
        if text.isascii() and not self._n:
            self.out += text.encode()
        else:
            for c in text:
                self.unsigned(ord(c))

    def done(self) -> bytes:
        self.align()
        return bytes(self.out)


class Reader:
    """The mirror of ``Writer``; raises EOFError past the end."""

    def __init__(self, data: bytes, aligned: bool = False):
        self.data, self.at, self.aligned = data, 0, aligned

    def bits(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at // 8, (self.at + n + 7) // 8
        if b > len(self.data):
            raise EOFError("stream ends inside a value")
        self.at += n
        return int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at) & (1 << n) - 1

    def align(self) -> None:
        self.at = (self.at + 7) // 8 * 8

    def number(self, n: int) -> int:
        if not self.aligned:
            return self.bits(n)
        self.align()
        a, size = self.at // 8, (n + 7) // 8
        if a + size > len(self.data):
            raise EOFError("stream ends inside a value")
        self.at += 8 * size
        return int.from_bytes(self.data[a : a + size], "little")

    def unsigned(self) -> int:
        value = shift = 0
        while True:
            b = self.bits(8)
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
            if shift > 70_000:
                raise ValueError("unsigned value too long")

    def integer(self) -> int:
        negative = self.number(1)
        value = self.unsigned()
        return ~value if negative else value

    def characters(self, n: int) -> str:
        if n > len(self.data) * 8:
            raise EOFError("string longer than the stream")
        return "".join(chr(self.unsigned()) for _ in range(n))

    def string(self) -> str:
        return self.characters(self.unsigned())

    def rest(self) -> bytes:
        self.align()
        return self.data[self.at // 8 :]
