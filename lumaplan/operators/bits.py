"""Bits, most significant first, and the 32-bit CRC of the bitstream."""

from __future__ import annotations

import zlib

from lumaplan.operators.errors import SYNTAX, CodecError

# Fixed value: the generator polynomial 0x04c11db7; no reflection, start 0, no final complement.
POLYNOMIAL = 0x04C11DB7


_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def _turn32(v: int) -> int:
    return int.from_bytes(v.to_bytes(4, "little").translate(_TURNED), "big")


def crc32_msb(data: bytes, crc: int = 0) -> int:
    """Over data followed by its own big-endian CRC the result is 0. The same polynomial with all bits turned round is that of zlib,
    which starts and ends with a complement."""
    return _turn32(zlib.crc32(data.translate(_TURNED), _turn32(crc) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)


class BitReader:
    def __init__(self, data: bytes, start_bit: int = 0):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), start_bit

    def bits(self, n: int) -> int:
        if self.at + n > self.size:
            raise CodecError(SYNTAX, "the bitstream ends inside a field", self.at // 8)
        self.at += n
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8

    @property
    def left(self) -> int:
        return self.size - self.at


class WindowedBitReader(BitReader):
    """The same over long data, by a window of 64 bytes, so that a read does not shift the whole."""

    def __init__(self, data: bytes, start_bit: int = 0):
        self.data, self.size, self.at, self.base = data, 8 * len(data), start_bit, -1
        self._load()

    def _load(self) -> None:
        self.base = self.at // 8
        self.value = int.from_bytes(self.data[self.base : self.base + 64].ljust(64, b"\0"), "big")

    def bits(self, n: int) -> int:
        if self.at + n > self.size:
            raise CodecError(SYNTAX, "the bitstream ends inside a field", self.at // 8)
        if self.at + n - 8 * self.base > 512:
            self._load()
        self.at += n
        return self.value >> (512 - self.at + 8 * self.base) & ((1 << n) - 1)


class BitWriter:
    def __init__(self) -> None:
        self.out, self.acc, self.have = bytearray(), 0, 0

    def bits(self, value: int, n: int) -> None:
        self.acc = self.acc << n | value
        self.have += n
        while self.have >= 8:
            self.have -= 8
            self.out.append(self.acc >> self.have & 255)
        self.acc &= (1 << self.have) - 1

    def finish(self) -> bytes:
        """Pads with zero bits to a whole byte."""
        if self.have:
            self.bits(0, 8 - self.have)
        return bytes(self.out)
