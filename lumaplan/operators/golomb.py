"""Adaptive Golomb-Rice codes with runs."""

from __future__ import annotations

from dataclasses import dataclass

from lumaplan.operators.bits import BitReader, BitWriter
from lumaplan.operators.errors import EXHAUSTED, INVALID_ARGUMENT, INVALID_STATE, SYNTAX, CodecError

# log2 of the run length at each run index.
LOG2_RUN = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24]
# Fixed value: so many zeros announce an escaped value.
ESCAPE = 12


def sign_extend(v: int, bits: int) -> int:
    half = 1 << bits - 1
    return (v + half & (1 << bits) - 1) - half


def write_code(out: BitWriter, k: int, bits: int, v: int) -> None:
    n = 2 * v if v >= 0 else -2 * v - 1
    if n >> k < ESCAPE:
        out.bits(1 << k | n & (1 << k) - 1, (n >> k) + 1 + k)
    else:
        out.bits(n - ESCAPE + 1, ESCAPE + bits)


def read_code(source: BitReader, k: int, bits: int) -> int:
    zeros = 0
    while zeros < ESCAPE and not source.bits(1):
        zeros += 1
    n = source.bits(bits) + ESCAPE - 1 if zeros == ESCAPE else zeros << k | (source.bits(k) if k else 0)
    return n >> 1 if not n & 1 else -(n >> 1) - 1


@dataclass
class Adaptive:
    """What a context has seen."""

    drift: int = 0
    error_sum: int = 4
    bias: int = 0
    count: int = 1

    def k(self) -> int:
        k = max(0, (-(-self.error_sum // self.count) - 1).bit_length())
        if k > 31:
            raise CodecError(INVALID_STATE, "the context needs a parameter over 31")
        return k

    def learn(self, v: int) -> None:
        self.error_sum += abs(v)
        self.drift += v
        if self.count == 128:
            self.count, self.drift, self.error_sum = 64, self.drift >> 1, self.error_sum >> 1
        self.count += 1
        if self.drift <= -self.count:
            self.bias, self.drift = max(self.bias - 1, -128), max(self.drift + self.count, 1 - self.count)
        elif self.drift > 0:
            self.bias, self.drift = min(self.bias + 1, 127), min(self.drift - self.count, 0)

    def write(self, out: BitWriter, bits: int, v: int) -> None:
        seen = sign_extend(v - self.bias, bits)
        write_code(out, self.k(), bits, -1 - seen if 2 * self.drift < -self.count else seen)
        self.learn(seen)

    def read(self, source: BitReader, bits: int) -> int:
        seen = read_code(source, self.k(), bits)
        if 2 * self.drift < -self.count:
            seen = -1 - seen
        v = sign_extend(seen + self.bias, bits)
        self.learn(seen)
        return v


@dataclass
class Runs:
    """Index into LOG2_RUN, and what is left of a run that goes over the end of a row."""

    index: int = 0
    pending: int = 0

    def longer(self) -> None:
        if self.index + 1 >= len(LOG2_RUN):
            raise CodecError(EXHAUSTED, "a run is longer than the table allows")
        self.index += 1

    def write(self, out: BitWriter, room: int, length: int) -> None:
        """length matching samples of the room left in the row; then an interruption, unless they fill the row exactly in whole runs."""
        if length > room:
            raise CodecError(INVALID_ARGUMENT, "the run leaves the row")
        while True:
            full = 1 << LOG2_RUN[self.index]
            if length < full:
                out.bits(length, 1 + LOG2_RUN[self.index])
                self.index = max(0, self.index - 1)
                return
            out.bits(1, 1)
            self.longer()
            length, room = length - full, room - full
            if not room:
                return

    def read(self, source: BitReader, room: int) -> tuple[int, bool]:
        """Length of the next segment inside the row, and whether a sample that breaks the run follows."""
        if self.pending:
            n = min(self.pending, room)
            self.pending -= n
            return n, False
        log2 = LOG2_RUN[self.index]
        if source.bits(1):
            if 1 << log2 <= room:
                self.longer()
                return 1 << log2, False
            return room, False
        n = source.bits(log2)
        self.index = max(0, self.index - 1)
        if n > room:
            self.pending = n - room
            return room, False
        return n, True


__all__ = ["Adaptive", "Runs", "read_code", "sign_extend", "write_code", "SYNTAX"]
