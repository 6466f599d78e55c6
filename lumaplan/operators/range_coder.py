"""Adaptive binary range coder and its integers."""

from __future__ import annotations

from functools import lru_cache

from lumaplan.operators.errors import INTERNAL, INVALID_ARGUMENT, SYNTAX, CodecError

START = 128


def adaptive_transitions(rate: float = 0.05, top: int = 248) -> bytes:
    """State after a one, for each 8-bit probability state: the probability moves by `rate` towards one, in 32-bit fixed point,
    always by a step at least and never over `top`. First the chain from one half, then the states between."""
    one = 1 << 32
    factor = int(rate * one)
    toward = lambda p: p + ((one - p) * factor + one // 2 >> 32)
    eighth = lambda p: (256 * p + one // 2) >> 32
    table = [0] * 256
    p, last = one // 2, 0
    for _ in range(128):
        now = max(eighth(p), last + 1)
        if last and now <= top:
            table[last] = now
        p, last = toward(p), now
    for s in range(256 - top, top + 1):
        if not table[s]:
            table[s] = min(max(eighth(toward((s * one + 128) >> 8)), s + 1), top)
    return bytes(table)


DEFAULT_TRANSITIONS = adaptive_transitions()


@lru_cache(maxsize=64)
def zero_transitions(after_one: bytes) -> bytes:
    return bytes([0, *(256 - after_one[256 - s] & 255 for s in range(1, 256))])


def fresh_states(contexts: int) -> list[bytearray]:
    return [bytearray([START] * 32) for _ in range(contexts)]


class RangeDecoder:
    """Two bytes start the low value; a byte comes in whenever the range falls under 256; zeros follow the end."""

    def __init__(self, data: bytes, transitions: bytes = DEFAULT_TRANSITIONS):
        if len(data) < 2:
            raise CodecError(SYNTAX, "a range coded payload has at least two bytes", 0)
        self.data, self.range, self.low, self.at = data, 0xFF00, data[0] << 8 | data[1], 2
        self.ended = len(data) == 2
        if self.low >= self.range:
            self.low, self.ended = self.range, True
        self.use(transitions)
        #: Legacy streams with zero symbols that add one to low.
        self.zero_symbol_carry = False

    def use(self, transitions: bytes) -> None:
        self.one, self.zero = transitions, zero_transitions(transitions)

    def bit(self, states: bytearray, i: int) -> int:
        s = states[i]
        top = self.range * s >> 8
        rest = self.range - top
        if self.low < rest:
            self.range, states[i], b = rest, self.zero[s], 0
        else:
            self.low -= rest
            self.range, states[i], b = top, self.one[s], 1
        if self.range < 256:
            self.range <<= 8
            self.low <<= 8
            if not self.ended:
                if self.at < len(self.data):
                    self.low += self.data[self.at]
                    self.at += 1
                self.ended = self.at >= len(self.data)
        return b

    def symbol(self, states: bytearray, signed: bool) -> int:
        bit = self.bit
        if bit(states, 0):
            if self.zero_symbol_carry:
                self.low += 1
            return 0
        e = 0
        while bit(states, 1 + (e if e < 9 else 9)):
            e += 1
            if e > 62:
                raise CodecError(SYNTAX, "a range coded integer is too long", self.at)
        v = 1
        for i in range(e - 1, -1, -1):
            v = v << 1 | bit(states, 22 + (i if i < 9 else 9))
        return -v if signed and bit(states, 11 + (e if e < 10 else 10)) else v

    def state(self) -> tuple[int, int, int, bool]:
        return self.range, self.low, self.at, self.ended

    def resume(self, state: tuple[int, int, int, bool]) -> None:
        self.range, self.low, self.at, self.ended = state


def old_split(span: int, state: int) -> tuple[int, int]:
    """How the oldest streams split a range: the share of a one, which is state / 256 of it rounded up, and how many of both exact
    shares (that of a one, that of a zero) were no whole numbers. The decoder adds that number to low after a one."""
    ones, zeros = span * state, span * (256 - state)
    return -(-ones // 256), (ones % 256 > 0) + (zeros % 256 > 0)


class OldRangeDecoder(RangeDecoder):
    """The arithmetic of the oldest streams; see old_split()."""

    def bit(self, states: bytearray, i: int) -> int:
        s = states[i]
        share, rounded = old_split(self.range, s)
        rest = self.range - share
        b = int(self.low >= rest)
        if b:
            self.low -= rest
        self.range = share if b else rest
        states[i] = (self.one if b else self.zero)[s]
        if self.range < 256:
            self.range <<= 8
            self.low <<= 8
            if not self.ended:
                if self.at < len(self.data):
                    self.low += self.data[self.at]
                    self.at += 1
                self.ended = self.at >= len(self.data)
        if b:
            self.low += rounded
        return b


class RangeEncoder:
    """Keeps the last two bytes of the lower bound as a number; a carry runs back into the bytes before."""

    def __init__(self, transitions: bytes = DEFAULT_TRANSITIONS):
        self.out, self.range, self.low = bytearray(), 0xFF00, 0
        self.one, self.zero = transitions, zero_transitions(transitions)

    def _add(self, n: int) -> None:
        self.low += n
        if self.low > 0xFFFF:
            self.low &= 0xFFFF
            i = len(self.out) - 1
            while i >= 0 and self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            if i < 0:
                raise CodecError(INTERNAL, "the lower bound outgrew its precision")
            self.out[i] += 1

    def bit(self, states: bytearray, i: int, b: int) -> None:
        s = states[i]
        top = self.range * s >> 8
        rest = self.range - top
        if not (top if b else rest):
            raise CodecError(INVALID_ARGUMENT, "the state gives this value no room")
        if b:
            self._add(rest)
            self.range, states[i] = top, self.one[s]
        else:
            self.range, states[i] = rest, self.zero[s]
        if self.range < 256:
            self.range <<= 8
            self.out.append(self.low >> 8)
            self.low = (self.low & 255) << 8

    def symbol(self, states: bytearray, v: int, signed: bool) -> None:
        if not signed and v < 0:
            raise CodecError(INVALID_ARGUMENT, "an unsigned value is negative")
        if not v:
            self.bit(states, 0, 1)
            return
        m = abs(v)
        if m >> 63:
            raise CodecError(INVALID_ARGUMENT, "the value has more than 63 bits")
        self.bit(states, 0, 0)
        e = m.bit_length() - 1
        for i in range(e):
            self.bit(states, 1 + min(i, 9), 1)
        self.bit(states, 1 + min(e, 9), 0)
        for i in range(e - 1, -1, -1):
            self.bit(states, 22 + min(i, 9), m >> i & 1)
        if signed:
            self.bit(states, 11 + min(e, 10), int(v < 0))

    def lower_bound(self) -> bytes:
        return bytes(self.out) + self.low.to_bytes(2, "big")

    def closed(self) -> bytes:
        """A value inside the interval whose last byte is zero, near its middle; that byte is dropped."""
        least, half = -self.low & 255, self.range // 2
        below = max(0, half - least >> 8)
        near = [d for d in (least + 256 * below, least + 256 * below + 256) if d < self.range]
        self._add(min(near, key=lambda d: (abs(d - half), d)) if near else half)
        data = self.lower_bound()
        return data[:-1] if len(data) > 2 and data[-1] == 0 else data


class IntervalEncoder(RangeEncoder):
    """For decoders that add to low on the way: after zero symbols (zero_symbol_carry), or by the oldest arithmetic (old).

    What such a decoder has added is as if its lower bound lay so much lower, while the values that the decisions so far allow
    stay where they are. So both are kept: the bound, and from it the least allowed value and the limit. A decision halves the
    allowed values as the decoder will; if it leaves none, no stream says these symbols, and that is an error.
    """

    def __init__(self, transitions: bytes = DEFAULT_TRANSITIONS):
        super().__init__(transitions)
        self.least, self.limit = 0, self.range
        self.old = self.zero_symbol_carry = False

    def _lower(self, n: int) -> None:
        """The bound sinks by n."""
        self.least += n
        self.limit += n
        self.low -= n
        if self.low < 0:
            self.low += 0x10000
            i = len(self.out) - 1
            while i >= 0 and not self.out[i]:
                self.out[i] = 255
                i -= 1
            if i < 0:
                raise CodecError(INTERNAL, "the lower bound sank under zero")
            self.out[i] -= 1

    def bit(self, states: bytearray, i: int, b: int) -> None:
        s = states[i]
        share, rounded = old_split(self.range, s) if self.old else (self.range * s >> 8, 0)
        rest = self.range - share
        least, limit = (max(self.least, rest), self.limit) if b else (self.least, min(self.limit, rest))
        if least >= limit or not (share if b else rest):
            raise CodecError(INVALID_ARGUMENT, "no stream of this arithmetic says these samples")
        self.least, self.limit = least, limit
        if b:
            self._add(rest)
            self.least, self.limit = least - rest, limit - rest
        self.range, states[i] = (share, self.one[s]) if b else (rest, self.zero[s])
        if self.range < 256:
            self.range, self.least, self.limit = self.range << 8, self.least << 8, self.limit << 8
            self.out.append(self.low >> 8)
            self.low = (self.low & 255) << 8
        if b and rounded:
            self._lower(rounded)

    def symbol(self, states: bytearray, v: int, signed: bool) -> None:
        super().symbol(states, v, signed)
        if not v and self.zero_symbol_carry:
            self._lower(1)

    def closed(self) -> bytes:
        """An allowed value, one whose last byte is zero if there is one; that byte is dropped."""
        first = self.least + (-(self.low + self.least) & 255)
        self._add(first if first < self.limit else self.least)
        data = self.lower_bound()
        return data[:-1] if len(data) > 2 and data[-1] == 0 else data
