"""Many slices coded in lockstep: a numpy lane a slice, a vector step a decision or sample.

The serial coder (slices.py) is the definition. Lanes give the same bytes and samples for slices that code without a fault;
a lane that meets one is only marked, and its chain is coded anew by the serial coder, which knows what to report.
"""

from __future__ import annotations

import numpy as np

from lumaplan.operators.golomb import ESCAPE, LOG2_RUN
from lumaplan.operators.range_coder import RangeEncoder, zero_transitions
from lumaplan.operators.slices import KEYFRAME_START, Header, Slice, banks_of, coded_planes, plain_planes, residuals, row_order, with_footer, write_header
from lumaplan.operators.stream import GOLOMB, RGB, YCBCR, StreamConfig

#: Below so many lanes the serial coder is as quick.
FEWEST = 128
_LOG2_RUN = np.array(LOG2_RUN, np.int64)
#: Zeros before the first one among ESCAPE bits.
_ZEROS = np.array([ESCAPE - int(v).bit_length() for v in range(1 << ESCAPE)], np.int64)


def bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def bank_starts(c: StreamConfig, sets: tuple[int, ...]) -> np.ndarray:
    """Where each bank's contexts begin among those of all banks, and how many there are."""
    return np.concatenate([[0], np.cumsum([c.quant_sets[i].contexts for i in sets])]).astype(np.int64)


def state_bytes(c: StreamConfig, sets: tuple[int, ...]) -> int:
    return 32 * int(bank_starts(c, sets)[-1])


def lanes_at_once(c: StreamConfig, sets: tuple[int, ...], samples: int, most: int = 4096, room: int = 96 << 20, room_samples: int = 1 << 19) -> int:
    """samples: those of one lane's frame; a worker needs some 300 bytes for each of them in all lanes."""
    return max(1, min(most, room // max(1, state_bytes(c, sets)), room_samples // max(1, samples)))


def _fresh(c: StreamConfig, sets: tuple[int, ...], lanes: int) -> np.ndarray:
    """Range coder: a row of states a lane. Golomb-Rice: of each lane's contexts drift, error sum, bias and count."""
    if c.entropy == GOLOMB:
        return np.tile(np.array([0, 4, 0, 1], np.int64), (lanes, int(bank_starts(c, sets)[-1]), 1))
    first = c.initial or (None,) * len(c.quant_sets)
    row = b"".join(bytes([128]) * 32 * c.quant_sets[i].contexts if first[i] is None else b"".join(map(bytes, first[i])) for i in sets)
    return np.tile(np.frombuffer(row, np.uint8), (lanes, 1))


def _transitions(c: StreamConfig) -> np.ndarray:
    """Next state after a zero, then after a one."""
    return np.frombuffer(zero_transitions(c.transitions) + bytes(c.transitions), np.uint8)


# ---- the decisions of an integer ----

_MOST = 20


def _symbol_plan() -> tuple[np.ndarray, np.ndarray]:
    """For each exponent (row 0: the value zero, row e + 1: exponent e) and place: the state, and what is coded: -1 zero, -2 one, -3
    the sign, else a bit of the magnitude."""
    state, what = np.zeros((_MOST + 1, 2 * _MOST + 3), np.int32), np.full((_MOST + 1, 2 * _MOST + 3), -1, np.int32)
    what[0, 0] = -2
    for e in range(_MOST):
        n = 1
        for i in range(e):
            state[e + 1, n], what[e + 1, n], n = 1 + min(i, 9), -2, n + 1
        state[e + 1, n], n = 1 + min(e, 9), n + 1
        for i in range(e - 1, -1, -1):
            state[e + 1, n], what[e + 1, n], n = 22 + min(i, 9), i, n + 1
        state[e + 1, n], what[e + 1, n] = 11 + min(e, 10), -3
    return state, what


_STATE, _WHAT = _symbol_plan()


def decisions(place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every lane's decisions, a column a lane: twice the state's place plus the bit (-1: none), and how many each lane has.
    place: where each integer's 32 states begin, lanes x integers."""
    size = np.abs(value).astype(np.int32)
    row = bit_length(size).astype(np.int32)
    count = np.where(row == 0, 1, 2 * row + 1)
    ends = np.cumsum(count, axis=1)
    total = ends[:, -1] if value.shape[1] else np.zeros(len(value), np.int64)
    lanes = np.arange(len(value), dtype=np.int32)
    out = np.full((int(total.max(initial=0)), len(value)), -1, np.int32)
    # The n-th decision of all integers that have one.
    lane, at = np.broadcast_to(lanes[:, None], value.shape).ravel(), (ends - count).ravel()
    row, size, count, minus, base = row.ravel(), size.ravel(), count.ravel(), value.ravel() < 0, 2 * place.ravel().astype(np.int32)
    for n in range(int(count.max(initial=0))):
        if n:
            some = np.flatnonzero(count > n)
            lane, at, row, size, count, minus, base = lane[some], at[some], row[some], size[some], count[some], minus[some], base[some]
        what = _WHAT[row, n]
        bit = np.where(what >= 0, size >> np.maximum(what, 0) & 1, np.where(what == -3, minus, what == -2))
        out[at + n, lane] = base + 2 * _STATE[row, n] + bit
    return out, total


def range_encode(states: np.ndarray, table: np.ndarray, place: np.ndarray, value: np.ndarray, starts: list[RangeEncoder]) -> tuple[list[RangeEncoder], np.ndarray]:
    """Codes value[lane] in order; states (lanes x places) change in place. starts: each lane's coder so far. Also which lanes met a
    state without room."""
    plan, total = decisions(place, value)
    order = np.argsort(-total, kind="stable")
    plan, total = plan[:, order], total[order]
    lanes = len(order)
    span, low = np.array([starts[i].range for i in order], np.int64), np.array([starts[i].low for i in order], np.int64)
    flat, base = states.reshape(-1), order * states.shape[1]
    digits, owners, odd = [], [], np.zeros(lanes, bool)
    alive = np.searchsorted(-total, -np.arange(len(plan)), "left")
    one = (plan & 1).astype(np.int64)
    plan = (plan >> 1) + base
    for t, n in enumerate(alive.tolist()):
        at, bit = plan[t, :n], one[t, :n]
        s = flat.take(at)
        top = span[:n] * s
        top >>= 8
        rest = span[:n] - top
        low[:n] += rest * bit
        now = np.where(bit, top, rest)
        flat[at] = table.take(s + (bit << 8))
        small = np.flatnonzero(now < 256)
        if len(small):
            # The digit may be over 255: carries are settled when the lane is done.
            digits.append(low[small] >> 8)
            owners.append(small)
            low[small] = (low[small] & 255) << 8
            odd[small] |= now[small] == 0
            now[small] = np.maximum(now[small], 1) << 8
        span[:n] = now
    digits, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (digits, owners))
    by_lane = np.argsort(owners, kind="stable")
    digits, ends = digits[by_lane], np.cumsum(np.bincount(owners, minlength=lanes))
    out: list[RangeEncoder | None] = [None] * lanes
    for j, i in enumerate(order.tolist()):
        coder = RangeEncoder()
        coder.range, coder.out = int(span[j]), bytearray(len(starts[i].out) + int(ends[j] - (ends[j - 1] if j else 0)))
        whole = np.concatenate([np.frombuffer(bytes(starts[i].out), np.uint8).astype(np.int64), digits[ends[j - 1] if j else 0 : ends[j]]])
        carry, coder.low = int(low[j]) >> 16, int(low[j]) & 0xFFFF
        if len(whole):
            whole[-1] += carry
            # Few digits are over 255; what they carry moves on while it meets digits of 255.
            while (over := np.flatnonzero(whole > 255)).size:
                if over[0] == 0:
                    odd[j] = True
                    break
                whole[over - 1] += whole[over] >> 8
                whole[over] &= 255
            coder.out = bytearray((whole & 255).astype(np.uint8).tobytes())
        elif carry:
            odd[j] = True
        out[i] = coder
    back = np.empty(lanes, bool)
    back[order] = odd
    return out, back  # type: ignore[return-value]


class RangeLanes:
    """Range decoders of many lanes."""

    def __init__(self, data: list[bytes], starts: list[tuple[int, int, int, bool]], table: np.ndarray):
        sizes = np.array([len(d) for d in data], np.int64)
        # A zero after each lane's last byte, which is read again and again.
        self.bytes = np.frombuffer(b"".join(d + b"\0" for d in data), np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1
        self.end = first + sizes
        self.range, self.low = (np.array([s[i] for s in starts], np.int64) for i in (0, 1))
        self.at = first + np.array([s[2] for s in starts], np.int64)
        self.odd = np.array([s[3] for s in starts], bool) & (self.at < self.end)
        self.table = table

    def bit(self, lanes: np.ndarray, flat: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A decision of each of some lanes."""
        s = flat.take(place)
        span, low = self.range.take(lanes), self.low.take(lanes)
        top = span * s
        top >>= 8
        rest = span - top
        one = low >= rest
        low -= rest * one
        span = np.where(one, top, rest)
        flat[place] = self.table.take(s + one * 256)
        small = np.flatnonzero(span < 256)
        if len(small):
            who = lanes[small]
            at = self.at[who]
            span[small] <<= 8
            low[small] = (low[small] << 8) + self.bytes[at]
            self.at[who] = np.minimum(at + 1, self.end[who])
        self.range[lanes], self.low[lanes] = span, low
        return one

    def symbols(self, lanes: np.ndarray, flat: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A signed integer of each lane."""
        value = np.zeros(len(lanes), np.int64)
        some = np.flatnonzero(~self.bit(lanes, flat, place))
        if not len(some):
            return value
        e, active, i = np.zeros(len(lanes), np.int64), some, 0
        while len(active):
            active = active[self.bit(lanes[active], flat, place[active] + 1 + min(i, 9))]
            e[active] += 1
            i += 1
            if i > _MOST:
                self.odd[lanes[active]] = True
                e[active] = 0
                break
        value[some] = 1
        for r in range(int(e[some].max())):
            active = some[e[some] > r]
            i = e[active] - 1 - r
            value[active] = value[active] << 1 | self.bit(lanes[active], flat, place[active] + 22 + np.minimum(i, 9))
        minus = self.bit(lanes[some], flat, place[some] + 11 + np.minimum(e[some], 10))
        value[some[minus]] *= -1
        return value


# ---- Golomb-Rice ----


def _rice(states: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each context has seen (drift, error sum, bias, count), its parameter, and whether it turns values round."""
    held = states.take(place, axis=0)
    drift, errors, _, count = held.T
    return held, bit_length(np.maximum(-(-errors // count) - 1, 0)), 2 * drift < -count


def _learn(states: np.ndarray, place: np.ndarray, held: np.ndarray, seen: np.ndarray) -> None:
    drift, errors, bias, count = held.T
    errors, drift = errors + np.abs(seen), drift + seen
    full = (count == 128).astype(np.int64)
    count, drift, errors = (count >> full) + 1, drift >> full, errors >> full
    down, up = drift <= -count, drift > 0
    up &= ~down
    held[:, 0] = np.where(down, np.maximum(drift + count, 1 - count), np.where(up, np.minimum(drift - count, 0), drift))
    held[:, 1] = errors
    held[:, 2] = np.clip(bias + up - down, -128, 127)
    held[:, 3] = count
    states[place] = held


def _signed(v: np.ndarray, bits: int) -> np.ndarray:
    half = 1 << bits - 1
    return (v + half & (1 << bits) - 1) - half


class BitLanes:
    """Bits that many lanes write: codes of some lanes one after another, put together at the end."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.who: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def write(self, lanes: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        self.who.append(lanes)
        self.values.append(values)
        self.sizes.append(sizes)

    def done(self) -> list[bytes]:
        who, values, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.who, self.values, self.sizes))
        order = np.argsort(who, kind="stable")
        who, values, sizes = who[order], values[order], sizes[order]
        total = np.bincount(who, sizes, self.lanes).astype(np.int64)
        room = (total + 7) // 8
        begin = 8 * (np.cumsum(room) - room)
        at = np.cumsum(sizes) - sizes
        first = np.searchsorted(who, np.arange(self.lanes))
        at = at - np.append(at, 0)[np.minimum(first, len(at))][who] + begin[who] if len(who) else at
        bits = np.zeros(8 * int(room.sum()), np.uint8)
        for b in range(int(sizes.max(initial=0))):
            has = sizes > b
            bits[at[has] + sizes[has] - 1 - b] = values[has] >> b & 1
        data, ends = np.packbits(bits).tobytes(), np.cumsum(room).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _write_values(out: BitLanes, states: np.ndarray, lanes: np.ndarray, place: np.ndarray, value: np.ndarray, bits: int, odd: np.ndarray) -> None:
    held, k, turned = _rice(states, place)
    odd[lanes[k > 31]] = True
    k = np.minimum(k, 31)
    seen = _signed(value - held[:, 2], bits)
    v = np.where(turned, -1 - seen, seen)
    n = np.where(v >= 0, 2 * v, -2 * v - 1)
    short = n >> k < ESCAPE
    out.write(lanes, np.where(short, 1 << k | n & (1 << k) - 1, n - ESCAPE + 1), np.where(short, (n >> k) + 1 + k, ESCAPE + bits))
    _learn(states, place, held, seen)


def golomb_row(out: BitLanes, states: np.ndarray, base: np.ndarray, index: np.ndarray, contexts: np.ndarray, diffs: np.ndarray, bits: int, odd: np.ndarray) -> None:
    """One row of all lanes. base: where each lane's contexts begin; index: each lane's run index; contexts, diffs: lanes x width."""
    lanes, width = diffs.shape
    # The next place from each one on whose difference is not zero.
    last = np.where(diffs != 0, np.arange(width), width)
    last = np.minimum.accumulate(last[:, ::-1], axis=1)[:, ::-1]
    x = np.zeros(lanes, np.int64)
    active = np.arange(lanes)
    while len(active):
        here = contexts[active, x[active]]
        run = active[here == 0]
        value = diffs[active, x[active]]
        if len(run):
            stop = last[run, x[run]]
            length, room, left = stop - x[run], width - x[run], run
            while len(left):
                log2 = _LOG2_RUN[index[left]]
                short = length < 1 << log2
                out.write(left, np.where(short, length, 1), np.where(short, 1 + log2, 1))
                index[left[short]] = np.maximum(index[left[short]] - 1, 0)
                go = ~short
                length, room, left = (length - (1 << log2))[go], (room - (1 << log2))[go], left[go]
                too_far = index[left] + 1 >= len(LOG2_RUN)
                odd[left[too_far]] = True
                index[left[~too_far]] += 1
                more = (room > 0) & ~too_far
                length, room, left = length[more], room[more], left[more]
            x[run] = stop
            inside = x[active] < width
            at = np.minimum(x[active], width - 1)
            here, value = contexts[active, at], np.where(here == 0, diffs[active, at] - (diffs[active, at] > 0), value)
            here, value, active = here[inside], value[inside], active[inside]
        if len(active):
            _write_values(out, states, active, base[active] + here, value, bits, odd)
            x[active] += 1
            active = active[x[active] < width]
        active = np.flatnonzero(x < width)


class ReadLanes:
    """Bit readers of many lanes; a lane that reads over its end is odd."""

    def __init__(self, data: list[bytes], first_bit: np.ndarray):
        sizes = np.array([len(d) for d in data], np.int64)
        self.bytes = np.frombuffer(b"".join(d + bytes(8) for d in data), np.uint8).astype(np.int64)
        base = 8 * (np.cumsum(sizes + 8) - sizes - 8)
        self.at, self.stop = base + first_bit, base + 8 * sizes
        self.odd = np.zeros(len(data), bool)

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 40 bits, some of them from before."""
        at = self.at[lanes] >> 3
        b = self.bytes
        return b[at] << 32 | b[at + 1] << 24 | b[at + 2] << 16 | b[at + 3] << 8 | b[at + 4]

    def bits(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        got = self.peek(lanes) >> 40 - (self.at[lanes] & 7) - n & (1 << n) - 1
        self.skip(lanes, n)
        return got

    def skip(self, lanes: np.ndarray, n: np.ndarray) -> None:
        at = self.at[lanes] + n
        over = at > self.stop[lanes]
        if over.any():
            self.odd[lanes[over]] = True
            at = np.minimum(at, self.stop[lanes])
        self.at[lanes] = at

    def values(self, states: np.ndarray, lanes: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        held, k, turned = _rice(states, place)
        self.odd[lanes[k > 31]] = True
        k = np.minimum(k, 31)
        zeros = _ZEROS[self.peek(lanes) >> 40 - ESCAPE - (self.at[lanes] & 7) & (1 << ESCAPE) - 1]
        long = zeros == ESCAPE
        self.skip(lanes, zeros + ~long)
        rest = self.bits(lanes, np.where(long, bits, k))
        n = np.where(long, rest + ESCAPE - 1, zeros << k | rest)
        seen = np.where(n & 1, -(n >> 1) - 1, n >> 1)
        seen = np.where(turned, -1 - seen, seen)
        value = _signed(seen + held[:, 2], bits)
        _learn(states, place, held, seen)
        return value


class _GolombRow:
    """Differences of one row, sample by sample, of all lanes; index and pending go from row to row."""

    def __init__(self, source: ReadLanes, states: np.ndarray, base: np.ndarray, index: np.ndarray, pending: np.ndarray, bits: int, width: int):
        self.source, self.states, self.base, self.index, self.pending, self.bits, self.width = source, states, base, index, pending, bits, width
        self.left, self.broken = np.zeros(len(base), np.int64), np.zeros(len(base), bool)

    def _segments(self, lanes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the next segment in the row, and whether a sample that breaks the run follows."""
        size, broken = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), bool)
        late = self.pending[lanes] > 0
        size[late] = np.minimum(self.pending[lanes[late]], room[late])
        self.pending[lanes[late]] -= size[late]
        new = np.flatnonzero(~late)
        if len(new):
            who = lanes[new]
            log2 = _LOG2_RUN[self.index[who]]
            full = self.source.bits(who, np.ones(len(who), np.int64)) == 1
            fits = full & (1 << log2 <= room[new])
            too_far = fits & (self.index[who] + 1 >= len(LOG2_RUN))
            self.source.odd[who[too_far]] = True
            self.index[who[fits & ~too_far]] += 1
            size[new] = np.where(full, np.where(fits, 1 << log2, room[new]), 0)
            part = np.flatnonzero(~full)
            if len(part):
                n = self.source.bits(who[part], log2[part])
                self.index[who[part]] = np.maximum(self.index[who[part]] - 1, 0)
                over = n > room[new[part]]
                self.pending[who[part[over]]] = (n - room[new[part]])[over]
                size[new[part]] = np.minimum(n, room[new[part]])
                broken[new[part]] = ~over
        return size, broken

    def next(self, x: int, context: np.ndarray) -> np.ndarray:
        room = self.width - x
        idle = (self.left == 0) & ~self.broken
        late = np.flatnonzero(idle & (self.pending > 0))
        if len(late):
            self.left[late], self.broken[late] = self._segments(late, np.full(len(late), room))
            idle = (self.left == 0) & ~self.broken
        start = np.flatnonzero(idle & (context == 0))
        if len(start):
            run, broken, active = np.zeros(len(start), np.int64), np.zeros(len(start), bool), np.arange(len(start))
            while len(active):
                size, broke = self._segments(start[active], room - run[active])
                run[active] += size
                broken[active] = broke
                active = active[~broke & (run[active] < room) & ~self.source.odd[start[active]]]
            self.left[start], self.broken[start] = run, broken & (run < room)
        out = np.zeros(len(context), np.int64)
        running = self.left > 0
        self.left -= running
        read = np.flatnonzero(~running)
        if len(read):
            d = self.source.values(self.states, read, self.base[read] + context[read], self.bits)
            out[read] = d + (self.broken[read] & (d >= 0))
            self.broken[read] = False
        return out


# ---- slices ----


def encode_frames(c: StreamConfig, headers: list[Header], first: list[bool], chains: list[list[list[np.ndarray]]]) -> list[list[bytes] | None]:
    """Bytes of the slices of each chain: a keyframe and the frames after it, all of one shape and quant sets (those of headers[0]).
    first: whether the slice is its frame's first. None: a lane with a fault, for the serial coder."""
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    sets, bank, qset = banks_of(c, headers[0])
    begin = bank_starts(c, sets)
    states = _fresh(c, sets, len(order))
    out: list[list[bytes] | None] = [[] for _ in chains]
    for f in range(len(chains[order[0]])):
        now = [i for i in order if len(chains[i]) > f]
        planes = [np.stack([chains[i][f][p] for i in now]) for p in range(c.planes)]
        odd = np.zeros(len(now), bool)
        for p in planes:
            odd |= p.reshape(len(now), -1).max(1, initial=0) >> c.bits > 0
        coded = coded_planes(c, planes)
        parts = [residuals(c, s, bits, c.quant_sets[qset[p]]) for p, (s, bits) in enumerate(coded)]
        rows = row_order(c, [s.shape[1] for s, _ in coded])
        said: dict[tuple[Header, bool], RangeEncoder] = {}
        for i in now:
            if (headers[i], first[i]) not in said:
                w = said[headers[i], first[i]] = RangeEncoder(c.transitions)
                if first[i]:
                    w.bit(bytearray([KEYFRAME_START]), 0, int(f == 0))
                write_header(w, c, headers[i])
        starts = [said[headers[i], first[i]] for i in now]
        if c.entropy == GOLOMB:
            data = _golomb_frame(c, parts, [bits for _, bits in coded], rows, bank, begin, states, odd)
            done = [w.lower_bound() + d for w, d in zip(starts, data, strict=True)]
        else:
            place = np.concatenate([parts[p][0][:, y] + begin[bank[p]] for p, y in rows], axis=1) * 32
            value = np.concatenate([parts[p][1][:, y] for p, y in rows], axis=1)
            coders, bad = range_encode(states[: len(now)], _transitions(c), place, value, starts)
            odd |= bad
            done = [b"" if o else w.closed() for w, o in zip(coders, odd.tolist(), strict=True)]
        for i, d, o in zip(now, done, odd.tolist(), strict=True):
            if o or out[i] is None or len(d) > 0xFFFFFF:
                out[i] = None
            else:
                out[i].append(with_footer(c, d))  # type: ignore[union-attr]
    return out


def _golomb_frame(c, parts, bits, rows, bank, begin, states, odd) -> list[bytes]:
    lanes = len(odd)
    out, flat = BitLanes(lanes), states.reshape(-1, 4)
    index = [np.zeros(lanes, np.int64) for _ in parts]
    base = np.arange(lanes) * states.shape[1]
    for p, y in rows:
        golomb_row(out, flat, base + begin[bank[p]], index[0 if c.colorspace == RGB else p], parts[p][0][:, y], parts[p][1][:, y], bits[p], odd)
    return out.done()


def decode_frames(c: StreamConfig, chains: list[list[Slice]]) -> list[list[list[np.ndarray]] | None]:
    """Planes of the slices of each chain, all of one layout's shape and quant sets. None: a lane with a fault, or with content
    that needs another start than the first, for the serial coder."""
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    head = chains[order[0]][0]
    sets, bank, qset = banks_of(c, head.header)
    begin = bank_starts(c, sets)
    extents = [c.cell(p, *head.layout) for p in range(c.planes)]
    widths, heights = [e[2] for e in extents], [e[3] for e in extents]
    bits = [c.bits + (c.colorspace == RGB and (p < 3 or c.entropy == GOLOMB)) for p in range(c.planes)]
    states, bad = _fresh(c, sets, len(order)), np.zeros(len(chains), bool)
    out: list[list[list[np.ndarray]] | None] = [[] for _ in chains]
    for f in range(len(chains[order[0]])):
        now = np.array([i for i in order if len(chains[i]) > f])
        slices = [chains[i][f] for i in now]
        lanes = len(now)
        if c.entropy == GOLOMB:
            data = [s.payload[s.content - s.offset : s.footer - s.offset] for s in slices]
            source = ReadLanes(data, np.array([s.content_bit for s in slices], np.int64))
            source.odd |= np.array([not d for d in data])
            flat, step = states.reshape(-1, 4), states.shape[1]
        else:
            source = RangeLanes([s.payload[: s.footer - s.offset] for s in slices], [s.arithmetic for s in slices], _transitions(c))
            flat, step = states.reshape(-1), states.shape[1]
        everyone = np.arange(lanes)
        done = [np.zeros((lanes, h, w), np.int64) for w, h in zip(widths, heights, strict=True)]
        index, pending = ([np.zeros(lanes, np.int64) for _ in widths] for _ in range(2))
        last = -1
        for p, y in row_order(c, heights):
            if p != last and c.colorspace == YCBCR and last >= 0:
                pending[last][:] = 0
            last = p
            if not widths[p]:
                continue
            q, r = c.quant_sets[qset[p]], 0 if c.colorspace == RGB else p
            if c.entropy == GOLOMB:
                row = _GolombRow(source, flat, everyone * step + begin[bank[p]], index[r], pending[r], bits[p], widths[p])
                read = row.next
            else:
                base = everyone * step + 32 * begin[bank[p]]
                read = lambda x, k, base=base: source.symbols(everyone, flat, base + 32 * k)
            _decode_row(read, q, done[p], y, bits[p], c.signed_prediction, source.odd)
        if c.entropy == GOLOMB:
            source.odd |= (source.at + 7) // 8 * 8 != source.stop
        bad[now] |= source.odd
        planes = plain_planes(c, done)
        for n, i in enumerate(now.tolist()):
            if bad[i]:
                out[i] = None
            elif out[i] is not None:
                out[i].append([a[n] for a in planes])  # type: ignore[union-attr]
    return out


def _decode_row(read, q, plane: np.ndarray, y: int, bits: int, signed: bool, odd: np.ndarray) -> None:
    """Row y of all lanes' planes (lanes x height x width)."""
    lanes, _, width = plane.shape
    none = np.zeros((lanes, width), np.int64)
    row, up, upper = plane[:, y], plane[:, y - 1] if y else none, plane[:, y - 2] if y > 1 else none
    t0, t1, t2, t3, t4 = (np.array(t, np.int64) for t in q.tables)
    mask = (1 << bits) - 1
    left, corner, far = up[:, 0], upper[:, 0], none[:, 0]
    for x in range(width):
        top = up[:, x]
        right = up[:, min(x + 1, width - 1)]
        a, b, d = (np.where(v >= 32768, v - 65536, v) for v in (left, top, corner)) if signed else (left, top, corner)
        guess = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), a + b - d))
        k = t0[left - corner & 255] + t1[corner - top & 255] + t2[top - right & 255] + t3[far - left & 255] + t4[upper[:, x] - top & 255]
        size = np.abs(k)
        over = size >= q.contexts
        if over.any():
            odd |= over
            size = np.where(over, 0, size)
        diff = read(x, size)
        v = guess + np.where(k < 0, -diff, diff) & mask
        row[:, x] = v
        far, left, corner = left, v, top
