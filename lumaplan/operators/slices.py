"""Slices: header, footer, location, coverage, and the samples inside."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from lumaplan.operators.bits import BitWriter, WindowedBitReader, crc32_msb
from lumaplan.operators.errors import CRC_MISMATCH, EXHAUSTED, INVALID_ARGUMENT, INVALID_STATE, SYNTAX, CodecError
from lumaplan.operators.golomb import Adaptive, Runs
from lumaplan.operators.range_coder import OldRangeDecoder, RangeDecoder, RangeEncoder, fresh_states
from lumaplan.operators.stream import CIF, GOLOMB, RANGE, RGB, YCBCR, StreamConfig

KEYFRAME_START = 128


@dataclass(frozen=True)
class Header:
    """Rectangle in grid cells, quant set of each slot, picture structure, sample aspect ratio."""

    x: int
    y: int
    w: int
    h: int
    sets: tuple[int, ...]
    picture: int = 0
    sar: tuple[int, int] = (0, 0)


@dataclass(frozen=True)
class Slice:
    """Where a slice lies in its frame, and its header. Offsets count from the frame's first byte."""

    index: int
    payload: bytes
    offset: int
    content: int
    footer: int
    size: int
    header: Header
    error_status: int = 0
    crc: int | None = None
    #: Range coder after header (and embedded parameters), for content that goes on with it.
    arithmetic: tuple | None = field(default=None, compare=False)
    content_bit: int = 0
    #: The content, where it goes on with a coder's state, is in the arithmetic of the oldest streams.
    old: bool = False
    #: State transitions that a legacy keyframe brings along, where they are not the stream's; they hold up to the next keyframe.
    transitions: bytes | None = None

    @property
    def layout(self) -> tuple[int, int, int, int]:
        return self.header.x, self.header.y, self.header.w, self.header.h


def write_header(w: RangeEncoder, c: StreamConfig, h: Header) -> None:
    (s,) = fresh_states(1)
    for v in (h.x, h.y, h.w - 1, h.h - 1, *h.sets, h.picture, *h.sar):
        w.symbol(s, v, False)


def read_header(r: RangeDecoder, c: StreamConfig) -> Header:
    (s,) = fresh_states(1)
    x, y, w, h = (r.symbol(s, False) for _ in range(4))
    w, h = w + 1, h + 1
    if x + w > c.num_h or y + h > c.num_v:
        raise CodecError(SYNTAX, "the slice leaves the grid", r.at)
    sets = tuple(r.symbol(s, False) for _ in range(c.slots))
    if max(sets) >= len(c.quant_sets):
        raise CodecError(SYNTAX, "the slice names a quant set that is not there", r.at)
    picture, a, b = (r.symbol(s, False) for _ in range(3))
    if picture > 3:
        raise CodecError(SYNTAX, f"picture structure {picture}", r.at)
    return Header(x, y, w, h, sets, picture, (a, b) if a and b else (0, 0))


def footer_size(c: StreamConfig) -> int:
    return 8 if c.ec else 3


def with_footer(c: StreamConfig, data: bytes, error_status: int = 0) -> bytes:
    """The size counts the bytes before the footer; the CRC covers all before it."""
    if len(data) > 0xFFFFFF:
        raise CodecError(EXHAUSTED, "a slice has at most 2**24 - 1 bytes")
    data += len(data).to_bytes(3, "big")
    if c.ec:
        data += bytes([error_status])
        data += crc32_msb(data).to_bytes(4, "big")
    return data


def locate(c: StreamConfig, frame: bytes, verify_crc: bool = True) -> list[tuple[int, int, int, int | None]]:
    """offset, size before the footer, error status and CRC of each slice, first to last; read from the end by the footers."""
    found, end, n = [], len(frame), footer_size(c)
    broken: tuple[int, int] | None = None
    while end > 0:
        if end < n:
            raise CodecError(SYNTAX, "a slice footer is cut off", end)
        foot = end - n
        size = int.from_bytes(frame[foot : foot + 3], "big")
        start = foot - size
        if start < 0:
            raise CodecError(SYNTAX, "a slice is larger than what is left of the frame", foot)
        status, crc = (frame[foot + 3], int.from_bytes(frame[foot + 4 : end], "big")) if c.ec else (0, None)
        if status > 2:
            raise CodecError(SYNTAX, f"error status {status} is reserved", foot + 3)
        if c.ec and verify_crc and broken is None and crc32_msb(frame[start:end]):
            broken = start, len(found)
        found.append((start, size, status, crc))
        if len(found) > c.num_h * c.num_v:
            raise CodecError(SYNTAX, "there are more slices than cells", start)
        end = start
    if broken:
        raise CodecError(CRC_MISMATCH, "a slice's CRC does not hold", broken[0], slice_index=len(found) - 1 - broken[1])
    return found[::-1]


def check_coverage(c: StreamConfig, slices: list[Slice]) -> None:
    """Slices cover each grid cell once; over 352x288 no slice of version 3 has more than a quarter of the cells."""
    cells = c.num_h * c.num_v
    for s in slices:
        if c.version >= 3 and c.width * c.height > CIF and s.header.w * s.header.h > cells // 4:
            raise CodecError(SYNTAX, "a slice is larger than a quarter of the frame", s.offset, slice_index=s.index)
    if sum(s.header.w * s.header.h for s in slices) < cells:
        raise CodecError(SYNTAX, "slices leave cells of the frame open")
    # Columns of open rectangles along x; of each column only its row range is held.
    events = sorted([(s.header.x + s.header.w, 0, i) for i, s in enumerate(slices)] + [(s.header.x, 1, i) for i, s in enumerate(slices)])
    import bisect

    rows: list[tuple[int, int]] = []
    for _, opens, i in events:
        span = slices[i].header.y, slices[i].header.y + slices[i].header.h
        at = bisect.bisect_left(rows, span)
        if not opens:
            rows.pop(at)
            continue
        if at and rows[at - 1][1] > span[0] or at < len(rows) and rows[at][0] < span[1]:
            raise CodecError(SYNTAX, "slices overlap", slices[i].offset, slice_index=slices[i].index)
        rows.insert(at, span)


class Entropy:
    """What a slice hands to the same slice of the next frame: states of the range coder or Golomb-Rice contexts, by bank, and state
    transitions that are not the stream's (None: the stream's)."""

    def __init__(self, banks: list[list], transitions: bytes | None = None):
        self.banks, self.transitions = banks, transitions

    @classmethod
    def fresh(cls, c: StreamConfig, sets: tuple[int, ...]) -> Entropy:
        if c.entropy == GOLOMB:
            return cls([[Adaptive() for _ in range(c.quant_sets[i].contexts)] for i in sets])
        first = c.initial or (None,) * len(c.quant_sets)
        return cls([fresh_states(c.quant_sets[i].contexts) if first[i] is None else [bytearray(r) for r in first[i]] for i in sets])

    def copy(self) -> Entropy:
        return Entropy([[replace(x) if isinstance(x, Adaptive) else bytearray(x) for x in b] for b in self.banks], self.transitions)

    def fits(self, c: StreamConfig, sets: tuple[int, ...]) -> bool:
        return [len(b) for b in self.banks] == [c.quant_sets[i].contexts for i in sets]


def banks_of(c: StreamConfig, header: Header) -> tuple[tuple[int, ...], list[int], list[int]]:
    """Quant set of each bank, and bank and quant set of each plane. From version 3 on a bank is a slot; before, range coders
    have one for each plane (the third RGB plane uses the second's) and Golomb-Rice coders one in all."""
    if c.version >= 3:
        slots = [c.slot(p) for p in range(c.planes)]
        return header.sets, slots, [header.sets[s] for s in slots]
    if c.entropy == GOLOMB:
        return (0,), [0] * c.planes, [0] * c.planes
    return (0,) * c.planes, [1 if c.colorspace == RGB and p == 2 else p for p in range(c.planes)], [0] * c.planes


def coded_planes(c: StreamConfig, planes: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
    """Samples as they are coded, and their bits: RGB goes through the reversible colour transform."""
    planes = [p.astype(np.int64) for p in planes]
    if c.colorspace == YCBCR:
        return [(p, c.bits) for p in planes]
    r, g, b = planes[:3]
    base, u, v = (b, g - b, r - b) if 9 <= c.bits <= 15 and not c.extra else (g, b - g, r - g)
    y = base + (u + v >> 2) & (2 << c.bits) - 1
    out = [(y, c.bits + 1), (u + (1 << c.bits), c.bits + 1), (v + (1 << c.bits), c.bits + 1)]
    return out + [(a, c.bits + (c.entropy == GOLOMB)) for a in planes[3:]]


def plain_planes(c: StreamConfig, coded: list[np.ndarray]) -> list[np.ndarray]:
    """The inverse of coded_planes()."""
    mask = (1 << c.bits) - 1
    if c.colorspace == YCBCR:
        return coded
    y, u, v = coded[0], coded[1] - (1 << c.bits), coded[2] - (1 << c.bits)
    base = y - (u + v >> 2)
    if 9 <= c.bits <= 15 and not c.extra:
        r, g, b = v + base, u + base, base
    else:
        r, g, b = v + base, base, u + base
    return [r & mask, g & mask, b & mask, *(a & mask for a in coded[3:])]


def neighbours(s: np.ndarray, edge: int = 0) -> dict[str, np.ndarray]:
    """The six causal neighbours of every sample of a plane, or of a stack of planes; the border is edge, a row's left border is the sample above its first, and the
    last column's top right is its top."""
    h, w = s.shape[-2:]
    wide = np.full((*s.shape[:-2], h + 2, w + 3), edge, s.dtype)
    wide[..., 2:, 2 : w + 2] = s
    wide[..., w + 2] = wide[..., w + 1]
    wide[..., 1:, 1] = wide[..., :-1, 2]
    row = wide[..., 2:, :]
    up, upper = wide[..., 1:-1, :], wide[..., :-2, :]
    far = row[..., :w].copy()
    far[..., 0] = edge
    return {"left": row[..., 1 : w + 1], "top": up[..., 2 : w + 2], "top_left": up[..., 1 : w + 1], "top_right": up[..., 3 : w + 3], "far_left": far, "top_top": upper[..., 2 : w + 2]}


def median(a, b, c):
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def wrap(d, bits: int):
    half = 1 << bits - 1
    return (d + half & (1 << bits) - 1) - half


def residuals(c: StreamConfig, s: np.ndarray, bits: int, q, edge: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Context number and difference of every sample; a negative context number turns both round."""
    n = neighbours(s, edge)
    left, top, corner = n["left"], n["top"], n["top_left"]
    if c.signed_prediction:
        a, b, d = (np.where(x >= 32768, x - 65536, x) for x in (left, top, corner))
        guess = median(a, b, a + b - d)
    else:
        guess = median(left, top, left + top - corner)
    gradients = (left - corner, corner - top, top - n["top_right"], n["far_left"] - left, n["top_top"] - top)
    context = np.zeros(s.shape, np.int64)
    for g, t in zip(gradients, q.tables, strict=True):
        context += np.array(t, np.int64)[g & 255]
    diff = wrap(s - guess, bits)
    diff = np.where(context < 0, -diff, diff)
    context = np.abs(context)
    if context.max(initial=0) >= q.contexts:
        raise CodecError(SYNTAX, "a context number is out of range")
    return context, diff


def row_order(c: StreamConfig, heights: list[int]) -> list[tuple[int, int]]:
    """(plane, row) in order of coding."""
    interleaved = c.colorspace == RGB or c.version <= 1 and c.entropy == RANGE and c.chroma and not c.log2_h and not c.log2_v
    pairs = [(p, y) for p, h in enumerate(heights) for y in range(h)]
    return sorted(pairs, key=lambda v: (v[1], v[0])) if interleaved else pairs


def encode_slice(c: StreamConfig, planes: list[np.ndarray], header: Header, keyframe: bool | None, state: Entropy | None) -> tuple[bytes, Entropy]:
    """Bytes of a slice with its footer, and the state for the next frame. planes: the slice's own samples. keyframe: given for a
    frame's first slice only. state None: fresh."""
    for p in planes:
        if p.size and int(p.max()) >> c.bits:
            raise CodecError(INVALID_ARGUMENT, f"a sample has more than {c.bits} bits")
    w = RangeEncoder(c.transitions)
    if keyframe is not None:
        w.bit(bytearray([KEYFRAME_START]), 0, int(keyframe))
    write_header(w, c, header)
    sets, bank, qset = banks_of(c, header)
    state = Entropy.fresh(c, sets) if state is None else state.copy()
    if not state.fits(c, sets):
        raise CodecError(INVALID_STATE, "the state is of another layout")
    coded = coded_planes(c, planes)
    parts = [(*residuals(c, s, bits, c.quant_sets[qset[p]]), bits) for p, (s, bits) in enumerate(coded)]
    order = row_order(c, [s.shape[0] for s, _ in coded])
    if c.entropy == RANGE:
        for p, y in order:
            states, symbol = state.banks[bank[p]], w.symbol
            for k, d in zip(parts[p][0][y].tolist(), parts[p][1][y].tolist(), strict=True):
                symbol(states[k], d, True)
        return with_footer(c, w.closed()), state
    out, runs = BitWriter(), [Runs() for _ in coded]
    for p, y in order:
        _golomb_row(out, runs[0 if c.colorspace == RGB else p], state.banks[bank[p]], parts[p][0][y].tolist(), parts[p][1][y].tolist(), parts[p][2])
    return with_footer(c, w.lower_bound() + out.finish()), state


def _golomb_row(out: BitWriter, runs: Runs, states: list[Adaptive], contexts: list[int], diffs: list[int], bits: int) -> None:
    x, n = 0, len(diffs)
    while x < n:
        if contexts[x]:
            states[contexts[x]].write(out, bits, diffs[x])
            x += 1
            continue
        start = x
        while x < n and not diffs[x]:
            x += 1
        runs.write(out, n - start, x - start)
        if x < n:
            states[contexts[x]].write(out, bits, diffs[x] - (diffs[x] > 0))
            x += 1


def border(c: StreamConfig, plane: int) -> int:
    """What lies outside a slice: 0, but half of the range for chroma of legacy range coded streams of up to 8 bits."""
    return 1 << c.bits - 1 if c.version <= 1 and c.entropy == RANGE and c.colorspace == YCBCR and c.is_chroma(plane) and c.bits <= 8 else 0


def _decode_row(reader, q, row: list[int], up: list[int], upper: list[int], edge: int, bits: int, signed: bool) -> None:
    """Fills row. up and upper hold the two rows before. reader(context, invert, guess) gives a sample's difference; for runs it
    may answer None for 'as predicted'."""
    n, tables, mask, contexts = len(row), q.tables, (1 << bits) - 1, q.contexts
    t0, t1, t2, t3, t4 = tables
    plain = contexts == 1 and not any(map(any, tables))
    left, corner, far = up[0], upper[0], edge
    for x in range(n):
        top = up[x]
        if signed:
            a, b, d = (v - 65536 if v >= 32768 else v for v in (left, top, corner))
        else:
            a, b, d = left, top, corner
        e = a + b - d
        guess = max(min(a, b), min(max(a, b), e))
        if plain:
            k = 0
        else:
            right = up[x + 1] if x + 1 < n else top
            k = t0[left - corner & 255] + t1[corner - top & 255] + t2[top - right & 255] + t3[far - left & 255] + t4[upper[x] - top & 255]
        diff = reader(x, n, abs(k))
        v = guess + (-diff if k < 0 else diff) & mask
        row[x] = v
        # The second sample's far left is the row's left border, the sample above its first.
        far, left, corner = left, v, top
        if abs(k) >= contexts:
            raise CodecError(SYNTAX, "a context number is out of range")


class _Range:
    def __init__(self, r: RangeDecoder):
        self.r = r

    def row(self, states: list[bytearray], bits: int, runs: Runs | None):
        symbol, n = self.r.symbol, len(states)

        def read(x: int, width: int, k: int) -> int:
            if k >= n:
                raise CodecError(SYNTAX, "a context number is out of range")
            return symbol(states[k], True)

        return read


class _Golomb:
    def __init__(self, b: WindowedBitReader):
        self.b = b

    def row(self, states: list[Adaptive], bits: int, runs: Runs):
        b = self.b
        left, broken = 0, False

        def read(x: int, width: int, k: int) -> int:
            nonlocal left, broken
            if not left and not broken and runs.pending:
                left, broken = runs.read(b, width - x)
            if not left and not broken and k == 0:
                while not broken and not left:
                    left, broken = runs.read(b, width - x)
                    run = left
                    # Whole runs follow one another until a sample breaks them or the row ends.
                    while not broken and run < width - x:
                        more, broken = runs.read(b, width - x - run)
                        run += more
                    left = run
                    if run >= width - x:
                        broken = False
            if left:
                left -= 1
                return 0
            if broken:
                broken = False
                if k >= len(states):
                    raise CodecError(SYNTAX, "a context number is out of range")
                d = states[k].read(b, bits)
                return d + (d >= 0)
            if k >= len(states):
                raise CodecError(SYNTAX, "a context number is out of range")
            return states[k].read(b, bits)

        return read


def _observed(read, source, plane: int, y: int, bank: int, states: list, runs: Runs, observe: list):
    """read() that writes down each sample: plane, y, x, context, difference, the coder's place before and after, bank, and for
    Golomb-Rice the parameter, what the context has seen before and after, and the run's index and rest before and after."""
    rice = isinstance(source, _Golomb)
    place = (lambda: source.b.at) if rice else (lambda: source.r.at)
    seen = lambda k: (states[k].drift, states[k].error_sum, states[k].bias, states[k].count)

    def reader(x: int, width: int, k: int) -> int:
        before, known = place(), rice and k < len(states)
        held = (states[k].k(), *seen(k), runs.index, runs.pending) if known else (None,) * 7
        d = read(x, width, k)
        observe.append((plane, y, x, k, d, before, place(), bank, *held, *((*seen(k), runs.index, runs.pending) if known else (None,) * 6)))
        return d

    return reader


def decode_slice(c: StreamConfig, s: Slice, state: Entropy | None, content: int | None = None, trailing: bool = False, observe: list | None = None) -> tuple[list[np.ndarray], Entropy]:
    """The slice's planes and the state for the next frame. content: another start of Golomb-Rice content than s has. trailing:
    bytes may follow the content. observe: gets what _observed() writes down of each sample; places are bits for Golomb-Rice, bytes
    for range coding."""
    sets, bank, qset = banks_of(c, s.header)
    state = Entropy.fresh(c, sets) if state is None else state.copy()
    if not state.fits(c, sets):
        raise CodecError(INVALID_STATE, "the state is of another layout")
    state.transitions = s.transitions or state.transitions
    if c.entropy == RANGE:
        own = s.arithmetic is None
        old = s.old and not own
        r = (OldRangeDecoder if old else RangeDecoder)(s.payload[s.content - s.offset if own else 0 : s.footer - s.offset], state.transitions or c.transitions)
        if not own:
            r.resume(s.arithmetic)
        if old:
            for b in state.banks:
                for x in b:
                    x[0] = 255
        r.zero_symbol_carry = c.version <= 1 and c.colorspace == YCBCR
        source = _Range(r)
    else:
        begin = (s.content if content is None else content) - s.offset
        data = s.payload[begin : s.footer - s.offset]
        if not data:
            raise CodecError(SYNTAX, "the slice has no content", s.content)
        source = _Golomb(WindowedBitReader(data, s.content_bit))
    extents = [c.cell(p, *s.layout) for p in range(c.planes)]
    widths, heights = [e[2] for e in extents], [e[3] for e in extents]
    bits = [c.bits + (c.colorspace == RGB and (p < 3 or c.entropy == GOLOMB)) for p in range(c.planes)]
    done = [np.zeros((h, w), np.int64) for w, h in zip(widths, heights, strict=True)]
    lines = [([border(c, p)] * widths[p], [border(c, p)] * widths[p]) for p in range(c.planes)]
    runs, last = [Runs() for _ in widths], -1
    for p, y in row_order(c, heights):
        if p != last and c.colorspace == YCBCR and c.entropy == GOLOMB and last >= 0:
            runs[last].pending = 0
        last = p
        if not widths[p]:
            continue
        up, upper = lines[p]
        row = [0] * widths[p]
        edge = border(c, p)
        run = runs[0 if c.colorspace == RGB else p]
        read = source.row(state.banks[bank[p]], bits[p], run)
        if observe is not None:
            read = _observed(read, source, p, y, bank[p], state.banks[bank[p]], run, observe)
        _decode_row(read, c.quant_sets[qset[p]], row, up if y else [edge] * widths[p], upper, edge, bits[p], c.signed_prediction)
        done[p][y] = row
        lines[p] = row, up
    if isinstance(source, _Golomb):
        source.b.align()
        if source.b.left and not trailing:
            raise CodecError(SYNTAX, "bytes follow the slice's content", s.footer - source.b.left // 8)
    return plain_planes(c, done), state
