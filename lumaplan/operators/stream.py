"""Stream configurations: geometry, limits, and the configuration record."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from lumaplan.operators.bits import crc32_msb
from lumaplan.operators.errors import CRC_MISMATCH, INVALID_ARGUMENT, SYNTAX, UNSUPPORTED, CodecError
from lumaplan.operators.range_coder import DEFAULT_TRANSITIONS, START, RangeDecoder, RangeEncoder, fresh_states

RANGE, GOLOMB = "range", "golomb"
YCBCR, RGB = 0, 1
MOST_SETS, MOST_CONTEXTS, CIF = 8, 32768, 352 * 288


@dataclass(frozen=True)
class QuantSet:
    """Five tables from an 8-bit gradient to a share of the context number."""

    tables: tuple[tuple[int, ...], ...] = ((0,) * 256,) * 5
    contexts: int = 1


@dataclass(frozen=True)
class StreamConfig:
    width: int
    height: int
    bits: int = 8
    colorspace: int = YCBCR
    chroma: bool = False
    extra: bool = False
    log2_h: int = 0
    log2_v: int = 0
    num_h: int = 1
    num_v: int = 1
    entropy: str = RANGE
    ec: bool = False
    intra: bool = True
    version: int = 3
    micro: int = 4
    quant_sets: tuple[QuantSet, ...] = (QuantSet(),)
    #: For each quant set the first states of its contexts, or None.
    initial: tuple[tuple[bytes, ...] | None, ...] = ()
    transitions: bytes = field(default=DEFAULT_TRANSITIONS)

    @property
    def planes(self) -> int:
        return 1 + 2 * self.chroma + self.extra

    @property
    def slots(self) -> int:
        return 1 + (self.chroma or self.version <= 3) + self.extra

    @property
    def sample_bytes(self) -> int:
        return 1 if self.bits <= 8 else 2

    @property
    def signed_prediction(self) -> bool:
        return self.colorspace == YCBCR and self.bits == 16 and self.entropy == RANGE

    def is_chroma(self, plane: int) -> bool:
        return self.chroma and plane in (1, 2)

    def slot(self, plane: int) -> int:
        if plane == 0:
            return 0
        if self.is_chroma(plane):
            return 1
        return 2 if self.version <= 3 or self.chroma else 1

    def role(self, plane: int) -> str:
        names = ("R", "G", "B") if self.colorspace == RGB else ("Y", "Cb", "Cr") if self.chroma else ("Y",)
        return names[plane] if plane < len(names) else "Alpha"

    def plane_size(self, plane: int) -> tuple[int, int]:
        if self.colorspace == YCBCR and self.is_chroma(plane):
            return subsampled(self.width, self.log2_h), subsampled(self.height, self.log2_v)
        return self.width, self.height

    def cell(self, plane: int, x: int, y: int, w: int, h: int) -> tuple[int, int, int, int]:
        """x, y, width, height in samples of the raster rectangle (x, y, w, h)."""
        pw, ph = self.plane_size(plane)
        x0, y0 = grid(x, pw, self.num_h), grid(y, ph, self.num_v)
        return x0, y0, grid(x + w, pw, self.num_h) - x0, grid(y + h, ph, self.num_v) - y0


def subsampled(extent: int, shift: int) -> int:
    return -(-extent >> shift) if shift < 32 else int(extent > 0)


def grid(position: int, extent: int, cells: int) -> int:
    return position * extent // cells


def encoder_profile(c: StreamConfig, keyframe_interval: int = 1) -> StreamConfig:
    """c as the public encoder takes it: version 3.4, one zero quant set, intra if every frame is a keyframe. Raises on what it does not take."""
    no = lambda code, message: CodecError(code, message)
    if keyframe_interval < 1:
        raise no(INVALID_ARGUMENT, "the keyframe interval is at least 1")
    if c.width < 1 or c.height < 1:
        raise no(INVALID_ARGUMENT, "the frame has no extent")
    if c.version != 3:
        raise no(UNSUPPORTED, "only version 3 is written")
    if c.entropy not in (RANGE, GOLOMB):
        raise no(UNSUPPORTED, f"entropy coder {c.entropy}")
    if not 1 <= c.bits <= 16:
        raise no(UNSUPPORTED, "samples have 1 to 16 bits")
    if c.colorspace not in (YCBCR, RGB):
        raise no(UNSUPPORTED, "the colour space is unknown")
    if c.colorspace == RGB and (not c.chroma or c.log2_h or c.log2_v):
        raise no(INVALID_ARGUMENT, "RGB has three planes of full size")
    if not c.chroma and (c.log2_h or c.log2_v):
        raise no(INVALID_ARGUMENT, "subsampling needs chroma planes")
    if (c.log2_h, c.log2_v) not in ((0, 0), (1, 0), (1, 1)):
        raise no(UNSUPPORTED, "chroma is 4:4:4, 4:2:2 or 4:2:0")
    if c.num_h < 1 or c.num_v < 1:
        raise no(INVALID_ARGUMENT, "the slice grid is empty")
    if c.width * c.height > CIF and c.num_h * c.num_v < 4:
        raise no(INVALID_ARGUMENT, "frames over 352x288 have four slices at least")
    if any(c.num_h > w or c.num_v > h for w, h in map(c.plane_size, range(c.planes))):
        raise no(INVALID_ARGUMENT, "a slice would hold no sample of some plane")
    return replace(c, micro=4, quant_sets=(QuantSet(),), initial=(None,), transitions=DEFAULT_TRANSITIONS, intra=keyframe_interval == 1)


def expand_runs(runs: list[int], scale: int) -> tuple[int, ...]:
    """Run lengths over 0..127 as a table: run i holds scale*i; the upper half mirrors it with the opposite sign."""
    half = [scale * i for i, n in enumerate(runs) for _ in range(n)][:128]
    if len(half) != 128 or max(half) > 2**31 - 1:
        raise CodecError(SYNTAX, "runs of a quant table don't make 128 entries of 32 bits")
    return (*half, -half[127], *(-v for v in half[:0:-1]))


def quant_set(*runs: list[int]) -> QuantSet:
    """A set from five lists of run lengths that sum to 128 each."""
    scale, tables = 1, []
    for r in runs:
        tables.append(expand_runs(r, scale))
        scale *= 2 * len(r) - 1
    contexts = (scale + 1) // 2
    if not 0 < contexts <= MOST_CONTEXTS:
        raise CodecError(SYNTAX, f"{contexts} contexts are out of range")
    return QuantSet(tuple(tables), contexts)


def _runs_of(table: tuple[int, ...]) -> list[int]:
    runs, last = [], None
    for v in table[:128]:
        if v != last:
            runs.append(0)
            last = v
        runs[-1] += 1
    return runs


def write_parameters(c: StreamConfig, w: RangeEncoder, states: list[bytearray], spelled: bool = False) -> None:
    """All parameters of c; states: 32 contexts, of which all but initial states use the first. spelled: state transitions are given
    even if they are the default ones."""
    s = states[0]
    u = lambda v: w.symbol(s, v, False)
    u(c.version)
    if c.version >= 3:
        u(c.micro)
    custom = spelled or c.transitions != DEFAULT_TRANSITIONS
    u(0 if c.entropy == GOLOMB else 2 if custom else 1)
    if c.entropy == RANGE and custom:
        for a, b in zip(c.transitions[1:], DEFAULT_TRANSITIONS[1:], strict=True):
            w.symbol(s, a - b, True)
    u(c.colorspace)
    if c.version >= 1:
        u(c.bits)
    w.bit(s, 0, int(c.chroma))
    u(c.log2_h)
    u(c.log2_v)
    w.bit(s, 0, int(c.extra))
    if c.version >= 3:
        u(c.num_h - 1)
        u(c.num_v - 1)
        u(len(c.quant_sets))
    for q in c.quant_sets:
        if quant_set(*map(_runs_of, q.tables)) != q:
            raise CodecError(INVALID_ARGUMENT, "a quant table is no mirrored table of runs")
        for t in q.tables:
            (own,) = fresh_states(1)
            for n in _runs_of(t):
                w.symbol(own, n - 1, False)
    if c.version >= 3:
        for q, first in zip(c.quant_sets, c.initial or (None,) * len(c.quant_sets), strict=True):
            w.bit(s, 0, int(first is not None))
            if first is not None:
                if len(first) != q.contexts:
                    raise CodecError(INVALID_ARGUMENT, "initial states don't match the contexts")
                before = bytes([START] * 32)
                for row in first:
                    for i, (a, b) in enumerate(zip(row, before, strict=True)):
                        w.symbol(states[i], (a - b + 128 & 255) - 128, True)
                    before = row
        u(int(c.ec))
        u(int(c.intra))


def write_record(c: StreamConfig) -> bytes:
    if (c.version, c.micro) != (3, 4):
        raise CodecError(UNSUPPORTED, "records are written for version 3.4")
    w = RangeEncoder()
    write_parameters(c, w, fresh_states(32))
    data = w.closed()
    return data + crc32_msb(data).to_bytes(4, "big")


def _table(r: RangeDecoder, scale: int) -> tuple[tuple[int, ...], int]:
    (own,) = fresh_states(1)
    runs, k = [], 0
    while k < 128:
        n = r.symbol(own, False) + 1
        if n > 128 - k and k == 0:
            raise CodecError(SYNTAX, "a run leaves the quant table", r.at)
        runs.append(min(n, 128 - k))
        k += runs[-1]
    return expand_runs(runs, scale), len(runs)


def read_parameters(r: RangeDecoder, states: list[bytearray], width: int = 0, height: int = 0) -> StreamConfig:
    s = states[0]
    u = lambda: r.symbol(s, False)

    def limited(most: int, what: str, code: int = SYNTAX) -> int:
        v = u()
        if v > most:
            raise CodecError(code, f"{what} is {v}", r.at)
        return v

    version, micro, bits, num_h, num_v, sets = u(), 0, 8, 1, 1, 1
    if version not in (0, 1, 3):
        raise CodecError(UNSUPPORTED, f"version {version}")
    if version >= 3:
        micro = u()
        if micro < 4:
            raise CodecError(UNSUPPORTED, f"version 3.{micro} is unstable")
    coder, transitions = limited(2, "the coder type", UNSUPPORTED), DEFAULT_TRANSITIONS
    if coder == 2:
        moved = [t + r.symbol(s, True) for t in DEFAULT_TRANSITIONS[1:]]
        if not all(0 <= t <= 255 for t in moved):
            raise CodecError(SYNTAX, "a state transition leaves 0..255", r.at)
        transitions = bytes([DEFAULT_TRANSITIONS[0], *moved])
    colorspace = limited(1, "the colour space", UNSUPPORTED)
    if version >= 1:
        bits = limited(16, "the bit depth", UNSUPPORTED) or 8
    chroma = bool(r.bit(s, 0))
    log2_h, log2_v = limited(255, "horizontal subsampling"), limited(255, "vertical subsampling")
    extra = bool(r.bit(s, 0))
    if colorspace == RGB and (not chroma or log2_h or log2_v):
        raise CodecError(SYNTAX, "RGB has three planes of full size", r.at)
    if version >= 3:
        num_h, num_v = limited(2**32 - 2, "the slice grid") + 1, limited(2**32 - 2, "the slice grid") + 1
        sets = u()
        if not 1 <= sets <= MOST_SETS:
            raise CodecError(SYNTAX, f"{sets} quant sets", r.at)
    found = []
    for _ in range(sets):
        scale, tables = 1, []
        for _ in range(5):
            t, n = _table(r, scale)
            tables.append(t)
            scale *= 2 * n - 1
        contexts = (scale + 1) // 2
        if contexts > MOST_CONTEXTS:
            raise CodecError(SYNTAX, f"{contexts} contexts are out of range", r.at)
        found.append(QuantSet(tuple(tables), contexts))
    initial, ec, intra = [], False, False
    if version >= 3:
        for q in found:
            if not r.bit(s, 0):
                initial.append(None)
                continue
            rows, before = [], bytes([START] * 32)
            for _ in range(q.contexts):
                before = bytes(b + r.symbol(states[i], True) & 255 for i, b in enumerate(before))
                rows.append(before)
            initial.append(tuple(rows))
        ec, intra = bool(limited(1, "error correction", UNSUPPORTED)), bool(limited(1, "the intra mode", UNSUPPORTED))
    r.use(transitions)
    return StreamConfig(width, height, bits, colorspace, chroma, extra, log2_h, log2_v, num_h, num_v, GOLOMB if coder == 0 else RANGE, ec, intra, version, micro, tuple(found), tuple(initial), transitions)


def read_record(record: bytes | None, width: int = 0, height: int = 0) -> StreamConfig:
    """A configuration record; frame extents are not in it. From version 3 on its CRC must hold, whatever the options say."""
    if not record:
        raise CodecError(INVALID_ARGUMENT, "the record is empty")
    if RangeDecoder(record).symbol(fresh_states(1)[0], False) >= 3:
        if len(record) < 6 or crc32_msb(record):
            raise CodecError(CRC_MISMATCH, "the record's CRC does not hold")
        record = record[:-4]
    return read_parameters(RangeDecoder(record), fresh_states(32), width, height)
