"""Frames: parse, inspect, encode, decode, and legacy frames that carry their parameters."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np

from lumaplan.operators.bits import BitReader
from lumaplan.operators.errors import INVALID_ARGUMENT, INVALID_STATE, SYNTAX, UNSUPPORTED, CodecError
from lumaplan.operators.range_coder import START, RangeDecoder, fresh_states
from lumaplan.operators.slices import Entropy, Header, Slice, check_coverage, decode_slice, encode_slice, locate, read_header
from lumaplan.operators.stream import GOLOMB, RANGE, StreamConfig, read_parameters


@dataclass(frozen=True)
class Frame:
    keyframe: bool
    slices: list[Slice]


@dataclass(frozen=True)
class Bootstrap:
    """What the start of a legacy frame says: its parameters if it carries some, and the coder after keyframe bit and parameters."""

    keyframe: bool
    config: StreamConfig | None
    content: int
    after_keyframe: tuple
    after_parameters: tuple | None


def same_stream(a: StreamConfig, b: StreamConfig) -> bool:
    """Equal in all that the bitstream depends on; absent initial states are the default ones."""
    return _plain(a) == _plain(b)


def _plain(c: StreamConfig) -> StreamConfig:
    return replace(c, initial=tuple(x or None for x in (c.initial or (None,) * len(c.quant_sets))), micro=c.micro if c.version >= 3 else 0, intra=c.intra if c.version >= 3 else False)


def bootstrap(payload: bytes, width: int, height: int) -> Bootstrap:
    if not payload:
        raise CodecError(INVALID_ARGUMENT, "the frame is empty")
    r = RangeDecoder(payload)
    key = bool(r.bit(bytearray([START]), 0))
    first = r.state()
    if not key:
        return Bootstrap(False, None, r.at, first, None)
    c = read_parameters(r, fresh_states(32), width, height)
    return Bootstrap(True, c, r.at, first, r.state())


def bootstrap_key(payload: bytes | None, width: int, height: int) -> str | None:
    """A digest of the parameters that a legacy frame carries, equal for what same_stream() calls equal; None if it has none."""
    b = bootstrap(payload or b"", width, height)
    if b.config is None:
        return None
    if b.config.version > 1:
        raise CodecError(UNSUPPORTED, "only versions 0 and 1 carry parameters in frames")
    return hashlib.sha256(repr(_plain(b.config)).encode()).hexdigest()


def bootstrap_result(config: StreamConfig | None, payload: bytes, width: int, height: int) -> tuple[str, StreamConfig | None]:
    """not_present, configured (config was None), matches or differs; and the configuration that holds afterwards."""
    b = bootstrap(payload, width, height)
    if b.config is None:
        return "not_present", config
    if b.config.version > 1:
        raise CodecError(UNSUPPORTED, "only versions 0 and 1 carry parameters in frames")
    if config is None:
        return "configured", b.config
    return ("matches" if same_stream(config, b.config) else "differs"), config


def _legacy_slice(c: StreamConfig, payload: bytes) -> Frame:
    """The slices of a frame of version 0 or 1: one, or, if the caller has set a grid, as many headers one after another as cover
    the frame. The content of each of these starts where its header ends, with a coder of its own. A range coded frame's own parameters
    may have other state transitions than the stream's."""
    many = c.num_h != 1 or c.num_v != 1
    if many and c.entropy == GOLOMB:
        raise CodecError(UNSUPPORTED, "legacy Golomb-Rice frames have one slice")
    whole = Header(0, 0, 1, 1, (0,) * c.slots)
    held = None
    try:
        b = bootstrap(payload, c.width, c.height)
        found = b.config and (replace(b.config, transitions=c.transitions) if c.entropy == RANGE else b.config)
        held = b if found and same_stream(c, found) else None
    except CodecError:
        b = None
    if c.entropy == RANGE:
        r = RangeDecoder(payload)
        key = bool(r.bit(bytearray([START]), 0))
        if many:
            if held:
                r.resume(held.after_parameters)
            slices: list[Slice] = []
            while sum(s.header.w * s.header.h for s in slices) < c.num_h * c.num_v:
                h = read_header(r, c)
                slices.append(Slice(len(slices), payload, 0, r.at, len(payload), 0, h, old=held is not None and c.version == 0))
            check_coverage(c, slices)
            return Frame(key, slices)
        at, arithmetic = (held.content, held.after_parameters) if held else (r.at, r.state())
        moved = held.config.transitions if held and held.config.transitions != c.transitions else None
        return Frame(key, [Slice(0, payload, 0, at, len(payload), 0, whole, arithmetic=arithmetic, transitions=moved)])
    if held:
        _, low, at, _ = held.after_parameters
        return Frame(held.keyframe, [Slice(0, payload, 0, at - (low & 255 != 0), len(payload), 0, whole)])
    key = bool(BitReader(payload[:1]).bits(1))
    return Frame(key, [Slice(0, payload, 0, 0, len(payload), 0, whole, content_bit=1)])


def parse_frame(c: StreamConfig, payload: bytes | None, verify_crc: bool = True) -> Frame:
    """Headers only. Raises CodecError with the place of the first fault."""
    if not payload:
        raise CodecError(INVALID_ARGUMENT, "the frame is empty")
    if c.version < 3:
        frame = _legacy_slice(c, payload)
    else:
        slices, key = [], False
        for i, (start, size, status, crc) in enumerate(locate(c, payload, verify_crc)):
            data = payload[start:]
            try:
                r = RangeDecoder(payload[start : start + size], c.transitions)
                if i == 0:
                    key = bool(r.bit(bytearray([START]), 0))
                h = read_header(r, c)
            except CodecError as e:
                if e.byte_offset is not None:
                    e.byte_offset += start
                raise e.at(byte_offset=start, slice_index=i) from None
            at = r.at - (c.entropy == GOLOMB and r.low & 255 != 0)
            slices.append(Slice(i, data, start, start + at, start + size, size, h, status, crc, r.state()))
        frame = Frame(key, slices)
        check_coverage(c, slices)
    if not frame.keyframe and c.intra and c.version >= 3:
        raise CodecError(SYNTAX, "an intra-only stream has a frame that is no keyframe", 0)
    return frame


def frame_info(c: StreamConfig, keyframe: bool, slices: int) -> dict:
    planes = [{"role": c.role(p), "sample_format": "u8" if c.sample_bytes == 1 else "u16", "width": c.plane_size(p)[0], "height": c.plane_size(p)[1], "stride_bytes": c.plane_size(p)[0] * c.sample_bytes} for p in range(c.planes)]
    return {"version": c.version, "micro_version": c.micro, "entropy_mode": c.entropy, "width": c.width, "height": c.height, "bits": c.bits, "colorspace": c.colorspace, "chroma": c.chroma, "extra": c.extra, "log2_h": c.log2_h, "log2_v": c.log2_v, "num_h": c.num_h, "num_v": c.num_v, "keyframe": keyframe, "slice_count": slices, "plane_count": c.planes, "planes": planes}


def check_planes(c: StreamConfig, planes: list[np.ndarray]) -> None:
    if len(planes) != c.planes:
        raise CodecError(INVALID_ARGUMENT, f"the stream has {c.planes} planes")
    for p, a in enumerate(planes):
        if a.shape[::-1] != c.plane_size(p):
            raise CodecError(INVALID_ARGUMENT, f"plane {p} is {a.shape[1]}x{a.shape[0]}, not {'x'.join(map(str, c.plane_size(p)))}")


def raster_headers(c: StreamConfig) -> list[Header]:
    return [Header(x, y, 1, 1, (0,) * c.slots) for y in range(c.num_v) for x in range(c.num_h)]


def crop(c: StreamConfig, planes: list[np.ndarray], h: Header) -> list[np.ndarray]:
    out = []
    for p, a in enumerate(planes):
        x, y, w, k = c.cell(p, h.x, h.y, h.w, h.h)
        out.append(a[y : y + k, x : x + w])
    return out


def encode_frame(c: StreamConfig, planes: list[np.ndarray], keyframe: bool = True, states: list[Entropy] | None = None, headers: list[Header] | None = None) -> tuple[bytes, list[Entropy]]:
    """The frame's bytes, and the states for the next frame. states are not changed: a frame that fails leaves them as they were."""
    check_planes(c, planes)
    if not keyframe and c.intra:
        raise CodecError(INVALID_ARGUMENT, "an intra-only stream has keyframes only")
    if not keyframe and states is None:
        raise CodecError(INVALID_STATE, "a frame that is no keyframe needs one before it")
    out, after = [], []
    for i, h in enumerate(headers or raster_headers(c)):
        try:
            data, state = encode_slice(c, crop(c, planes, h), h, keyframe if i == 0 else None, None if keyframe else states[i])
        except CodecError as e:
            raise e.at(slice_index=i) from None
        out.append(data)
        after.append(state)
    return b"".join(out), after


def slice_candidates(c: StreamConfig, s: Slice) -> list[tuple[int, bool]]:
    """Starts of Golomb-Rice content to try, and whether bytes may follow it. Some encoders let the content share the header's
    last byte. A start whose content ends exactly at the footer is taken before any that leaves bytes over."""
    if c.entropy == RANGE or s.content_bit or s.content <= s.offset or c.version >= 3 and s.footer <= s.content - 1:
        return [(s.content, False)]
    exact = [(s.content, False), (s.content - 1, False)]
    if c.version < 3:
        return exact
    loose = [(s.content, True), (s.content - 1, True)]
    return exact + (loose[::-1] if c.extra and c.num_h * c.num_v > 1 else loose)


def decode_one(c: StreamConfig, s: Slice, state: Entropy | None, observe: list | None = None) -> tuple[list[np.ndarray], Entropy]:
    fault = None
    for start, trailing in slice_candidates(c, s):
        seen = None if observe is None else []
        try:
            out = decode_slice(c, s, state, start, trailing, seen)
            if observe is not None:
                observe += seen
            return out
        except CodecError as e:
            fault = fault or e
    raise fault.at(slice_index=s.index, byte_offset=s.content)


def decode_frame(c: StreamConfig, payload: bytes, states: dict[tuple, Entropy] | None = None, verify_crc: bool = True) -> tuple[list[np.ndarray], bool, dict[tuple, Entropy]]:
    """The planes, whether the frame is a keyframe, and states by slice layout. A frame that fails changes nothing."""
    f = parse_frame(c, payload, verify_crc)
    if not f.keyframe and (states is None or {s.layout for s in f.slices} != set(states)):
        raise CodecError(INVALID_STATE, "the frame's slices don't match the states of the frame before")
    planes = [np.zeros(c.plane_size(p)[::-1], np.int64) for p in range(c.planes)]
    after = {}
    for s in f.slices:
        parts, after[s.layout] = decode_one(c, s, None if f.keyframe else states[s.layout])
        for p, a in enumerate(parts):
            x, y, w, h = c.cell(p, *s.layout)
            planes[p][y : y + h, x : x + w] = a
    return planes, f.keyframe, after
