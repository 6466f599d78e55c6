"""Frames of versions 0 and 1: written for tests and for archives that want them; the codec reads them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaplan.operators.bits import BitWriter
from lumaplan.operators.errors import INVALID_ARGUMENT, UNSUPPORTED, CodecError
from lumaplan.operators.golomb import Runs
from lumaplan.operators.range_coder import START, IntervalEncoder, RangeEncoder, adaptive_transitions, fresh_states, zero_transitions
from lumaplan.operators.slices import Entropy, Header, _golomb_row, banks_of, border, coded_planes, residuals, row_order, write_header
from lumaplan.operators.stream import GOLOMB, RANGE, YCBCR, StreamConfig, write_parameters

PACKETS = "stream_id long, frame_index long, keyframe boolean, payload binary"


def parameters(c: StreamConfig) -> bytes:
    """The record of a legacy stream: its parameters alone, without a CRC."""
    w = RangeEncoder()
    write_parameters(c, w, fresh_states(32))
    return w.closed()


def legacy_streams(spark, configs: dict[int, StreamConfig], keyframe_interval: int = 1) -> DataFrame:
    """The streams table of legacy configurations; see codec.STREAMS."""
    rows = [(i, bytearray(parameters(c)), c.width, c.height, keyframe_interval) for i, c in configs.items()]
    return spark.createDataFrame(rows, "stream_id long, record binary, width long, height long, keyframe_interval long")


@lru_cache(maxsize=1)
def other_transitions() -> tuple[bytes, ...]:
    """State transitions for samples that the stream's own leave no value for: slower, faster and less sure ones, and last those
    that keep a state at one half."""
    return (*(adaptive_transitions(rate, top) for top in (192, 224, 248, 160) for rate in (0.02, 0.04, 0.08, 0.15, 0.06, 0.1, 0.03, 0.2)), bytes([0, *[START] * 255]))


def encode_legacy_frame(c: StreamConfig, planes: list[np.ndarray], keyframe: bool = True, embed: bool = True, state: Entropy | None = None, old: bool = False, spelled: bool = False, transitions: bytes | None = None) -> tuple[bytes, Entropy]:
    """One frame of one slice, and the state for the next. embed: keyframes carry the parameters (spelled: see
    write_parameters()). old: the content is in the
    arithmetic of the oldest streams (version 0, range coder). Samples that no stream of such an arithmetic says are an error.
    transitions: others than the stream's, for a keyframe that carries its parameters and for the frames up to the next one."""
    if c.version > 1 or c.num_h != 1 or c.num_v != 1 or old and (c.version or c.entropy != RANGE):
        raise CodecError(UNSUPPORTED, "only frames of one slice of versions 0 and 1 are written")
    if transitions is not None and not (keyframe and embed and c.entropy == RANGE):
        raise CodecError(INVALID_ARGUMENT, "only range coded keyframes with parameters bring state transitions along")
    sets, bank, _ = banks_of(c, Header(0, 0, 1, 1, (0,) * c.slots))
    state = Entropy.fresh(c, sets) if keyframe or state is None else state.copy()
    state.transitions = transitions or state.transitions
    c = replace(c, transitions=state.transitions or c.transitions)
    plain = not old and (c.entropy == GOLOMB or c.colorspace != YCBCR)
    w, out, embed = RangeEncoder() if plain else IntervalEncoder(), BitWriter(), embed and keyframe
    if c.entropy == RANGE or embed:
        w.bit(bytearray([START]), 0, int(keyframe))
        if embed:
            write_parameters(c, w, fresh_states(32), spelled)
        w.one, w.zero = c.transitions, zero_transitions(c.transitions)
    else:
        out.bits(int(keyframe), 1)
    if isinstance(w, IntervalEncoder):
        w.old, w.zero_symbol_carry = old, c.colorspace == YCBCR
    if old:
        for x in (x for b in state.banks for x in b):
            x[0] = 255
    coded = coded_planes(c, planes)
    parts = [(*residuals(c, s, bits, c.quant_sets[0], border(c, p)), bits) for p, (s, bits) in enumerate(coded)]
    runs = [Runs() for _ in coded]
    for p, y in row_order(c, [s.shape[0] for s, _ in coded]):
        contexts, diffs, states = parts[p][0][y].tolist(), parts[p][1][y].tolist(), state.banks[bank[p]]
        if c.entropy == GOLOMB:
            _golomb_row(out, runs[0 if c.colorspace else p], states, contexts, diffs, parts[p][2])
        else:
            for k, d in zip(contexts, diffs, strict=True):
                w.symbol(states[k], d, True)
    if c.entropy == RANGE:
        return w.closed(), state
    return (w.lower_bound() if embed else b"") + out.finish(), state


def encode_legacy_grid(c: StreamConfig, headers: list[Header], keyframe: bool = True) -> bytes:
    """A range coded frame of several slices as far as their headers go."""
    w = RangeEncoder()
    w.bit(bytearray([START]), 0, int(keyframe))
    for h in headers:
        write_header(w, c, h)
    return w.closed()


def encode_legacy(planes: DataFrame, streams: DataFrame, embed: bool = True, old: bool = False) -> DataFrame:
    """Rows of PACKETS out of planes (stream_id, frame_index, plane, data). A frame that lacks a plane, or has one of wrong size: payload null. A group of pictures, of which
    there is one for each keyframe_interval frames, is a task's unit. A frame that can't be said in its arithmetic is tried with or without parameters,
    as a keyframe, and as one with other_transitions(); if none does, its payload is null."""
    from lumaplan.operators.codec import _arrow, _batch, _plane, config_of

    arrow = _arrow(PACKETS)

    def code(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["frame_index"], r["plane"]))
        c, out, state = config_of(rows[0]["record"], rows[0]["width"], rows[0]["height"]), [], None
        frames: dict[int, list[dict]] = {}
        for r in rows:
            frames.setdefault(r["frame_index"], []).append(r)
        for part in frames.values():
            key = part[0]["frame_index"] % part[0]["keyframe_interval"] == 0
            held, data = state, None
            try:
                if [r["plane"] for r in part] != list(range(c.planes)):
                    raise CodecError(INVALID_ARGUMENT, f"the stream has {c.planes} planes")
                arrays = [_plane(c, r["plane"], r["data"] or b"") for r in part]
            except CodecError:
                state = None
                out.append((part[0]["stream_id"], part[0]["frame_index"], key, None))
                continue
            # Where the arithmetic leaves no value for the samples, other bytes before them, fresh states or other transitions may do so.
            ways = [(key, embed, False, None), (key, not embed, False, None), (key, True, True, None), (True, embed, False, None), (True, not embed, False, None), (True, True, True, None)]
            ways += [(True, True, False, t) for t in other_transitions() if t != c.transitions]
            for as_key, bring, spelled, transitions in ways[: len(ways) if c.entropy == RANGE else 1]:
                try:
                    if as_key or held is not None:
                        data, state = encode_legacy_frame(c, arrays, as_key, bring, held, old, spelled, transitions)
                        key = as_key
                        break
                except CodecError:
                    state = None
            out.append((part[0]["stream_id"], part[0]["frame_index"], key, data))
        return pa.Table.from_batches([_batch(out, arrow)])

    rows = planes.select("stream_id", "frame_index", "plane", "data").join(streams, "stream_id")
    return rows.withColumn("gop", F.floor(F.col("frame_index") / F.col("keyframe_interval"))).groupBy("stream_id", "gop").applyInArrow(code, PACKETS)


def encode_grids(frames: DataFrame, c: StreamConfig, headers: Callable[[int], list[Header]]) -> DataFrame:
    """Rows of PACKETS with the headers of frames of several slices: frames are stream_id, frame_index and keyframe, headers() the slices
    of a frame."""
    from lumaplan.operators.codec import _arrow, _batch

    arrow = _arrow(PACKETS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield _batch([(r["stream_id"], r["frame_index"], r["keyframe"], encode_legacy_grid(c, headers(r["frame_index"]), r["keyframe"]) + bytes(8)) for r in rb.to_pylist()], arrow)

    return frames.select("stream_id", "frame_index", "keyframe").mapInArrow(write, PACKETS)
