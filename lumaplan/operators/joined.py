"""Golomb-Rice slices whose content begins in the last byte of their header, as some encoders write them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame

from lumaplan.operators.codec import STREAMS, _arrow, _batch, config_of
from lumaplan.operators.errors import UNSUPPORTED, CodecError
from lumaplan.operators.frames import parse_frame
from lumaplan.operators.range_coder import RangeEncoder
from lumaplan.operators.slices import KEYFRAME_START, Header, Slice, decode_slice, with_footer, write_header
from lumaplan.operators.stream import GOLOMB, StreamConfig

PACKETS = "stream_id long, frame_index long, keyframe boolean, payload binary"


def joined_slice(c: StreamConfig, header: Header, content: bytes, keyframe: bool | None, second: bool) -> bytes:
    """A slice of given content whose first byte is the header's last: the two bytes with which a range coder ends leave its low one
    free where the range is wide enough. second: that byte is just the one of the lower bound, so that a reader sees a header
    which ends behind it, and has to try the start before. The sample aspect ratio, which readers pass on only, is varied until
    a header ends so."""
    for n in range(1 << 14):
        w = RangeEncoder(c.transitions)
        if keyframe is not None:
            w.bit(bytearray([KEYFRAME_START]), 0, int(keyframe))
        write_header(w, c, header if n == 0 else replace(header, sar=(1 + n % 128, 1 + n // 128)))
        above = content[0] - w.low & 255
        if above < w.range and (above == 0) == second:
            w._add(above)
            return with_footer(c, w.lower_bound()[:-1] + content)
    raise CodecError(UNSUPPORTED, "no header ends as this content begins")


def _only_once(c: StreamConfig, s: Slice) -> bool:
    """Whether a keyframe's content is no content any more without its first byte: else a reader would take the wrong start for right."""
    try:
        decode_slice(c, s, None, s.content + 1)
    except CodecError:
        return True
    return False


def joined(packets: DataFrame, streams: DataFrame, second: bool) -> DataFrame:
    """Whole packets of Golomb-Rice streams of version 3, written anew with joined slices; samples stay. second holds for slices of
    keyframes that can be read in one way only; the others get a header whose first start is right. Null payloads, and frames
    that do not parse or can't be joined: payload null."""
    arrow = _arrow(PACKETS)

    def one(s: Slice, c: StreamConfig, key: bool) -> bytes:
        late = second and key and _only_once(c, s)
        return joined_slice(c, s.header, s.payload[s.content - s.offset : s.footer - s.offset], key if s.index == 0 else None, late)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                key = payload = None
                try:
                    c = config_of(r["record"], r["width"], r["height"])
                    if c.entropy != GOLOMB or c.version < 3:
                        raise CodecError(UNSUPPORTED, "only Golomb-Rice slices of version 3 are joined")
                    f = parse_frame(c, r["payload"])
                    key, payload = f.keyframe, b"".join(one(s, c, f.keyframe) for s in f.slices)
                except CodecError:
                    payload = None
                out.append((r["stream_id"], r["frame_index"], key, payload))
            yield _batch(out, arrow)

    return packets.select("stream_id", "frame_index", "payload").join(streams.select(*(f.split(" ")[0] for f in STREAMS.split(", "))), "stream_id").mapInArrow(write, PACKETS)
