"""Streaming decode with frames as transactions: frames may come in any order, and a frame's slices commit together or not at all.

A key is a group of pictures of a stream, so groups go through many tasks at once. Its state is a reorder buffer of frames that
wait for an earlier one, the index of the next frame, and the entropy state of every slice after the last frame that came
through. A gap is given up when the buffer spans `depth` frames, or, if there is a patience, when a timer runs out without the
missing frame; frames that need a lost one fail up to the next group. Of a group that is done only that is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumaplan.operators.codec import config_of
from lumaplan.operators.errors import INVALID_ARGUMENT, INVALID_STATE, STATUS, CodecError
from lumaplan.operators.frames import decode_one, parse_frame
from lumaplan.operators.golomb import Adaptive
from lumaplan.operators.slices import Entropy, banks_of
from lumaplan.operators.stream import GOLOMB, StreamConfig

_OUT = "stream_id long, frame_index long, keyframe boolean, plane int, role string, width int, height int, bytes_per_sample int, data binary, code int, message string, byte_offset long, slice_index int"
_COLUMNS = [f.split(" ")[0] for f in _OUT.split(", ")]
_INTS = {k: "Int64" for k in ("stream_id", "frame_index", "byte_offset")} | {k: "Int32" for k in ("plane", "width", "height", "bytes_per_sample", "code", "slice_index")} | {"keyframe": "boolean"}


def dump_state(c: StreamConfig, state: Entropy) -> bytes:
    """A slice's state, bank after bank, and behind them state transitions that are not the stream's."""
    if c.entropy == GOLOMB:
        return np.array([(x.drift, x.error_sum, x.bias, x.count) for b in state.banks for x in b], "<i8").tobytes()
    return b"".join(bytes(x) for b in state.banks for x in b) + (state.transitions or b"")


def load_state(c: StreamConfig, sets: tuple[int, ...], data: bytes) -> Entropy:
    """The inverse of dump_state() for a slice with these quant sets."""
    sizes, at, banks = [c.quant_sets[i].contexts for i in sets], 0, []
    if c.entropy == GOLOMB:
        rows = np.frombuffer(data, "<i8").reshape(-1, 4).tolist()
        for n in sizes:
            banks.append([Adaptive(*r) for r in rows[at : at + n]])
            at += n
        return Entropy(banks)
    for n in sizes:
        banks.append([bytearray(data[32 * i : 32 * i + 32]) for i in range(at, at + n)])
        at += n
    return Entropy(banks, bytes(data[32 * at :]) or None)


class FrameDecoder(StatefulProcessor):
    """See the module."""

    def __init__(self, depth: int, patience_ms: int | None, verify_crc: bool):
        self.depth, self.patience, self.verify = depth, patience_ms, verify_crc

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "frame_index long", "payload binary")
        self.slices = handle.getMapState("slices", "x long, y long, w long, h long", "sets array<int>, entropy binary")
        self.place = handle.getValueState("place", "next long, committed long, last long, record binary, width long, height long")

    def close(self) -> None:
        pass

    def _decode(self, c: StreamConfig, frame: int, payload: bytes | None, committed: int) -> tuple[list[tuple], int]:
        """Rows of a frame, and the last frame that came through."""
        head, key = (self.stream, frame), None
        try:
            f = parse_frame(c, payload, self.verify)
            key = f.keyframe
            if not key and committed != frame - 1:
                raise CodecError(INVALID_STATE, "the frame before, which this one needs, is missing")
            held = {}
            if not key:
                held = {tuple(k): v for k, v in self.slices.iterator()}
                if {s.layout for s in f.slices} != set(held):
                    raise CodecError(INVALID_STATE, "the frame's slices are not those of the frame before")
            planes, after = [np.zeros(c.plane_size(p)[::-1], "u1" if c.sample_bytes == 1 else "<u2") for p in range(c.planes)], {}
            for s in f.slices:
                sets = banks_of(c, s.header)[0]
                before = held.get(s.layout)
                if before is not None and tuple(before[0]) != sets:
                    raise CodecError(INVALID_STATE, "the state is of another layout", slice_index=s.index)
                parts, state = decode_one(c, s, None if before is None else load_state(c, sets, bytes(before[1])))
                after[s.layout] = (list(sets), dump_state(c, state))
                for p, a in enumerate(parts):
                    x, y, w, h = c.cell(p, *s.layout)
                    planes[p][y : y + h, x : x + w] = a
        except CodecError as e:
            # Nothing was stored yet: the states stay those of the last frame that came through.
            return [(*head, key, None, None, None, None, None, None, e.code, e.message, e.byte_offset, e.slice_index)], committed
        if key:
            self.slices.clear()
        for layout, state in after.items():
            self.slices.updateValue(layout, state)
        return [(*head, key, p, c.role(p), a.shape[1], a.shape[0], c.sample_bytes, a.tobytes(), 0, None, None, None) for p, a in enumerate(planes)], frame

    def _drain(self, c: StreamConfig, place: tuple, give_up: bool) -> tuple[list[tuple], tuple]:
        """Decodes what is in order. A gap that is too wide, or that is given up, is jumped over."""
        next_, committed, last, *record = place
        out, waiting = [], sorted(k[0] for k in self.pending.keys())
        while waiting:
            if waiting[0] > next_:
                if not give_up and waiting[-1] - next_ < self.depth:
                    break
                next_, give_up = waiting[0], False
            frame = waiting.pop(0)
            rows, committed = self._decode(c, frame, self.pending.getValue((frame,))[0], committed)
            self.pending.removeKey((frame,))
            out += rows
            next_ = frame + 1
        return out, (next_, committed, last, *record)

    def _result(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype(_INTS)

    def _settle(self, place: tuple, now: int) -> None:
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if list(self.pending.keys()):
                self.handle.registerTimer(now + self.patience)
        if place[0] > place[2]:
            self.slices.clear()
        self.place.update(place)

    def _now(self, timers) -> int:
        return 0 if self.patience is None else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.stream, out = int(key[0]), []
        given = pd.concat(list(rows))
        head = given.iloc[0]
        if self.place.exists():
            place = self.place.get()
        else:
            first = int(key[1]) * int(head["keyframe_interval"])
            place = (first, first - 1, first + int(head["keyframe_interval"]) - 1, bytes(head["record"]), int(head["width"]), int(head["height"]))
        c = config_of(bytes(place[3]), place[4], place[5])
        for frame, payload in zip(given["frame_index"].tolist(), given["payload"].tolist(), strict=True):
            if frame < place[0] or self.pending.containsKey((frame,)):
                out.append((self.stream, frame, None, None, None, None, None, None, None, INVALID_ARGUMENT, "the frame was there before, or was given up", None, None))
            else:
                self.pending.updateValue((frame,), (payload or b"",))
        done, place = self._drain(c, place, False)
        self._settle(place, self._now(timerValues))
        yield from self._result(out + done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stream = int(key[0])
        place = self.place.get()
        done, place = self._drain(config_of(bytes(place[3]), place[4], place[5]), place, True)
        self._settle(place, self._now(timerValues))
        yield from self._result(done)


def decode_ordered(packets: DataFrame, streams: DataFrame, depth: int = 64, patience_ms: int | None = None, verify_crc: bool = True) -> DataFrame:
    """Rows of codec.PLANES of a streaming table of packets (stream_id, frame_index, payload) in any order, the same as decode() gives
    for all of them at once; a frame that comes twice, or after it was given up, is a row with a fault.

    Keyframes come every keyframe_interval frames. depth: frames that the buffer may span; it bounds a group's state. patience_ms:
    how long frames wait for a missing one (None: until the buffer is full); then batches without data run too, so that a query
    with trigger availableNow ends only if spark.sql.streaming.noDataMicroBatches.enabled is off. Null payload: a fault. Null ids and streams that streams does not name: no rows.
    """
    rows = packets.where("stream_id is not null and frame_index >= 0").select("stream_id", "frame_index", "payload").join(streams, "stream_id")
    rows = rows.withColumn("gop", F.floor(F.col("frame_index") / F.col("keyframe_interval")).cast("long"))
    out = rows.groupBy("stream_id", "gop").transformWithStateInPandas(FrameDecoder(depth, patience_ms, verify_crc), _OUT, "append", "none" if patience_ms is None else "processingTime")
    status = F.struct("code", "message", "byte_offset", "frame_index", "slice_index").cast(STATUS)
    return out.select(*_COLUMNS[:9], status.alias("status"))
