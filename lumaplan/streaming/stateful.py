"""Encoding and decoding of streams with state from frame to frame, by transformWithStateInPandas.

Frames of a stream come in order of frame_index. A key is a slice of a stream; its state is the entropy coder's state after
the last frame and that frame's index. A slice that fails keeps its state as it was; its frame fails as a whole, and so do the
frames that need it, up to the next keyframe. The RocksDB state store is needed (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumaplan.operators.codec import _plane, _reparsed, config_of
from lumaplan.operators.errors import INVALID_ARGUMENT, INVALID_STATE, SYNTAX, CodecError
from lumaplan.operators.frames import decode_one, encode_slice, parse_frame, raster_headers
from lumaplan.operators.golomb import Adaptive
from lumaplan.operators.slices import Entropy

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dump(state: Entropy) -> str:
    banks = [[list(x) if isinstance(x, bytearray) else {"a": [x.drift, x.error_sum, x.bias, x.count]} for x in b] for b in state.banks]
    return json.dumps({"banks": banks, "transitions": list(state.transitions)} if state.transitions else banks)


def shared_folder(spark) -> str:
    """spark.checkpoint.dir, or on a local master a folder of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='stream-work-')}"


def load(text: str) -> Entropy:
    held = json.loads(text)
    banks, transitions = (held["banks"], bytes(held["transitions"])) if isinstance(held, dict) else (held, None)
    return Entropy([[Adaptive(*x["a"]) if isinstance(x, dict) else bytearray(x) for x in b] for b in banks], transitions)


class _Kept(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "frame_index long, entropy string")

    def before(self, frame: int) -> Entropy:
        last = self.kept.get() if self.kept.exists() else None
        if last is None or last[0] != frame - 1:
            raise CodecError(INVALID_STATE, "the frame before, which this one needs, is missing", frame_index=frame)
        return load(last[1])

    def after(self, frame: int, state: Entropy) -> None:
        self.kept.update((frame, dump(state)))

    def close(self) -> None:
        pass


class _Encode(_Kept):
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        r = pd.concat(list(rows)).sort_values(["frame_index", "plane"])
        for frame, parts in r.groupby("frame_index", sort=True):
            head = parts.iloc[0]
            try:
                if bad := next((x for x in parts["fault"] if isinstance(x, str)), None):
                    raise CodecError(INVALID_ARGUMENT, bad)
                c = config_of(bytes(head["record"]), int(head["width"]), int(head["height"]))
                if parts["plane"].tolist() != list(range(c.planes)):
                    raise CodecError(INVALID_ARGUMENT, f"the stream has {c.planes} planes")
                h = raster_headers(c)[int(key[1])]
                kind = "u1" if c.sample_bytes == 1 else "<u2"
                cells = [c.cell(int(p), h.x, h.y, h.w, h.h) for p in parts["plane"]]
                planes = [np.frombuffer(data, kind).reshape(ch, cw) for data, (_, _, cw, ch) in zip(parts["data"], cells, strict=True)]
                is_key = frame % int(head["keyframe_interval"]) == 0
                data, state = encode_slice(c, planes, h, is_key if key[1] == 0 else None, None if is_key else self.before(frame))
                self.after(frame, state)
                fault = None
            except CodecError as e:
                data, fault = None, e.message
            yield pd.DataFrame({"stream_id": [key[0]], "slice_index": [key[1]], "frame_index": [frame], "data": [data], "fault": [fault]})


class _Decode(_Kept):
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in pd.concat(list(rows)).sort_values("frame_index").to_dict("records"):
            c = config_of(bytes(r["record"]), int(r["width"]), int(r["height"]))
            frame, out = int(r["frame_index"]), []
            try:
                if isinstance(r["fault"], str):
                    raise CodecError(SYNTAX, r["fault"])
                parts, state = decode_one(c, _reparsed(c, r | {"payload": bytes(r["payload"])}), None if r["keyframe"] else self.before(frame))
                self.after(frame, state)
                for p, a in enumerate(parts):
                    x, y, w, h = c.cell(p, *(int(r[k]) for k in ("raster_x", "raster_y", "raster_w", "raster_h")))
                    out.append((key[0], int(r["slice_index"]), frame, p, x, y, w, h, a.astype("u1" if c.sample_bytes == 1 else "<u2").tobytes(), None))
            except CodecError as e:
                out.append((key[0], None if pd.isna(r["slice_index"]) else int(r["slice_index"]), frame, None, None, None, None, None, None, e.message))
            yield pd.DataFrame(out, columns=["stream_id", "slice_index", "frame_index", "plane", "x", "y", "w", "h", "data", "fault"]).astype({k: "Int32" for k in ("slice_index", "plane", "x", "y", "w", "h")})


def encode_stream(planes: DataFrame, streams: DataFrame) -> DataFrame:
    """stream_id, slice_index, frame_index, data, fault of each slice. planes (streaming): stream_id, frame_index, plane, data, all
    planes of a frame in one batch. Slices of a frame joined in order of slice_index are its payload. A plane of wrong size or
    number, or a missing one: a fault in every slice of the frame."""
    from pyspark.sql import functions as F

    schema = "stream_id long, slice_index int, frame_index long, plane int, data binary, fault string, record binary, width long, height long, keyframe_interval long"

    def cut(batches):
        import pyarrow as pa

        for rb in batches:
            out = []
            for r in rb.to_pylist():
                c, a, fault = config_of(r["record"], r["width"], r["height"]), None, None
                try:
                    if r["plane"] is None or not 0 <= r["plane"] < c.planes:
                        raise CodecError(INVALID_ARGUMENT, f"the stream has {c.planes} planes")
                    a = _plane(c, r["plane"], r["data"] or b"")
                except CodecError as e:
                    fault = e.message
                for i, h in enumerate(raster_headers(c)):
                    part = None
                    if a is not None:
                        x, y, cw, ch = c.cell(r["plane"], h.x, h.y, h.w, h.h)
                        part = a[y : y + ch, x : x + cw].tobytes()
                    out.append((r["stream_id"], i, r["frame_index"], r["plane"], part, fault, r["record"], r["width"], r["height"], r["keyframe_interval"]))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[f.split(" ")[0] for f in schema.split(", ")])

    # Planes are cut before the shuffle: a slice's row carries its own samples only.
    rows = planes.select("stream_id", "frame_index", "plane", "data").join(streams, "stream_id").mapInArrow(cut, schema)
    return rows.groupBy("stream_id", "slice_index").transformWithStateInPandas(_Encode(), "stream_id long, slice_index int, frame_index long, data binary, fault string", "append", "none")


def decode_stream(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """stream_id, slice_index, frame_index, plane, x, y, w, h, data, fault of each slice's planes. packets (streaming): stream_id,
    frame_index, payload. A frame that does not parse gives a row with its fault and no slice. Frames come in order; decode_ordered()
    takes them in any order, and whole frames commit."""
    schema = "stream_id long, frame_index long, keyframe boolean, slice_index int, raster_x long, raster_y long, raster_w long, raster_h long, payload binary, record binary, width long, height long, fault string"

    def split(batches):
        import pyarrow as pa

        for rb in batches:
            out = []
            for r in rb.to_pylist():
                try:
                    c = config_of(r["record"], r["width"], r["height"])
                    f = parse_frame(c, r["payload"])
                except CodecError as e:
                    out.append((r["stream_id"], r["frame_index"], *[None] * 7, r["record"], r["width"], r["height"], e.message))
                    continue
                tail = 8 if c.ec else 3
                out += [(r["stream_id"], r["frame_index"], f.keyframe, s.index, *s.layout, r["payload"][s.offset : s.footer + tail] if c.version >= 3 else r["payload"], r["record"], r["width"], r["height"], None) for s in f.slices]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[f.split(" ")[0] for f in schema.split(", ")])

    rows = packets.select("stream_id", "frame_index", "payload").join(streams, "stream_id").mapInArrow(split, schema)
    out = "stream_id long, slice_index int, frame_index long, plane int, x int, y int, w int, h int, data binary, fault string"
    return rows.groupBy("stream_id", "raster_x", "raster_y", "raster_w", "raster_h").transformWithStateInPandas(_Decode(), out, "append", "none")
