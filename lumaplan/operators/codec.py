"""The codec over DataFrames: planes to packets and back.

streams is a table with a row a stream: stream_id, record (configuration record), width, height, keyframe_interval. Records
are read once a worker process. A slice of a group of pictures is one group of rows: keyframes start every slice anew, so
groups are independent; only frames of one group that follow a keyframe go through one task in order. Groups that are alike in a
task are coded in lockstep (lanes.py), the others one by one (slices.py); the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaplan.operators.errors import INVALID_ARGUMENT, STATUS, SYNTAX, CodecError, ok_status
from lumaplan.operators.frames import bootstrap_key, check_planes, decode_one, encode_slice, frame_info, parse_frame, raster_headers
from lumaplan.operators.lanes import FEWEST, decode_frames, encode_frames, lanes_at_once
from lumaplan.operators.slices import Header, Slice, locate
from lumaplan.operators.options import DecoderOptions, EncoderOptions
from lumaplan.operators.stream import YCBCR, StreamConfig, encoder_profile, read_record, write_record

STREAMS = "stream_id long, record binary, width long, height long, keyframe_interval long"
PLANE_INFO = "array<struct<role:string,sample_format:string,width:bigint,height:bigint,stride_bytes:bigint>>"
INFO_FIELDS = "version int, micro_version int, entropy_mode string, width long, height long, bits int, colorspace int, chroma boolean, extra boolean, log2_h int, log2_v int, num_h long, num_v long, keyframe boolean, slice_count int, plane_count int"
_STATUS = pa.struct([("code", pa.int32()), ("message", pa.string()), ("byte_offset", pa.int64()), ("frame_index", pa.int64()), ("slice_index", pa.int32())])


@lru_cache(maxsize=256)
def config_of(record: bytes | None, width: int, height: int) -> StreamConfig:
    if record is None:
        raise CodecError(INVALID_ARGUMENT, "the stream has no configuration, or one of another size")
    return replace(_read_once(record), width=width, height=height)


@lru_cache(maxsize=256)
def _read_once(record: bytes | None) -> StreamConfig:
    """Many streams have equal records: each is read once a worker process, as long as it is among the last that were read."""
    return read_record(record)


@lru_cache(maxsize=256)
def _written_once(c: StreamConfig) -> bytes:
    """The record of a configuration without extents, which are not in it."""
    return write_record(c)


def configure(spark, configs: dict[int, StreamConfig], keyframe_interval: int = 1, public: bool = True, options: EncoderOptions | None = None) -> DataFrame:
    """The streams table of some configurations that the public encoder takes; raises CodecError on others. Not public: their own
    quant tables, initial states and state transitions stay. options: theirs is the keyframe interval, and the entropy coder of
    all configurations."""
    if options:
        keyframe_interval = options.checked().keyframe_interval
        configs = {i: replace(c, version=options.version, entropy=options.entropy) for i, c in configs.items()}
    rows = []
    for i, c in configs.items():
        c = encoder_profile(c, keyframe_interval) if public else replace(c, intra=keyframe_interval == 1)
        rows.append((i, bytearray(write_record(c)), c.width, c.height, keyframe_interval))
    return spark.createDataFrame(rows, STREAMS)


def configure_rows(rows: DataFrame, build: Callable[[dict], StreamConfig], public: bool = True) -> DataFrame:
    """STREAMS and status of a table of settings: stream_id, keyframe_interval and what build() makes a configuration of. Records are
    written by as many tasks as a shuffle has, equal ones once a worker. Settings that are refused: record null, and the status says why."""
    schema = f"{STREAMS}, status {STATUS}"
    arrow = _arrow(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                c = None
                try:
                    options = EncoderOptions(keyframe_interval=r["keyframe_interval"]).checked()
                    c = build(r)
                    c = encoder_profile(c, options.keyframe_interval) if public else replace(c, intra=options.keyframe_interval == 1)
                    out.append((r["stream_id"], _written_once(replace(c, width=0, height=0)), c.width, c.height, options.keyframe_interval, ok_status()))
                except CodecError as e:
                    out.append((r["stream_id"], None, c and c.width, c and c.height, r["keyframe_interval"], e.status()))
            yield _batch(out, arrow)

    # A number that is given is kept: by its few bytes a table of settings would go to one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "stream_id").mapInArrow(write, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _plane(c: StreamConfig, p: int, data: bytes) -> np.ndarray:
    w, h = c.plane_size(p)
    if len(data) != w * h * c.sample_bytes:
        raise CodecError(INVALID_ARGUMENT, f"plane {p} has {len(data)} bytes, not {w * h * c.sample_bytes}")
    return np.frombuffer(data, "u1" if c.sample_bytes == 1 else "<u2").reshape(h, w)


_PIECE = "stream_id long, gop long, slice_index int, frame_index long, plane int, data binary, fault string, record binary, width long, height long, keyframe_interval long"
_CODED = f"stream_id long, frame_index long, slice_index int, keyframe boolean, data binary, status {STATUS}"


def _chains(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], most: int = 4096, room: int = 64 << 20) -> Iterator[list[list[dict]]]:
    """Rows that are sorted by key, as lists of those of one key; so many lists at a time, or of so many bytes."""
    chains: list[list[dict]] = []
    last, size = None, 0
    for rb in batches:
        for r in rb.to_pylist():
            now = tuple(r[k] for k in key)
            if now != last:
                if len(chains) >= most or size >= room:
                    yield chains
                    chains, size = [], 0
                chains.append([])
                last = now
            chains[-1].append(r)
            size += len(r.get("data") or r.get("payload") or b"")
    if chains:
        yield chains


def _together(keys: list[tuple | None], sets_of) -> Iterator[list[int]]:
    """Indices of chains that can go in lockstep: those of one key, if they are enough, in even parts; keys of None can't."""
    groups: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        if k is not None:
            groups.setdefault(k, []).append(i)
    for k, members in groups.items():
        size = lanes_at_once(*sets_of(k))
        size = -(-len(members) // -(-len(members) // size))
        for a in range(0, len(members), size):
            if len(members[a : a + size]) >= FEWEST:
                yield members[a : a + size]


def _arrays(c: StreamConfig, header: Header, parts: list[dict]) -> list[np.ndarray]:
    kind = "u1" if c.sample_bytes == 1 else "<u2"
    cells = [c.cell(p, header.x, header.y, header.w, header.h) for p in range(c.planes)]
    return [np.frombuffer(p["data"], kind).reshape(k, w) for p, (_, _, w, k) in zip(parts, cells, strict=True)]


def _coded(chains: list[list[dict]]) -> Iterator[list[tuple]]:
    """Rows of _CODED of each chain: pieces of one slice of one group of pictures, in order of frames and planes."""
    configs = [config_of(r[0]["record"], r[0]["width"], r[0]["height"]) for r in chains]
    headers = [raster_headers(c)[r[0]["slice_index"]] for c, r in zip(configs, chains, strict=True)]
    keys: list[tuple | None] = []
    for c, h, rows in zip(configs, headers, chains, strict=True):
        start, n = rows[0]["gop"] * rows[0]["keyframe_interval"], c.planes
        whole = len(rows) % n == 0 and all(r["fault"] is None and r["frame_index"] == start + i // n and r["plane"] == i % n for i, r in enumerate(rows))
        keys.append((rows[0]["record"], rows[0]["width"], rows[0]["height"], *(c.cell(p, h.x, h.y, h.w, h.h)[2:] for p in range(n))) if whole else None)
    done: list[list[bytes] | None] = [None] * len(chains)
    for some in _together(keys, lambda k: (config_of(*k[:3]), (0,) * config_of(*k[:3]).slots, sum(w * h for w, h in k[3:]))):
        c = configs[some[0]]
        frames = [[_arrays(c, headers[i], chains[i][a : a + c.planes]) for a in range(0, len(chains[i]), c.planes)] for i in some]
        for i, data in zip(some, encode_frames(c, [headers[i] for i in some], [chains[i][0]["slice_index"] == 0 for i in some], frames), strict=True):
            done[i] = data
    for c, h, rows, data in zip(configs, headers, chains, done, strict=True):
        if data is None:
            yield _coded_alone(c, h, rows)
        else:
            yield [(rows[0]["stream_id"], rows[0]["gop"] * rows[0]["keyframe_interval"] + f, rows[0]["slice_index"], f == 0, d, ok_status()) for f, d in enumerate(data)]


def _coded_alone(c: StreamConfig, header: Header, rows: list[dict]) -> list[tuple]:
    head, state, out = rows[0], None, []
    frames: dict[int, list[dict]] = {}
    for r in rows:
        frames.setdefault(r["frame_index"], []).append(r)
    expected = head["gop"] * head["keyframe_interval"]
    for f, parts in frames.items():
        key = f % head["keyframe_interval"] == 0
        data, status = None, ok_status()
        try:
            if f != expected:
                raise CodecError(2, "a frame is missing before this one")
            if fault := next((p["fault"] for p in parts if p["fault"]), None):
                raise CodecError(INVALID_ARGUMENT, fault)
            if [p["plane"] for p in parts] != list(range(c.planes)):
                raise CodecError(INVALID_ARGUMENT, f"the stream has {c.planes} planes")
            data, state = encode_slice(c, _arrays(c, header, parts), header, key if head["slice_index"] == 0 else None, None if key else state)
            expected = f + 1
        except CodecError as e:
            status = e.at(frame_index=f, slice_index=head["slice_index"]).status()
        out.append((head["stream_id"], f, head["slice_index"], key, data, status))
    return out


def encode(planes: DataFrame, streams: DataFrame) -> DataFrame:
    """stream_id, frame_index, keyframe, payload and status of each frame. planes: stream_id, frame_index, plane, data.

    A plane of wrong size, a missing plane or a sample over the bit depth: payload null and the status of the first slice
    that fails; frames after it in its group that are no keyframes fail too. Streams that streams does not name: no rows.
    """
    piece = _arrow(_PIECE)
    coded = _arrow(_CODED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in rb.to_pylist():
                c = config_of(r["record"], r["width"], r["height"])
                gop, out, fault, a = r["frame_index"] // r["keyframe_interval"], [], None, None
                try:
                    if not 0 <= r["plane"] < c.planes:
                        raise CodecError(INVALID_ARGUMENT, f"the stream has {c.planes} planes")
                    a = _plane(c, r["plane"], r["data"] or b"")
                except CodecError as e:
                    fault = e.message
                for i, h in enumerate(raster_headers(c)):
                    part = None
                    if fault is None:
                        x, y, w, k = c.cell(r["plane"], h.x, h.y, h.w, h.h)
                        part = a[y : y + k, x : x + w].tobytes()
                    out.append((r["stream_id"], gop, i, r["frame_index"], r["plane"], part, fault, r["record"], r["width"], r["height"], r["keyframe_interval"]))
                yield _batch(out, piece)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chains in _chains(batches, ("stream_id", "gop", "slice_index")):
            yield _batch([r for rows in _coded(chains) for r in rows], coded)

    pieces = planes.select("stream_id", "frame_index", "plane", "data").join(streams, "stream_id").mapInArrow(cut, _PIECE)
    slices = pieces.repartition("stream_id", "gop", "slice_index").sortWithinPartitions("stream_id", "gop", "slice_index", "frame_index", "plane").mapInArrow(code, _CODED)
    bad = F.col("status.code") != 0
    frames = slices.groupBy("stream_id", "frame_index").agg(F.first("keyframe").alias("keyframe"), F.array_sort(F.collect_list(F.struct("slice_index", "data"))).alias("parts"), F.min_by("status", F.when(bad, F.col("slice_index"))).alias("fault"), F.min_by("status", "slice_index").alias("fine"))
    payload = F.when(F.col("fault").isNull(), F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"])))
    return frames.select("stream_id", "frame_index", "keyframe", payload.alias("payload"), F.coalesce("fault", "fine").alias("status"))


def _opted(streams: DataFrame, verify_crc: bool, options: DecoderOptions | None) -> tuple[DataFrame, bool]:
    """streams and CRC check as a decoder's options want them."""
    if options is None:
        return streams, verify_crc
    options.checked()
    if options.width:
        size = {k: F.when(F.coalesce(F.col(k), F.lit(0)) == 0, F.lit(v).cast("long")).otherwise(F.col(k)) for k, v in (("width", options.width), ("height", options.height))}
        streams = streams.withColumns(size)
        fits = (F.col("width") == options.width) & (F.col("height") == options.height)
        streams = streams.withColumn("record", F.when(fits, F.col("record")))
    return streams, verify_crc and options.verify_crc


SLICES = "slice_index int, raster_x long, raster_y long, raster_w long, raster_h long, x long, y long, w long, h long, payload_offset long, content_offset long, footer_offset long, slice_size long, error_status int, crc long"


def inspect(packets: DataFrame, streams: DataFrame, verify_crc: bool = True, grid: tuple[int, int] | None = None, options: DecoderOptions | None = None) -> DataFrame:
    """stream_id, frame_index, the stream's and frame's facts, planes, slices (array of SLICES) and status; no sample is decoded.
    Damaged frames: facts null but for the status. grid: the slice grid of legacy streams, whose records do not hold one.
    options: see decode()."""
    streams, verify_crc = _opted(streams, verify_crc, options)
    info = [x.split(" ")[0] for x in INFO_FIELDS.split(", ")]
    fields = ",".join(":".join(x.split(" ")) for x in SLICES.split(", ")).replace("long", "bigint")
    schema = f"stream_id long, frame_index long, {INFO_FIELDS}, planes {PLANE_INFO}, slices array<struct<{fields}>>, status {STATUS}"
    arrow = _arrow(schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                try:
                    c = config_of(r["record"], r["width"], r["height"])
                    if grid and c.version < 3:
                        c = replace(c, num_h=grid[0], num_v=grid[1])
                    f = parse_frame(c, r["payload"], verify_crc)
                    facts = frame_info(c, f.keyframe, len(f.slices))
                    slices = []
                    for s in f.slices:
                        x, y, w, h = c.cell(0, *s.layout)
                        slices.append(dict(zip([n.split(" ")[0] for n in SLICES.split(", ")], (s.index, *s.layout, x, y, w, h, s.offset, s.content, s.footer, s.size, s.error_status, s.crc), strict=True)))
                    out.append((r["stream_id"], r["frame_index"], *(facts[k] for k in info), facts["planes"], slices, ok_status()))
                except CodecError as e:
                    out.append((r["stream_id"], r["frame_index"], *(None for _ in info), None, None, e.at(frame_index=r["frame_index"]).status()))
            yield _batch(out, arrow)

    return packets.select("stream_id", "frame_index", "payload").join(streams, "stream_id").mapInArrow(look, schema)


_FOUND = f"stream_id long, frame_index long, keyframe boolean, slice_index int, raster_x long, raster_y long, raster_w long, raster_h long, payload binary, record binary, width long, height long, keyframe_interval long, status {STATUS}"
_PART = f"stream_id long, frame_index long, keyframe boolean, plane int, slice_index int, x int, y int, w int, h int, data binary, status {STATUS}"
PLANES = f"stream_id long, frame_index long, keyframe boolean, plane int, role string, width int, height int, bytes_per_sample int, data binary, status {STATUS}"


_GROUP = ("stream_id", "gop", "raster_x", "raster_y", "raster_w", "raster_h")


def _split(verify_crc: bool):
    found = _arrow(_FOUND)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in rb.to_pylist():
                tail = (r["record"], r["width"], r["height"], r["keyframe_interval"])
                try:
                    c = config_of(r["record"], r["width"], r["height"])
                    f = parse_frame(c, r["payload"], verify_crc)
                    rows = [(r["stream_id"], r["frame_index"], f.keyframe, s.index, *s.layout, r["payload"][s.offset : s.footer + (8 if c.ec else 3)] if c.version >= 3 else r["payload"], *tail, ok_status()) for s in f.slices]
                except CodecError as e:
                    rows = [(r["stream_id"], r["frame_index"], None, None, None, None, None, None, None, *tail, e.at(frame_index=r["frame_index"]).status())]
                yield _batch(rows, found)

    return split


def _found_slices(packets: DataFrame, streams: DataFrame, verify_crc: bool, regular: bool) -> DataFrame:
    """A row a slice with the group of pictures it is in, or a row with a fault for a frame that does not parse."""
    slices = packets.select("stream_id", "frame_index", "payload").join(streams, "stream_id").mapInArrow(_split(verify_crc), _FOUND)
    if regular:
        return slices.withColumn("gop", F.floor(F.col("frame_index") / F.col("keyframe_interval")).cast("long"))
    keys = inspect(packets, streams, False).select("stream_id", "frame_index", F.coalesce("keyframe", F.lit(False)).cast("long").alias("k"))
    keys = keys.select("stream_id", "frame_index", F.sum("k").over(Window.partitionBy("stream_id").orderBy("frame_index")).alias("gop"))
    return slices.join(keys, ["stream_id", "frame_index"])


def _decoded(rows: list[dict], observe: list | None = None, old: bool = False) -> Iterator[tuple]:
    """row, configuration, planes (None: failed) and status of each slice of one group, in order of frames; observe holds the
    current slice's samples."""
    state, before = None, None
    for r in sorted(rows, key=lambda r: r["frame_index"]):
        c = config_of(r["record"], r["width"], r["height"])
        if observe is not None:
            observe.clear()
        try:
            if not r["keyframe"] and (state is None or before != r["frame_index"] - 1):
                raise CodecError(2, "the frame before, which this one needs, is missing")
            s = _reparsed(c, r)
            s = replace(s, old=True) if old and c.version == 0 else s
            parts, state = decode_one(c, s, None if r["keyframe"] else state, observe)
            before = r["frame_index"]
            yield r, c, parts, ok_status()
        except CodecError as e:
            before = None
            yield r, c, None, e.at(frame_index=r["frame_index"], slice_index=r["slice_index"]).status()


def _decoded_chains(chains: list[list[dict]], old: bool = False) -> Iterator[tuple]:
    """_decoded() of many groups: those whose first frame is a keyframe and lacks no frame after it go in lockstep."""
    keys: list[tuple | None] = []
    slices: list[list[Slice]] = []
    for rows in chains:
        first, key, parsed = rows[0], None, []
        if all(r["frame_index"] == first["frame_index"] + f and r["keyframe"] == (f == 0) for f, r in enumerate(rows)):
            try:
                c = config_of(first["record"], first["width"], first["height"])
                if c.version >= 3:
                    parsed = [_reparsed(c, r) for r in rows]
                    shape = tuple(c.cell(p, *parsed[0].layout)[2:] for p in range(c.planes))
                    same = all(s.header.sets == parsed[0].header.sets for s in parsed)
                    key = (first["record"], first["width"], first["height"], parsed[0].header.sets, shape) if same else None
            except CodecError:
                key = None
        keys.append(key)
        slices.append(parsed)
    done: list[list[list[np.ndarray]] | None] = [None] * len(chains)
    for some in _together(keys, lambda k: (config_of(*k[:3]), k[3], sum(w * h for w, h in k[4]))):
        c = config_of(*keys[some[0]][:3])  # type: ignore[index]
        for i, planes in zip(some, decode_frames(c, [slices[i] for i in some]), strict=True):
            done[i] = planes
    for rows, key, planes in zip(chains, keys, done, strict=True):
        if planes is None:
            yield from _decoded(rows, old=old)
        else:
            c = config_of(*key[:3])  # type: ignore[index]
            yield from ((r, c, parts, ok_status()) for r, parts in zip(rows, planes, strict=True))


_SEEN = ("drift", "error_sum", "bias", "count", "run_index", "run_pending")
TRACE = "stream_id long, frame_index long, slice_index int, plane int, y int, x int, context int, diff int, place_before long, place_after long, bank int, k int, " + ", ".join(f"{f} int" for f in (*_SEEN, *(f"{f}_after" for f in _SEEN), "sample"))


def trace(packets: DataFrame, streams: DataFrame, regular: bool = True) -> DataFrame:
    """Rows of TRACE: what the decoder reads for each sample, y and x inside the slice; places are bits (Golomb-Rice) or bytes
    (range coder) into the slice's content or slice. Golomb-Rice: the context's parameter k, and what it has seen, before and after;
    others: null. sample: null for RGB, where the decoder's own are those before the inverse transform. Slices that fail give no rows."""
    arrow = _arrow(TRACE)

    def run(t: pa.Table) -> pa.Table:
        seen: list = []
        batches = [_batch([], arrow)]
        for r, c, parts, _ in _decoded(t.to_pylist(), seen):
            if parts is not None:
                rows = []
                for s in seen:
                    plane, y, x, context, diff = s[:5]
                    v = int(parts[plane][y, x]) if c.colorspace == YCBCR else None
                    rows.append((r["stream_id"], r["frame_index"], r["slice_index"], *s, v))
                batches.append(_batch(rows, arrow))
        return pa.Table.from_batches(batches)

    return _found_slices(packets, streams, True, regular).where("status.code = 0").groupBy(*_GROUP).applyInArrow(run, TRACE)


def decode(packets: DataFrame, streams: DataFrame, verify_crc: bool = True, regular: bool = True, old_arithmetic: bool = False, options: DecoderOptions | None = None) -> DataFrame:
    """Rows of PLANES: every plane of every frame. packets: stream_id, frame_index, payload.

    regular: keyframes come every keyframe_interval frames, as the encoder writes them. Otherwise groups start at each
    keyframe that the packets hold, found by a window over ids alone. A damaged frame gives one row with null plane and the
    status of its first fault; frames that need it fail too. Streams that streams does not name: no rows.
    old_arithmetic: range coded content of version 0 is in the arithmetic of the oldest streams. State transitions that a range
    coded keyframe of versions 0 and 1 brings along hold up to the next keyframe.
    options: refused ones raise CodecError; their frame size, if they have one, stands for that of streams without a size, and
    those of another size are none of theirs: their frames fail.
    """
    streams, verify_crc = _opted(streams, verify_crc, options)
    part, whole = _arrow(_PART), _arrow(PLANES)

    def decode_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chains in _chains(batches, _GROUP):
            out = []
            for r, c, parts, status in _decoded_chains(chains, old_arithmetic):
                for p, a in enumerate(parts or []):
                    x, y, w, h = c.cell(p, r["raster_x"], r["raster_y"], r["raster_w"], r["raster_h"])
                    out.append((r["stream_id"], r["frame_index"], r["keyframe"], p, r["slice_index"], x, y, w, h, a.astype("u1" if c.sample_bytes == 1 else "<u2").tobytes(), status))
                if parts is None:
                    out.append((r["stream_id"], r["frame_index"], r["keyframe"], None, r["slice_index"], None, None, None, None, None, status))
            yield _batch(out, part)

    def paste(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        bad = [r["status"] for r in rows if r["status"]["code"]]
        first = rows[0]
        if bad:
            status = min(bad, key=lambda s: -1 if s["slice_index"] is None else s["slice_index"])
            return pa.Table.from_batches([_batch([(first["stream_id"], first["frame_index"], first["keyframe"], *[None] * 6, status)], whole)])
        c = config_of(first["record"], first["width"], first["height"])
        kind, out = "u1" if c.sample_bytes == 1 else "<u2", []
        for p in range(c.planes):
            w, h = c.plane_size(p)
            a = np.zeros((h, w), kind)
            for r in rows:
                if r["plane"] == p:
                    a[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["data"], kind).reshape(r["h"], r["w"])
            out.append((first["stream_id"], first["frame_index"], first["keyframe"], p, c.role(p), w, h, c.sample_bytes, a.tobytes(), ok_status()))
        return pa.Table.from_batches([_batch(out, whole)])

    slices = _found_slices(packets, streams, verify_crc, regular)
    good = slices.where("status.code = 0").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "frame_index").mapInArrow(decode_groups, _PART)
    none = [F.lit(None).cast("int").alias(k) for k in ("x", "y", "w", "h")]
    bad = slices.where("status.code <> 0").select("stream_id", "frame_index", "keyframe", F.lit(None).cast("int").alias("plane"), "slice_index", *none, F.lit(None).cast("binary").alias("data"), "status")
    parts = good.unionByName(bad).join(streams.select("stream_id", "record", "width", "height"), "stream_id")
    return parts.groupBy("stream_id", "frame_index").applyInArrow(paste, PLANES)


def _reparsed(c: StreamConfig, r: dict):
    """The Slice of a row that holds one slice's bytes (the whole frame before version 3)."""
    from lumaplan.operators.range_coder import START, RangeDecoder
    from lumaplan.operators.slices import read_header

    data = r["payload"]
    if c.version < 3:
        return parse_frame(c, data).slices[0]
    size = len(data) - (8 if c.ec else 3)
    coder = RangeDecoder(data[:size], c.transitions)
    if r["slice_index"] == 0:
        coder.bit(bytearray([START]), 0)
    header = read_header(coder, c)
    if (header.x, header.y, header.w, header.h) != tuple(r[k] for k in _GROUP[2:]):
        raise CodecError(SYNTAX, "the slice's header is not the one it was found by", 0)
    content = coder.at - (c.entropy == "golomb" and coder.low & 255 != 0)
    return Slice(r["slice_index"], data, 0, content, size, size, header, arithmetic=coder.state())


def parse_records(records: DataFrame) -> DataFrame:
    """The configuration in each record: stream_id, the stream's facts, planes, contexts of each quant set, and status."""
    info = [x for x in INFO_FIELDS.split(", ") if x.split(" ")[0] not in ("keyframe", "slice_count")]
    schema = f"stream_id long, {', '.join(info)}, planes {PLANE_INFO}, contexts array<int>, ec boolean, intra boolean, status {STATUS}"
    arrow, names = _arrow(schema), [x.split(" ")[0] for x in info]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                try:
                    c = replace(_read_once(r["record"]), width=r["width"] or 0, height=r["height"] or 0)
                    facts = frame_info(c, False, 0)
                    out.append((r["stream_id"], *(facts[k] for k in names), facts["planes"], [q.contexts for q in c.quant_sets], c.ec, c.intra, ok_status()))
                except CodecError as e:
                    out.append((r["stream_id"], *(None for _ in names), None, None, None, None, e.status()))
            yield _batch(out, arrow)

    return records.select("stream_id", "record", "width", "height").mapInArrow(read, schema)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, for tasks that make much of each."""
    for rb in batches:
        for a in range(0, len(rb), rows):
            yield rb.slice(a, rows)


def record_tables(records: DataFrame) -> DataFrame:
    """Every entry of every quant table of the records (stream_id, record) that parse: stream_id, quant_set, table, i, value."""
    schema = "stream_id long, quant_set int, table int, values array<int>"
    arrow = _arrow(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in _few(batches):
            out = []
            for r in rb.to_pylist():
                try:
                    c = _read_once(r["record"])
                except CodecError:
                    continue
                out += [(r["stream_id"], k, t, list(v)) for k, q in enumerate(c.quant_sets) for t, v in enumerate(q.tables)]
            yield _batch(out, arrow)

    rows = records.select("stream_id", "record").mapInArrow(read, schema)
    return rows.select("stream_id", "quant_set", "table", F.posexplode("values").alias("i", "value"))


def record_states(records: DataFrame) -> DataFrame:
    """The initial states that the records bring along: stream_id, quant_set, context, place, state."""
    schema = "stream_id long, quant_set int, context int, states array<int>"
    arrow = _arrow(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in _few(batches):
            out = []
            for r in rb.to_pylist():
                try:
                    c = _read_once(r["record"])
                except CodecError:
                    continue
                out += [(r["stream_id"], k, i, list(row)) for k, first in enumerate(c.initial) for i, row in enumerate(first or ())]
            yield _batch(out, arrow)

    rows = records.select("stream_id", "record").mapInArrow(read, schema)
    return rows.select("stream_id", "quant_set", "context", F.posexplode("states").alias("place", "state"))


def bootstrap_frames(packets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Legacy frames against the parameters of their stream's first frame that has some: stream_id, frame_index, result
    (not_present, configured, matches, differs) and status. sizes: stream_id, width, height.

    Each payload is read where it is; what goes on is a digest of its parameters, and the first of a stream is a minimum."""
    schema = f"stream_id long, frame_index long, parameters string, status {STATUS}"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                try:
                    out.append((r["stream_id"], r["frame_index"], bootstrap_key(r["payload"], r["width"], r["height"]), ok_status()))
                except CodecError as e:
                    out.append((r["stream_id"], r["frame_index"], None, e.at(frame_index=r["frame_index"]).status()))
            yield _batch(out, arrow)

    rows = packets.select("stream_id", "frame_index", "payload").join(sizes.select("stream_id", "width", "height"), "stream_id").mapInArrow(run, schema)
    some = F.col("parameters").isNotNull()
    first = rows.where(some).groupBy("stream_id").agg(F.min(F.struct("frame_index", "parameters")).alias("first"))
    result = F.when(F.col("status.code") != 0, None).when(~some, "not_present").when(F.col("frame_index") == F.col("first.frame_index"), "configured")
    result = result.when(F.col("parameters") == F.col("first.parameters"), "matches").otherwise("differs")
    return rows.join(first, "stream_id", "left").select("stream_id", "frame_index", result.alias("result"), "status")


def unpacked(planes: DataFrame) -> DataFrame:
    """Packed planes as samples: stream_id, frame_index, plane, y, x, v. Null planes: no rows. Planes may have given, the places of
    the samples to return (null: all)."""
    schema = "stream_id long, frame_index long, plane int, y int, x int, v int"
    arrow, masked = _arrow(schema), "given" in planes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            stream, frame, plane, width, size = (rb.column(x).to_numpy() for x in ("stream_id", "frame_index", "plane", "width", "bytes_per_sample"))
            for i in range(len(rb)):
                v = np.frombuffer(rb.column("data")[i].as_buffer(), "u1" if size[i] == 1 else "<u2")
                at = np.arange(len(v), dtype=np.int32)
                if masked and rb.column("given")[i].is_valid:
                    at = rb.column("given")[i].values.to_numpy()
                    v = v[at]
                y, x = np.divmod(at, width[i])
                same = (pa.array(np.full(len(v), a[i]), f.type) for a, f in zip((stream, frame, plane), arrow, strict=False))
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(a.astype(np.int32)) for a in (y, x, v))], schema=arrow)

    rows = planes.where("plane is not null and data is not null").select("stream_id", "frame_index", F.col("plane").cast("int").alias("plane"), F.col("width").cast("int").alias("width"), F.col("bytes_per_sample").cast("int").alias("bytes_per_sample"), "data", *(["given"] if masked else []))
    return rows.mapInArrow(run, schema)


__all__ = ["Header", "bootstrap_frames", "check_planes", "configure", "decode", "encode", "inspect", "locate", "parse_records", "record_states", "record_tables", "trace", "unpacked"]
