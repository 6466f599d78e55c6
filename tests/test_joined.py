"""Content that shares its header's last byte; output views; settings as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaplan.operators import codec
from lumaplan.operators.coverage import into_views
from lumaplan.operators.errors import INVALID_ARGUMENT, UNSUPPORTED, CodecError
from lumaplan.operators.frames import decode_one, parse_frame, slice_candidates
from lumaplan.operators.joined import _only_once, joined, joined_slice
from lumaplan.operators.options import DecoderOptions, EncoderOptions
from lumaplan.operators.slices import Header, encode_slice
from lumaplan.operators.stream import GOLOMB, StreamConfig

PLANES = "stream_id long, frame_index long, plane int, data binary"


def test_both_starts():
    """In every slice the start that is named by `second` is the right one, and the decoder finds it."""
    c, rng, header, late = StreamConfig(16, 9, entropy=GOLOMB), np.random.default_rng(6), Header(0, 0, 1, 1, (0, 0)), 0
    for _ in range(40):
        plane = rng.integers(0, 256, (9, 16))
        (s,) = parse_frame(c, encode_slice(c, [plane], header, True, None)[0]).slices
        content = s.payload[s.content : s.footer]
        for second in (False, True):
            (t,) = parse_frame(c, joined_slice(c, header, content, True, second)).slices
            starts = [a for a, _ in slice_candidates(c, t)]
            right = t.footer - len(content)
            assert starts[0 if not second else 1] == right and (starts[0] != right) == second
            if not second or _only_once(c, s):
                assert (decode_one(c, t, None)[0][0] == plane).all()
                late += second
    assert late > 20


def test_joined_packets(spark):
    rows = [(1, f, 0, bytearray(np.random.default_rng(f).integers(0, 256, 96).astype("u1").tobytes())) for f in range(6)]
    streams = codec.configure(spark, {1: StreamConfig(12, 8, num_h=2, entropy=GOLOMB, ec=True)}, 2).union(codec.configure(spark, {2: StreamConfig(12, 8)}))
    packets = codec.encode(spark.createDataFrame(rows, PLANES), streams)
    for second in (False, True):
        new = joined(packets, streams, second)
        assert sorted((r["frame_index"], bytes(r["data"])) for r in codec.decode(new, streams).collect()) == [(r[1], bytes(r[3])) for r in rows]
        assert new.join(packets.select("frame_index", F.col("payload").alias("was")), "frame_index").where("payload = was").count() == 0
    odd = spark.createDataFrame([(1, 0, None), (1, 1, bytearray(b"x")), (2, 0, bytearray(b"xyz"))], "stream_id long, frame_index long, payload binary")
    assert [r["payload"] for r in joined(odd, streams, True).collect()] == [None] * 3


def test_views(spark):
    planes = spark.createDataFrame([(1, 0, True, 0, "Y", 3, 2, 1, bytearray(b"abcdef")), (1, 0, True, 1, "Cb", 1, 2, 2, bytearray(b"ghij")), (2, 0, True, 0, "Y", 3, 2, 1, bytearray(b"abcdef"))], "stream_id long, frame_index long, keyframe boolean, plane int, role string, width int, height int, bytes_per_sample int, data binary")
    views = spark.createDataFrame([(1, 0, "Y", "u8", 4, 3, 5), (1, 1, "Cb", "u16", 1, 2, 1)], "stream_id long, plane int, role string, sample_format string, width int, height int, stride_bytes int")
    got = {(r["stream_id"], r["plane"]): (r["data"] and bytes(r["data"]), r["fault"]) for r in into_views(planes, views).collect()}
    assert got == {(1, 0): (b"abc\0\0def\0\0\0\0\0\0\0", None), (1, 1): (None, "stride"), (2, 0): (None, "missing")}


def test_options_are_taken(spark):
    rows = [(1, 0, 0, bytearray(range(48)))]
    streams = codec.configure(spark, {1: StreamConfig(8, 6)}, options=EncoderOptions(entropy=GOLOMB, keyframe_interval=3))
    assert streams.first()["keyframe_interval"] == 3
    packets = codec.encode(spark.createDataFrame(rows, PLANES), streams)
    assert codec.inspect(packets, streams).first()["entropy_mode"] == GOLOMB
    for bad, code in ((DecoderOptions(threads=-1), INVALID_ARGUMENT), (DecoderOptions(strict=False), UNSUPPORTED), (DecoderOptions(width=8), INVALID_ARGUMENT)):
        for f in (codec.decode, codec.inspect):
            with pytest.raises(CodecError) as e:
                f(packets, streams, options=bad)
            assert e.value.code == code
    with pytest.raises(CodecError):
        codec.configure(spark, {1: StreamConfig(8, 6)}, options=EncoderOptions(keyframe_interval=0))
    status = lambda o, s=streams: codec.decode(packets, s, options=o).first()["status"]["code"]
    bare = streams.withColumns({"width": F.lit(0).cast("long"), "height": F.lit(0).cast("long")})
    assert [status(DecoderOptions(width=8, height=6)), status(DecoderOptions(width=9, height=6)), status(DecoderOptions(width=8, height=6), bare)] == [0, INVALID_ARGUMENT, 0]


def test_settings_as_rows(spark):
    rows = spark.createDataFrame([(1, 2, 8), (2, 0, 8), (3, 1, 99)], "stream_id long, keyframe_interval long, bits int")
    got = {r["stream_id"]: r for r in codec.configure_rows(rows, lambda r: StreamConfig(8, 6, r["bits"])).collect()}
    assert [(got[i]["record"] is not None, got[i]["status"]["code"]) for i in (1, 2, 3)] == [(True, 0), (False, 1), (False, UNSUPPORTED)]
    assert bytes(got[1]["record"]) == bytes(codec.configure(spark, {1: StreamConfig(8, 6)}, 2).first()["record"])
