"""The codec over DataFrames: the same bytes as frame by frame, faults, state across frames, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaplan.functions import columns as C
from lumaplan.operators import codec
from lumaplan.operators.frames import encode_frame
from lumaplan.operators.stream import GOLOMB, RANGE, RGB, StreamConfig, encoder_profile
from lumaplan.sources.planes import packed


def planes_of(c, n, stream=1, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(n):
        arrays = []
        for p in range(c.planes):
            w, h = c.plane_size(p)
            arrays.append((np.cumsum(rng.integers(-2, 3, (h, w)), 1) + f * 3) & ((1 << c.bits) - 1))
        out.append(arrays)
    rows = [(stream, f, p, bytearray(a.astype("u1" if c.bits <= 8 else "<u2").tobytes())) for f, x in enumerate(out) for p, a in enumerate(x)]
    return out, rows


PLANES = "stream_id long, frame_index long, plane int, data binary"
CASES = [(StreamConfig(21, 13, 8, num_h=2, num_v=2, ec=True), 1), (StreamConfig(21, 13, 10, entropy=GOLOMB), 3), (StreamConfig(21, 13, 12, RGB, True, True, num_h=3, entropy=RANGE), 4), (StreamConfig(21, 13, 8, chroma=True, log2_h=1, log2_v=1, num_v=2, entropy=GOLOMB), 2)]


@pytest.mark.parametrize("config,interval", CASES)
def test_same_bytes_and_planes(spark, config, interval):
    c = encoder_profile(config, interval)
    arrays, rows = planes_of(c, 7)
    streams = codec.configure(spark, {1: config}, interval)
    packets = codec.encode(spark.createDataFrame(rows, PLANES).repartition(4), streams)
    got = {r["frame_index"]: r for r in packets.collect()}
    states = None
    for f, x in enumerate(arrays):
        data, states = encode_frame(c, x, f % interval == 0, states)
        assert bytes(got[f]["payload"]) == data and got[f]["keyframe"] == (f % interval == 0) and got[f]["status"]["code"] == 0
    for regular in (True, False):
        back = {(r["frame_index"], r["plane"]): bytes(r["data"]) for r in codec.decode(packets, streams, regular=regular).collect()}
        assert back == {(r[1], r[2]): bytes(r[3]) for r in rows}


@pytest.mark.parametrize("config,interval", [(StreamConfig(17, 9, 8, num_h=2, num_v=2, ec=True), 1), (StreamConfig(9, 8, 10, RGB, True, entropy=GOLOMB), 2)])
def test_lockstep_is_serial(spark, config, interval):
    """Enough groups in one task for lockstep; one frame has a plane of wrong size, so its group goes alone."""
    c = encoder_profile(config, interval)
    arrays, rows = planes_of(c, 300)
    bad = 8 if interval == 1 else 9
    given = [(s, f, p, bytearray(b"short") if f == bad and p == 0 else d) for s, f, p, d in rows]
    streams = codec.configure(spark, {1: config}, interval)
    packets = codec.encode(spark.createDataFrame(given, PLANES).coalesce(2), streams).persist()
    got = {r["frame_index"]: r for r in packets.collect()}
    states = None
    for f, x in enumerate(arrays):
        data, states = encode_frame(c, x, f % interval == 0, states)
        assert (got[f]["payload"] is None and got[f]["status"]["code"] == 1) if f == bad else bytes(got[f]["payload"]) == data, f
    broken = packets.select("stream_id", "frame_index", F.when(F.col("frame_index") == 20, F.expr("substring(payload, 1, length(payload) - 9)")).otherwise(F.col("payload")).alias("payload")).where("payload is not null")
    back = codec.decode(broken, streams).collect()
    assert {(r["frame_index"], r["plane"]): bytes(r["data"]) for r in back if r["plane"] is not None} == {(r[1], r[2]): bytes(r[3]) for r in rows if r[1] not in (bad, 20, 21 if interval == 2 else 20)}
    assert {r["frame_index"] for r in back if r["status"]["code"]} == ({20} if interval == 1 else {20, 21})


def test_two_streams_and_faults(spark):
    a, b = StreamConfig(8, 6), StreamConfig(5, 9, 10, num_h=2, entropy=GOLOMB, ec=True)
    _, x = planes_of(a, 4, 1)
    _, y = planes_of(b, 4, 2)
    rows = [r for r in x if r[1] != 1] + [(1, 1, 0, bytearray(b"short"))] + y + [(3, 0, 0, bytearray(4))]
    streams = codec.configure(spark, {1: a}, 2).union(codec.configure(spark, {2: b}))
    packets = codec.encode(spark.createDataFrame(rows, PLANES), streams)
    got = {(r["stream_id"], r["frame_index"]): r for r in packets.collect()}
    assert set(got) == {(s, f) for s in (1, 2) for f in range(4)}
    assert {k for k, r in got.items() if r["status"]["code"]} == {(1, 1)} and got[1, 1]["payload"] is None
    planes = codec.decode(packets, streams).collect()
    assert {(r["stream_id"], r["frame_index"]) for r in planes if r["status"]["code"]} == {(1, 1)}
    assert {(r["stream_id"], r["frame_index"], bytes(r["data"])) for r in planes if not r["status"]["code"]} == {(r[0], r[1], bytes(r[3])) for r in x + y if r[:2] != (1, 1)}
    lost = codec.decode(packets.where("not (stream_id = 1 and frame_index = 2)"), streams).where("stream_id = 1")
    assert {r["frame_index"]: r["status"]["code"] for r in lost.collect()} == {0: 0, 1: 1, 3: 2}
    assert codec.encode(spark.createDataFrame([], PLANES), streams).count() == 0


def test_packed_and_unpacked(spark):
    rows = [(1, 0, p, y, x, (p * 7 + y * 31 + x * 257) % 1024) for p in range(2) for y in range(4) for x in range(5)]
    s = spark.createDataFrame(rows, "stream_id long, frame_index long, plane int, y int, x int, v int")
    p = packed(s, 10).withColumn("bytes_per_sample", F.lit(2))
    assert sorted(map(tuple, codec.unpacked(p).collect())) == rows


def test_column_literals(spark):
    one = spark.range(1)
    ints = lambda *v: [F.lit(x) for x in v]
    value = lambda *cols: tuple(one.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())
    assert value(*C.inverse_rct(*ints(112, 206, 356), 8, False)) == (200, 100, 50)
    assert value(*C.inverse_rct(*ints(450, 1624, 1824), 10, False)) == (900, 700, 100)
    assert value(*C.inverse_rct(*ints(600, 424, 1224), 10, True)) == (900, 700, 100)
    assert value(*(C.reconstruct(F.lit(p), F.lit(d), b) for p, d, b in ((250, 10, 8), (3, -5, 8), (65530, 10, 16)))) == (4, 254, 4)
    assert value(*(C.difference(F.lit(s), F.lit(p), 8) for s, p in ((255, 0), (0, 255), (128, 0), (0, 128)))) == (-1, 1, -128, -128)
    assert value(C.wrap_difference(F.lit(-70000), 0), C.wrap_difference(F.lit(70000), 31), C.floor_shift(F.lit(-7), 2)) == (-70000, 70000, -2)
    assert value(C.subsampled(F.lit(5), F.lit(1)), C.subsampled(F.lit(5), F.lit(40)), C.grid_boundary(F.lit(3), F.lit(17), F.lit(4))) == (3, 1, 12)


def test_streaming_is_batch(spark, tmp_path):
    from lumaplan.streaming.stateful import ROCKSDB, decode_stream, encode_stream

    config, interval = StreamConfig(12, 9, 8, num_h=2, entropy=GOLOMB, ec=True), 3
    arrays, rows = planes_of(encoder_profile(config, interval), 5)
    streams = codec.configure(spark, {1: config}, interval)
    want = {r["frame_index"]: bytes(r["payload"]) for r in codec.encode(spark.createDataFrame(rows, PLANES), streams).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for i in (0, 1):
            spark.createDataFrame([r for r in rows if (r[1] > 1) == bool(i)], PLANES).coalesce(1).write.mode("append").parquet(str(tmp_path / "planes"))
        source = spark.readStream.schema(PLANES).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "planes"))
        q = encode_stream(source, streams).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
        out = spark.read.parquet(str(tmp_path / "out"))
        got = {}
        for r in sorted(out.collect(), key=lambda r: (r["frame_index"], r["slice_index"])):
            assert r["fault"] is None
            got[r["frame_index"]] = got.get(r["frame_index"], b"") + bytes(r["data"])
        assert got == want
        packets = spark.createDataFrame([(1, f, bytearray(d)) for f, d in got.items()], "stream_id long, frame_index long, payload binary")
        packets.coalesce(1).write.parquet(str(tmp_path / "packets"))
        source = spark.readStream.schema(packets.schema).parquet(str(tmp_path / "packets"))
        q = decode_stream(source, streams).writeStream.format("parquet").option("path", str(tmp_path / "back")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
        for r in spark.read.parquet(str(tmp_path / "back")).collect():
            a = arrays[r["frame_index"]][r["plane"]][r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]
            assert r["fault"] is None and bytes(r["data"]) == a.astype("u1").tobytes()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_table_of_settings_is_spread_and_equal_records_are_made_once(spark):
    rows = spark.range(400).select(F.col("id").alias("stream_id"), F.lit(5).alias("keyframe_interval")).coalesce(1)
    streams = codec.configure_rows(rows, lambda r: StreamConfig(8 + r["stream_id"] % 3, 8, 8 + r["stream_id"] % 2))
    assert streams.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert streams.select("record").distinct().count() == 2
    got = {(r.stream_id, r.width, r.bits) for r in codec.parse_records(streams).select("stream_id", "width", "bits").collect()}
    assert got == {(i, 8 + i % 3, 8 + i % 2) for i in range(400)}
    before = codec._read_once.cache_info().misses
    record = bytes(streams.first().record)
    assert codec.config_of(record, 8, 8).width == 8 and codec.config_of(record, 9, 8).width == 9
    assert codec._read_once.cache_info().misses <= before + 1
