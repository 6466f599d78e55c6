"""Frames as transactions: any order, gaps, faults; against the batch decoder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaplan.operators import codec
from lumaplan.operators.frames import encode_frame
from lumaplan.operators.slices import Entropy
from lumaplan.operators.stream import GOLOMB, RANGE, StreamConfig, encoder_profile
from lumaplan.streaming.stateful import ROCKSDB
from lumaplan.streaming.transactions import decode_ordered, dump_state, load_state

PACKETS = "stream_id long, frame_index long, payload binary"


def coded(c, n, interval, seed):
    rng, states, out = np.random.default_rng(seed), None, []
    for f in range(n):
        planes = [np.cumsum(rng.integers(-2, 3, c.plane_size(p)[::-1]), 1) + 90 & (1 << c.bits) - 1 for p in range(c.planes)]
        data, states = encode_frame(c, planes, f % interval == 0, states)
        out.append(data)
    return out


def run(spark, tmp_path, batches, streams, **limits):
    """The rows of a query that gets the batches one by one."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PACKETS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in (tmp_path / "in").glob("*.parquet"):
            if not (tmp_path / "in" / f"{f.name}.seen").exists():
                (tmp_path / "in" / f"{f.name}.seen").touch()
                os.utime(f, (1e9 + 10 * i, 1e9 + 10 * i))
    for f in (tmp_path / "in").glob("*.seen"):
        f.rename(tmp_path / f.name)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        source = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = decode_ordered(source, streams, **limits).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.parquet(f"{tmp_path}/out")


def shown(df):
    return sorted((r["stream_id"], r["frame_index"], -1 if r["plane"] is None else r["plane"], bytes(r["data"] or b""), r["status"]["code"]) for r in df.collect())


@pytest.mark.parametrize("entropy", [RANGE, GOLOMB])
def test_late_frames_and_a_bad_slice(spark, tmp_path, entropy):
    c, interval = StreamConfig(12, 10, num_h=2, num_v=2, ec=True, entropy=entropy), 4
    packets = coded(encoder_profile(c, interval), 12, interval, 3)
    bad = bytearray(packets[5])
    bad[-10] ^= 1  # the last slice only
    packets[5] = bytes(bad)
    rows = [(1, f, bytearray(d)) for f, d in enumerate(packets)]
    streams = codec.configure(spark, {1: c}, interval)
    want = shown(codec.decode(spark.createDataFrame(rows, PACKETS), streams))
    order = [3, 7, 1, 10, 6, 2, 0, 8, 11, 5, 4, 9]
    got = shown(run(spark, tmp_path, [[rows[i] for i in order[a : a + 4]] for a in (0, 4, 8)], streams))
    assert got == want and {r[1] for r in got if r[4]} == {5, 6, 7}


def test_gaps_repeats_and_no_payload(spark, tmp_path):
    c, interval = StreamConfig(8, 6), 6
    packets = coded(encoder_profile(c, interval), 12, interval, 4)
    rows = {f: (1, f, bytearray(d)) for f, d in enumerate(packets)}
    batches = [[rows[0], rows[2]], [rows[3], rows[3], (1, 6, None)], [rows[5], rows[4], (9, 0, bytearray(b"x")), (None, 1, None)], [rows[1], rows[7]]]
    got = run(spark, tmp_path, batches, codec.configure(spark, {1: c}, interval), depth=3).collect()
    codes = sorted((r["frame_index"], r["status"]["code"]) for r in got)
    # 1 is given up once 4 waits; then it comes, too late. 3 comes twice. 6 has no payload, so 7 has no frame before it.
    assert codes == [(0, 0), (1, 1), (2, 2), (3, 1), (3, 2), (4, 2), (5, 2), (6, 1), (7, 2)]


def test_timers_end_a_gap(spark, tmp_path):
    c, interval = StreamConfig(8, 6), 3
    packets = coded(encoder_profile(c, interval), 6, interval, 5)
    rows = [(1, f, bytearray(d)) for f, d in enumerate(packets)]
    got = run(spark, tmp_path, [[rows[1], rows[2]], [rows[3]], [rows[4]], [rows[5]]], codec.configure(spark, {1: c}, interval), patience_ms=1).collect()
    assert sorted((r["frame_index"], r["status"]["code"]) for r in got) == [(1, 2), (2, 2), (3, 0), (4, 0), (5, 0)]


def test_states_round_trip():
    rng = np.random.default_rng(1)
    for entropy in (RANGE, GOLOMB):
        c = StreamConfig(8, 6, entropy=entropy)
        state = Entropy.fresh(c, (0, 0))
        if entropy == RANGE:
            state.banks = [[bytearray(rng.integers(1, 255, 32).astype("u1").tobytes()) for _ in b] for b in state.banks]
        back = load_state(c, (0, 0), dump_state(c, state))
        assert back.banks == state.banks


def test_faults_are_rows_in_the_slice_wise_streams(spark, tmp_path):
    """Planes of wrong size, number or missing, and frames that do not parse, end neither query."""
    from lumaplan.streaming.stateful import decode_stream, encode_stream

    c = StreamConfig(8, 6, num_h=2, chroma=True)
    streams = codec.configure(spark, {1: c}, 2)
    size = lambda n: bytearray(48 if n == 0 else 48)
    planes = [(1, f, p, size(p)) for f in range(8) for p in range(3)]
    planes[3] = (1, 1, 0, bytearray(31))
    planes[8] = (1, 2, 7, size(1))
    del planes[17]
    schema = "stream_id long, frame_index long, plane int, data binary"
    spark.createDataFrame(planes, schema).coalesce(1).write.parquet(f"{tmp_path}/planes")
    whole = codec.encode(spark.createDataFrame([r for r in planes if r[1] in (0, 4, 6, 7)], schema), streams).select("stream_id", "frame_index", "payload")
    whole.withColumn("payload", F.when(F.col("frame_index") == 4, F.lit(b"\x01\x02")).otherwise(F.col("payload"))).coalesce(1).write.parquet(f"{tmp_path}/packets")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for name, run_, s in (("planes", encode_stream, schema), ("packets", decode_stream, PACKETS)):
            q = run_(spark.readStream.schema(s).parquet(f"{tmp_path}/{name}"), streams).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
            assert q.awaitTermination(60) and q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    coded = {(r["frame_index"], r["slice_index"]): r["fault"] for r in spark.read.parquet(f"{tmp_path}/planes-out").collect()}
    assert {k[0] for k, v in coded.items() if v} == {1, 2, 3, 5} and len(coded) == 16
    back = spark.read.parquet(f"{tmp_path}/packets-out").collect()
    assert {r["frame_index"] for r in back if r["fault"]} == {4} and {r["frame_index"] for r in back if not r["fault"]} == {0, 6, 7}
