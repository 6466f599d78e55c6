"""Tables whose last frame is not full: every query of vectors against its SQL; values of events over 16 bits."""

import duckdb
import pytest

from lumaplan.operators.legacy import encode_legacy, legacy_streams
from lumaplan.operators.stream import StreamConfig
from lumaplan.plans.queries import QUERIES, SQL
from tests.test_queries import plain

VECTORS = [n for n in SQL if "embeddings" in SQL[n] and n.startswith(("round_trip", "legacy", "streaming", "inspect", "located", "decoder", "golomb_states", "damaged", "failed", "intra", "combined", "decoded", "total", "shared", "second"))]


def same(spark, where, table, name):
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{where}/{table}.parquet'")
    want = c.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(where)).select(*columns).collect()
    assert plain(map(tuple, got)) == plain(want.fetchall()) and got


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    where = tmp_path_factory.mktemp("vectors")
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where vec_id < 61) to '{where}/embeddings.parquet' (format parquet)")
    return where


@pytest.mark.parametrize("name", VECTORS)
def test_unfinished_last_frame(spark, vectors, name):
    same(spark, vectors, "embeddings", name)


@pytest.mark.parametrize("name", ["round_trip_420", "round_trip_rgb", "legacy_ycbcr_420"])
def test_rows_missing_inside(spark, tmp_path, name):
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where vec_id < 40 and vec_id not in (3, 4, 19, 20, 31)) to '{tmp_path}/embeddings.parquet' (format parquet)")
    same(spark, tmp_path, "embeddings", name)


def test_keyframe_that_needs_other_transitions(spark, tmp_path):
    """Of its first frame the stream's own state transitions leave no value, with or without parameters."""
    duckdb.sql(f"copy (select i as vec_id, embedding from generate_series(0, 59) as g(i) join '/root/testdata/sf0.001/embeddings.parquet' as e on e.vec_id = (433 * i + 100) % 500) to '{tmp_path}/embeddings.parquet' (format parquet)")
    same(spark, tmp_path, "embeddings", "legacy_ycbcr_444")


def test_legacy_frame_of_wrong_size_fails_alone(spark):
    c = StreamConfig(4, 2, 8, version=1, micro=0, entropy="golomb", intra=False)
    planes = spark.createDataFrame([(1, 0, 0, bytearray(8)), (1, 1, 0, bytearray(7)), (1, 2, 1, bytearray(8))], "stream_id long, frame_index long, plane int, data binary")
    got = encode_legacy(planes, legacy_streams(spark, {1: c}, 1)).orderBy("frame_index").collect()
    assert [r.payload is None for r in got] == [False, True, True]


def test_events_of_more_than_16_bits(spark, tmp_path):
    duckdb.sql(f"copy (select i as event_id, case i when 7 then 655.36 when 8 then -3.5 when 9 then 21474836.47 else cast(i * 7 % 601 as double) / 8 end as value from generate_series(0, 1499) as g(i) where i not between 300 and 420) to '{tmp_path}/events.parquet' (format parquet)")
    same(spark, tmp_path, "events", "round_trip_events")
