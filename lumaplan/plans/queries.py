"""One query for each operator or group of operators; names say what they return. SQL is written apart from the Spark code."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaplan.functions import columns as C
from lumaplan.operators import codec
from lumaplan.operators.coverage import coverage, into_views, plane_faults, profile_faults, view_faults
from lumaplan.operators.crc import combined_crc
from lumaplan.operators.joined import joined
from lumaplan.operators.legacy import encode_grids, encode_legacy, legacy_streams
from lumaplan.operators.options import DecoderOptions, decoder_option_code, encoder_option_code
from lumaplan.operators.range_coder import DEFAULT_TRANSITIONS, adaptive_transitions
from lumaplan.operators.residual import code_bits, entropy, histogram, residuals, slice_samples
from lumaplan.operators.slices import Header
from lumaplan.operators.stream import GOLOMB, RANGE, RGB, QuantSet, StreamConfig, quant_set
from lumaplan.sources.planes import event_samples, framed, halves, vector_samples, vector_samples_420, vector_samples_rgba, with_given
from lumaplan.streaming.stateful import ROCKSDB, encode_stream, shared_folder
from lumaplan.streaming.transactions import decode_ordered

#: Contexts of a small set, for queries that need more than one.
SMALL_SET = quant_set([1, 2, 4, 121], [2, 6, 120], [3, 125], [128], [128])

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(bits: int, columns: str = "64", keep: str = "true") -> str:
    top = (1 << bits) - 1
    return f"""SELECT CAST(1 AS BIGINT) AS stream_id, CAST(vec_id // 20 AS BIGINT) AS frame_index, 0 AS plane, CAST(vec_id % 20 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x,
 CAST(least(greatest(floor((CAST(embedding[i] AS DOUBLE) + 1) * {top / 2}), 0), {top}) AS INTEGER) AS v
 FROM embeddings, generate_series(1, {columns}) AS g(i) WHERE {keep}"""


_EVENTS = """SELECT CAST(2 AS BIGINT) AS stream_id, CAST(event_id // 1000 AS BIGINT) AS frame_index, 0 AS plane, CAST((event_id % 1000) // 50 AS INTEGER) AS y, CAST(event_id % 50 AS INTEGER) AS x, CAST(round(value * 100) AS INTEGER) AS v FROM events"""

#: Samples with the last of 64 columns and of 20 rows repeated behind it.
_edged = lambda bits, right, bottom: f"SELECT stream_id, frame_index, plane, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, v FROM ({_vectors(bits)}), generate_series(0, {right}) AS a(dx), generate_series(0, {bottom}) AS b(dy) WHERE (dx = 0 OR x = 63) AND (dy = 0 OR y = 19)"


def _RGBA(bits: int, planes: int) -> str:
    w = -(-64 // planes)
    return f"SELECT stream_id, frame_index, CAST(x // {w} AS INTEGER) AS plane, y, CAST(x % {w} AS INTEGER) AS x, v FROM ({_edged(bits, w * planes - 64, 0)})"


_420 = f"""SELECT * FROM ({_edged(8, 1, 1)}) UNION ALL
 SELECT stream_id, frame_index, p AS plane, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CASE WHEN p = 1 THEN v ELSE 255 - v END AS v FROM ({_edged(8, 1, 1)}), (VALUES (1), (2)) AS c(p) WHERE x % 2 = 0 AND y % 2 = 0"""

#: The last frame of events, made whole with zeros.
_FILLED_EVENTS = _EVENTS + " UNION ALL " + _EVENTS.replace("FROM events", "FROM (SELECT e AS event_id, 0.0 AS value FROM (SELECT max(event_id) AS m FROM events), generate_series(0, 999) AS g(i), LATERAL (SELECT m + 1 + i AS e) WHERE (m + 1) % 1000 > 0 AND e // 1000 = m // 1000)")


def _neighbour_sql(source: str, keys: str, width: str) -> str:
    """Six neighbours by offsets in reading order; `width` is the rectangle's width."""
    w = f"OVER (PARTITION BY {keys} ORDER BY y, x)"
    lag = lambda n: f"lag(v, CAST({n} AS INTEGER)) {w}"
    if not width.isdigit():
        raise ValueError("one width")
    n = int(width)
    return f"""SELECT *, CASE WHEN x > 0 THEN {lag(1)} WHEN y > 0 THEN {lag(n)} ELSE 0 END AS "left",
 coalesce({lag(n)}, 0) AS top,
 CASE WHEN x > 0 AND y > 0 THEN {lag(n + 1)} WHEN x = 0 AND y > 1 THEN {lag(2 * n)} ELSE 0 END AS top_left,
 CASE WHEN y = 0 THEN 0 WHEN x < {n - 1} THEN {lag(n - 1)} ELSE {lag(n)} END AS top_right,
 CASE WHEN x > 1 THEN {lag(2)} WHEN x = 1 AND y > 0 THEN {lag(n + 1)} ELSE 0 END AS far_left,
 CASE WHEN y > 1 THEN {lag(2 * n)} ELSE 0 END AS top_top FROM ({source})"""


def _residual_sql(source: str, bits: int, keys: str = "stream_id, frame_index, plane", width: str = "64", signed: bool = False) -> str:
    half, size = 1 << bits - 1, 1 << bits
    s = (lambda c: f"(CASE WHEN {c} >= 32768 THEN {c} - 65536 ELSE {c} END)") if signed else (lambda c: c)
    a, b, d = s('"left"'), s("top"), s("top_left")
    guess = f"greatest(least({a}, {b}), least(greatest({a}, {b}), {a} + {b} - {d}))"
    return f"""SELECT *, ((v - pred + {half}) % {size} + {size}) % {size} - {half} AS diff FROM (SELECT *, {guess} AS pred FROM ({_neighbour_sql(source, keys, width)}))"""


_N = '"left", top, top_left, top_right, far_left, top_top'


def _res(spark: SparkSession, sf_dir: str, bits: int = 8) -> DataFrame:
    return residuals(vector_samples(spark, sf_dir, bits), bits)


@query(f"SELECT frame_index, y, x, v, pred, diff FROM ({_residual_sql(_vectors(8), 8)})")
def residual_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _res(spark, sf_dir).select("frame_index", "y", "x", "v", "pred", "diff")


@query(f"SELECT frame_index, y, x, v, {_N} FROM ({_neighbour_sql(_vectors(8), 'stream_id, frame_index, plane', '64')})")
def neighbour_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _res(spark, sf_dir).select("frame_index", "y", "x", "v", "left", "top", "top_left", "top_right", "far_left", "top_top")


@query(f"SELECT frame_index, y, x, v, pred, diff FROM ({_residual_sql(_vectors(16), 16, signed=True)})")
def residual_signed16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(vector_samples(spark, sf_dir, 16), 16, signed16=True).select("frame_index", "y", "x", "v", "pred", "diff")


@query(f"SELECT frame_index, y, x, v, pred, diff FROM ({_residual_sql(_EVENTS, 16, width='50')})")
def residual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(event_samples(spark, sf_dir), 16).select("frame_index", "y", "x", "v", "pred", "diff")


_SLICED = f"""SELECT stream_id, frame_index, plane, sy * 4 + sx AS slice_index, y - sy * 10 AS y, x - sx * 16 AS x, v FROM (SELECT *, CAST(y // 10 AS INTEGER) AS sy, CAST(x // 16 AS INTEGER) AS sx FROM ({_vectors(8)}))"""


@query(f"SELECT frame_index, slice_index, y, x, v, diff FROM ({_residual_sql(_SLICED, 8, 'stream_id, frame_index, plane, slice_index', '16')})")
def residual_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = spark.createDataFrame([(1, 64, 20, 4, 2, 0, 0, False, 0)], "stream_id long, width long, height long, num_h long, num_v long, log2_h int, log2_v int, chroma boolean, colorspace int")
    s = slice_samples(vector_samples(spark, sf_dir), streams)
    return residuals(s, 8, ("stream_id", "frame_index", "plane", "slice_index")).select("frame_index", "slice_index", "y", "x", "v", "diff")


@query(f"SELECT frame_index, diff, count(*) AS n FROM ({_residual_sql(_vectors(8), 8)}) GROUP BY ALL")
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(_res(spark, sf_dir), "frame_index")


@query(f"""SELECT frame_index, CAST(sum(n) AS BIGINT) AS samples, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits, round(sum(CASE WHEN diff = 0 THEN n ELSE 0 END) / sum(n), 6) AS zero_share
 FROM (SELECT frame_index, diff, count(*) AS n FROM ({_residual_sql(_vectors(8), 8)}) GROUP BY ALL) GROUP BY frame_index""")
def residual_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy(_res(spark, sf_dir), "frame_index")


_FOLD = "(CASE WHEN diff >= 0 THEN 2 * diff ELSE -2 * diff - 1 END)"


@query("SELECT frame_index, " + ", ".join(f"CAST(sum(CASE WHEN ({_FOLD} >> {k}) < 12 THEN ({_FOLD} >> {k}) + 1 + {k} ELSE 20 END) AS BIGINT) AS bits_k{k}" for k in range(8)) + f" FROM ({_residual_sql(_vectors(8), 8)}) GROUP BY frame_index")
def golomb_code_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_bits(_res(spark, sf_dir), 8, 7, "frame_index")


@query(f"SELECT frame_index, y, x, diff, {_FOLD} AS folded, diff AS unfolded FROM ({_residual_sql(_vectors(8), 8)})")
def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _res(spark, sf_dir).withColumn("folded", C.fold(F.col("diff")))
    return r.select("frame_index", "y", "x", "diff", "folded", C.unfold(F.col("folded")).alias("unfolded"))


def _table_sql(gradient: str, bounds: list[int], scale: int) -> str:
    """The quantised gradient: runs' ends as bounds over 0..127, mirrored with the opposite sign; 128 counts as -127."""
    g = f"((({gradient}) % 256 + 256) % 256)"
    level = lambda v: "CASE " + " ".join(f"WHEN {v} < {b} THEN {i * scale}" for i, b in enumerate(bounds)) + " END"
    return f"(CASE WHEN {g} < 128 THEN ({level(g)}) WHEN {g} = 128 THEN -({level('127')}) ELSE -({level(f'(256 - {g})')}) END)"


_SUM = " + ".join(_table_sql(g, b, s) for g, b, s in (('"left" - top_left', [1, 3, 7, 128], 1), ("top_left - top", [2, 8, 128], 7), ("top - top_right", [3, 128], 35)))


@query(f"SELECT frame_index, y, x, abs(s) AS context, s < 0 AS invert, CASE WHEN s < 0 THEN -d ELSE d END AS diff FROM (SELECT frame_index, y, x, diff AS d, {_SUM} AS s FROM ({_residual_sql(_vectors(8), 8)}))")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residuals(vector_samples(spark, sf_dir), 8, tables=SMALL_SET.tables)
    return r.select("frame_index", "y", "x", "context", "invert", "diff")


def _rgb(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    s = vector_samples_rgba(spark, sf_dir, bits, 3)
    return s.groupBy("frame_index", "y", "x").agg(*(F.max(F.when(F.col("plane") == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")))


def _rct_sql(bits: int, extra: bool, inverse: bool = False) -> str:
    src = f"SELECT frame_index, y, x, max(v) FILTER (plane = 0) AS r, max(v) FILTER (plane = 1) AS g, max(v) FILTER (plane = 2) AS b FROM ({_RGBA(bits, 3)}) GROUP BY frame_index, y, x"
    base, u, v = ("b", "(g - b)", "(r - b)") if 9 <= bits <= 15 and not extra else ("g", "(b - g)", "(r - g)")
    return f"SELECT frame_index, y AS row, x AS col, r, g, b, CAST({base} + floor(({u} + {v}) / 4.0) AS INTEGER) AS luma, {u} + {1 << bits} AS cb, {v} + {1 << bits} AS cr FROM ({src})"


def _rct(spark: SparkSession, sf_dir: str, bits: int, extra: bool) -> DataFrame:
    y, cb, cr = C.forward_rct(F.col("r"), F.col("g"), F.col("b"), bits, extra)
    return _rgb(spark, sf_dir, bits).select("frame_index", F.col("y").alias("row"), F.col("x").alias("col"), "r", "g", "b", y.cast("int").alias("luma"), cb.alias("cb"), cr.alias("cr"))


@query(_rct_sql(8, False))
def colour_forward_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rct(spark, sf_dir, 8, False)


@query(_rct_sql(10, False))
def colour_forward_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rct(spark, sf_dir, 10, False)


@query(_rct_sql(10, True))
def colour_forward_10_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rct(spark, sf_dir, 10, True)


@query(" UNION ALL ".join(f"SELECT {b} AS bits, {e} AS extra, frame_index, row, col, r, g, b FROM ({_rct_sql(b, e)})" for b, e in ((8, False), (10, False), (10, True), (16, False))))
def colour_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for bits, extra in ((8, False), (10, False), (10, True), (16, False)):
        f = _rct(spark, sf_dir, bits, extra)
        r, g, b = C.inverse_rct(F.col("luma"), F.col("cb"), F.col("cr"), bits, extra)
        f = f.select(F.lit(bits).alias("bits"), F.lit(extra).alias("extra"), "frame_index", "row", "col", r.alias("r"), g.alias("g"), b.alias("b"))
        out = f if out is None else out.unionByName(f)
    return out


# Geometry: streams out of the part table, one a part.
_STREAMS_SQL = """SELECT p_partkey AS stream_id, CAST(p_size * 7 + 1 AS BIGINT) AS width, CAST(p_size * 5 + p_partkey % 11 + 1 AS BIGINT) AS height, CAST(p_partkey % 18 AS INTEGER) AS bits, CAST(p_partkey % 2 AS INTEGER) AS colorspace, p_partkey % 3 <> 0 AS chroma, p_partkey % 5 = 0 AS extra,
 CAST(p_partkey % 4 // 2 AS INTEGER) AS log2_h, CAST(p_partkey % 8 // 4 AS INTEGER) AS log2_v, CAST(p_partkey % 6 AS BIGINT) AS num_h, CAST(p_partkey % 7 + 1 AS BIGINT) AS num_v FROM part"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as stream_id", "cast(p_size * 7 + 1 as bigint) as width", "cast(p_size * 5 + p_partkey % 11 + 1 as bigint) as height", "cast(p_partkey % 18 as int) as bits", "cast(p_partkey % 2 as int) as colorspace", "p_partkey % 3 <> 0 as chroma", "p_partkey % 5 = 0 as extra", "cast(p_partkey % 4 div 2 as int) as log2_h", "cast(p_partkey % 8 div 4 as int) as log2_v", "cast(p_partkey % 6 as bigint) as num_h", "cast(p_partkey % 7 + 1 as bigint) as num_v")


_SUB = lambda e, s: f"CAST(ceil({e} / CAST(1 << {s} AS DOUBLE)) AS BIGINT)"
_PLANE_SQL = f"""SELECT stream_id, bits, colorspace, chroma, extra, num_h, num_v, width, height, p AS plane, 1 + CASE WHEN chroma THEN 2 ELSE 0 END + CASE WHEN extra THEN 1 ELSE 0 END AS planes,
 CASE WHEN chroma AND p IN (1, 2) AND colorspace = 0 THEN {_SUB('width', 'log2_h')} ELSE width END AS plane_width, CASE WHEN chroma AND p IN (1, 2) AND colorspace = 0 THEN {_SUB('height', 'log2_v')} ELSE height END AS plane_height
 FROM ({_STREAMS_SQL}), (VALUES (0), (1), (2), (3)) AS c(p)"""


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _streams(spark, sf_dir).withColumn("planes", C.coded_plane_count(F.col("chroma"), F.col("extra")))
    s = s.withColumn("plane", F.explode(F.sequence(F.lit(0), F.col("planes") - 1)))
    sub = F.col("chroma") & F.col("plane").isin(1, 2) & (F.col("colorspace") == 0)
    return s.withColumns({"plane_width": F.when(sub, C.subsampled(F.col("width"), F.col("log2_h"))).otherwise(F.col("width")), "plane_height": F.when(sub, C.subsampled(F.col("height"), F.col("log2_v"))).otherwise(F.col("height"))})


@query(f"""SELECT stream_id, plane, plane_width, plane_height, CASE WHEN bits <= 8 THEN 1 ELSE 2 END AS sample_bytes, CASE WHEN plane = 0 THEN 0 WHEN chroma AND plane <= 2 THEN 1 ELSE 2 END AS slot_v3, CASE WHEN plane = 0 THEN 0 WHEN chroma AND plane <= 2 THEN 1 WHEN chroma THEN 2 ELSE 1 END AS slot_v4,
 2 + CASE WHEN extra THEN 1 ELSE 0 END AS slots_v3 FROM ({_PLANE_SQL}) WHERE plane < planes""")
def plane_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    three, four = F.lit(3), F.lit(4)
    return _planes(spark, sf_dir).select("stream_id", "plane", "plane_width", "plane_height", C.sample_bytes(F.col("bits")).alias("sample_bytes"), C.plane_slot(F.col("plane"), F.col("chroma"), three).alias("slot_v3"), C.plane_slot(F.col("plane"), F.col("chroma"), four).alias("slot_v4"), C.slot_count(F.col("chroma"), F.col("extra"), three).alias("slots_v3"))


@query(f"""SELECT stream_id, plane, cx, cy, cx * plane_width // num_h AS x, cy * plane_height // num_v AS y, (cx + 1) * plane_width // num_h - cx * plane_width // num_h AS w, (cy + 1) * plane_height // num_v - cy * plane_height // num_v AS h
 FROM ({_PLANE_SQL}), generate_series(0, 5) AS a(cx), generate_series(0, 7) AS b(cy) WHERE plane < planes AND cx < num_h AND cy < num_v""")
def slice_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _planes(spark, sf_dir).where("num_h > 0")
    p = p.withColumn("cx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_h") - 1))).withColumn("cy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_v") - 1)))
    at = lambda i, extent, n: C.grid_boundary(F.col(i), F.col(extent), F.col(n))
    after = lambda i, extent, n: C.grid_boundary(F.col(i) + 1, F.col(extent), F.col(n))
    x, y = at("cx", "plane_width", "num_h"), at("cy", "plane_height", "num_v")
    return p.select("stream_id", "plane", "cx", "cy", x.alias("x"), y.alias("y"), (after("cx", "plane_width", "num_h") - x).alias("w"), (after("cy", "plane_height", "num_v") - y).alias("h"))


@query(f"""SELECT stream_id, CASE WHEN bits NOT BETWEEN 1 AND 16 THEN 'bits' WHEN colorspace = 1 AND (NOT chroma OR log2_h > 0 OR log2_v > 0) THEN 'rgb' WHEN NOT chroma AND (log2_h > 0 OR log2_v > 0) THEN 'subsampling without chroma'
 WHEN (log2_h, log2_v) NOT IN ((0, 0), (1, 0), (1, 1)) THEN 'subsampling' WHEN num_h < 1 THEN 'grid' WHEN width * height > 101376 AND num_h * num_v < 4 THEN 'slices'
 WHEN num_h > width OR num_v > height OR (chroma AND colorspace = 0 AND (num_h > {_SUB('width', 'log2_h')} OR num_v > {_SUB('height', 'log2_v')})) THEN 'empty cell' END AS fault FROM ({_STREAMS_SQL})""")
def stream_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_faults(_streams(spark, sf_dir)).select("stream_id", "fault")


@query(f"""SELECT frame_index, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, count(*) AS n, CAST((max(x) + 1) * (max(y) + 1) - count(DISTINCT y * 1000 + x) AS BIGINT) AS missing, CAST(count(*) - count(DISTINCT y * 1000 + x) AS BIGINT) AS doubled, CAST(sum(CASE WHEN v > 1023 THEN 1 ELSE 0 END) AS BIGINT) AS "over"
 FROM ({_EVENTS}) GROUP BY frame_index""")
def sample_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_faults(event_samples(spark, sf_dir), 10).drop("stream_id", "plane")


_RECTS_SQL = """SELECT s_nationkey AS stream_id, s_suppkey % 3 AS frame_index, s_suppkey % 4 AS rx, s_suppkey // 4 % 4 AS ry, 1 + s_suppkey % 2 * (1 - s_suppkey % 4 // 3) AS rw, 1 AS rh FROM supplier"""


@query(f"""SELECT stream_id, frame_index, CAST(16 AS BIGINT) AS cells, count(*) AS covered, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS overlapping, CASE WHEN count(*) < 16 THEN 'open' WHEN max(n) > 1 THEN 'overlap' ELSE 'exact' END AS verdict
 FROM (SELECT CAST(stream_id AS BIGINT) AS stream_id, CAST(frame_index AS BIGINT) AS frame_index, cx, ry, count(*) AS n FROM ({_RECTS_SQL}), generate_series(0, 4) AS g(cx) WHERE cx >= rx AND cx < rx + rw GROUP BY ALL) GROUP BY stream_id, frame_index""")
def slice_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_nationkey as bigint) as stream_id", "s_suppkey % 3 as frame_index", "s_suppkey % 4 as raster_x", "s_suppkey div 4 % 4 as raster_y", "1 + s_suppkey % 2 * (1 - s_suppkey % 4 div 3) as raster_w", "cast(1 as bigint) as raster_h")
    streams = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as bigint) as stream_id", "cast(64 as bigint) as width", "cast(64 as bigint) as height", "cast(4 as bigint) as num_h", "cast(4 as bigint) as num_v")
    return coverage(s, streams)


# Round trips: what comes back is summed up as the source is in SQL.
_DIGEST = "SELECT frame_index, plane, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(CAST(v AS BIGINT) * (y * 1000 + x + 1)) AS BIGINT) AS weighted FROM ({}) GROUP BY frame_index, plane"


def _digest(planes: DataFrame, source: DataFrame) -> DataFrame:
    """Of the samples that are in the source (see framed()): what makes its last frame whole does not count."""
    s = codec.unpacked(with_given(planes, source))
    return s.groupBy("frame_index", "plane").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v").cast("long") * (F.col("y") * 1000 + F.col("x") + 1)).alias("weighted"))


def _there_and_back(spark: SparkSession, samples: DataFrame, config: StreamConfig, interval: int = 1, regular: bool = True) -> DataFrame:
    streams = codec.configure(spark, {1: config}, interval)
    planes = framed(samples, config)
    return _digest(codec.decode(codec.encode(planes, streams), streams, regular=regular), planes)


_GREY = StreamConfig(64, 20, num_h=2, num_v=2, ec=True)


@query(_DIGEST.format(_vectors(8)))
def round_trip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, vector_samples(spark, sf_dir), _GREY)


@query(_DIGEST.format(_vectors(10)))
def round_trip_golomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, vector_samples(spark, sf_dir, 10), StreamConfig(64, 20, 10, num_h=2, num_v=2, entropy=GOLOMB))


@query(_DIGEST.format(_vectors(16)))
def round_trip_16_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, vector_samples(spark, sf_dir, 16), StreamConfig(64, 20, 16))


@query(_DIGEST.format(_RGBA(8, 3)))
def round_trip_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, vector_samples_rgba(spark, sf_dir, 8, 3), StreamConfig(22, 20, 8, RGB, True, entropy=RANGE))


@query(_DIGEST.format(_RGBA(10, 4)))
def round_trip_rgba_golomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, vector_samples_rgba(spark, sf_dir, 10), StreamConfig(16, 20, 10, RGB, True, True, num_h=2, entropy=GOLOMB, ec=True))


@query(_DIGEST.format(_420))
def round_trip_420(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, vector_samples_420(spark, sf_dir), StreamConfig(65, 21, 8, chroma=True, log2_h=1, log2_v=1, num_h=3, num_v=2, ec=True))


@query(_DIGEST.format(_vectors(8)))
def round_trip_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, vector_samples(spark, sf_dir), _GREY, 5)


@query(_DIGEST.format(_vectors(8)))
def round_trip_found_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, vector_samples(spark, sf_dir), StreamConfig(64, 20, num_h=2, entropy=GOLOMB), 4, regular=False)


@query(_DIGEST.format(_FILLED_EVENTS))
def round_trip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values may need more than 16 bits: their high half is an extra plane, and both are summed as one."""
    c = StreamConfig(50, 20, 16, extra=True, num_h=2, num_v=2)
    streams, planes = codec.configure(spark, {2: c}), framed(halves(event_samples(spark, sf_dir, filled=True)), c)
    high, v = F.col("plane") == 1, F.col("v").cast("long")
    s = codec.unpacked(with_given(codec.decode(codec.encode(planes, streams), streams), planes))
    s = s.withColumn("v", F.when(high, (v - F.when(v > 32767, 65536).otherwise(0)) * 65536).otherwise(v))
    return s.groupBy("frame_index").agg(F.lit(0).alias("plane"), F.count(F.when(~high, 1)).alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v") * (F.col("y") * 1000 + F.col("x") + 1)).alias("weighted"))


def _planes_of(spark: SparkSession, sf_dir: str, config: StreamConfig = _GREY) -> DataFrame:
    return framed(vector_samples(spark, sf_dir, config.bits), config)


def _in_source(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of a trace of four slices whose samples are in the source."""
    s = F.col("slice_index")
    place = (F.col("y") + F.floor(s / 2).cast("int") * 10) * 64 + F.col("x") + s % 2 * 32
    return with_given(rows, source).where(F.col("given").isNull() | F.array_contains("given", place))


def _packets(spark: SparkSession, sf_dir: str, config: StreamConfig = _GREY, interval: int = 5):
    streams = codec.configure(spark, {1: config}, interval)
    return codec.encode(_planes_of(spark, sf_dir, config), streams), streams


@query("SELECT CAST(vec_id // 20 AS BIGINT) AS frame_index, vec_id // 20 % 5 = 0 AS keyframe, 4 AS slice_count, 1 AS plane_count, 'Y' AS role, 'u8' AS sample_format, CAST(64 AS BIGINT) AS width, CAST(20 AS BIGINT) AS height, 3 AS version, 4 AS micro_version FROM embeddings GROUP BY ALL")
def inspect_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = codec.inspect(*_packets(spark, sf_dir))
    return p.select("frame_index", "keyframe", "slice_count", "plane_count", F.col("planes")[0]["role"].alias("role"), F.col("planes")[0]["sample_format"].alias("sample_format"), "width", "height", "version", "micro_version")


@query("SELECT DISTINCT CAST(vec_id // 20 AS BIGINT) AS frame_index, CAST(s AS INTEGER) AS slice_index, CAST(s % 2 AS BIGINT) AS raster_x, CAST(s // 2 AS BIGINT) AS raster_y, CAST(s % 2 * 32 AS BIGINT) AS x, CAST(s // 2 * 10 AS BIGINT) AS y, CAST(32 AS BIGINT) AS w, CAST(10 AS BIGINT) AS h, true AS linked FROM embeddings, generate_series(0, 3) AS g(s)")
def located_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linked: the slice ends where the next begins."""
    p = codec.inspect(*_packets(spark, sf_dir)).select("frame_index", F.posexplode("slices").alias("i", "s"), "slices")
    nxt = F.coalesce(F.get("slices", F.col("i") + 1)["payload_offset"], F.col("s.footer_offset") + 8)
    return p.select("frame_index", "s.slice_index", "s.raster_x", "s.raster_y", "s.x", "s.y", "s.w", "s.h", ((F.col("s.footer_offset") + 8 == nxt) & (F.col("s.payload_offset") + F.col("s.slice_size") == F.col("s.footer_offset"))).alias("linked"))


@query(f"SELECT frame_index, slice_index, y, x, 0 AS context, diff FROM ({_residual_sql(_SLICED.replace('sy * 4', 'sy * 2').replace('x // 16', 'x // 32').replace('sx * 16', 'sx * 32'), 8, 'stream_id, frame_index, plane, slice_index', '32')})")
def decoder_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the decoder reads is what the window expressions say the encoder wrote."""
    return _in_source(codec.trace(*_packets(spark, sf_dir)), _planes_of(spark, sf_dir)).select("frame_index", "slice_index", "y", "x", "context", "diff")


_HALF_SLICES = _residual_sql(_SLICED.replace("sy * 4", "sy * 2").replace("x // 16", "x // 32").replace("sx * 16", "sx * 32"), 8, "stream_id, frame_index, plane, slice_index", "32")


@query(f"""WITH RECURSIVE d AS (SELECT frame_index, slice_index, y, x, v, CAST(diff AS BIGINT) AS diff, row_number() OVER (PARTITION BY frame_index, slice_index ORDER BY y, x) AS n FROM ({_HALF_SLICES}) WHERE diff <> 0),
s AS (SELECT frame_index, slice_index, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS drift, CAST(4 AS BIGINT) AS error_sum, CAST(0 AS BIGINT) AS bias, CAST(1 AS BIGINT) AS seen FROM (SELECT DISTINCT frame_index, slice_index FROM d)
 UNION ALL
 SELECT frame_index, slice_index, n + 1, CASE WHEN dr <= -c THEN greatest(dr + c, 1 - c) WHEN dr > 0 THEN least(dr - c, 0) ELSE dr END, er, CASE WHEN dr <= -c THEN greatest(bias - 1, -128) WHEN dr > 0 THEN least(bias + 1, 127) ELSE bias END, c
 FROM (SELECT *, CASE WHEN seen = 128 THEN 65 ELSE seen + 1 END AS c, CAST(CASE WHEN seen = 128 THEN floor((drift + e) / 2.0) ELSE drift + e END AS BIGINT) AS dr, CASE WHEN seen = 128 THEN (error_sum + abs(e)) // 2 ELSE error_sum + abs(e) END AS er
  FROM (SELECT s.*, ((diff - CASE WHEN diff > 0 THEN 1 ELSE 0 END - bias + 384) % 256) - 128 AS e FROM s JOIN d USING (frame_index, slice_index, n))))
SELECT frame_index, slice_index, y, x, CAST(v AS INTEGER) AS sample, CAST(diff AS INTEGER) AS diff, CAST(drift AS INTEGER) AS drift, CAST(error_sum AS INTEGER) AS error_sum, CAST(bias AS INTEGER) AS bias, CAST(seen AS INTEGER) AS count,
 CAST(CASE WHEN error_sum <= seen THEN 0 ELSE length(bin((error_sum + seen - 1) // seen - 1)) END AS INTEGER) AS k FROM s JOIN d USING (frame_index, slice_index, n)""")
def golomb_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the one context of a slice has seen before each sample that is coded by itself, and the parameter that follows from it."""
    t = _in_source(codec.trace(*_packets(spark, sf_dir, replace(_GREY, entropy=GOLOMB), 1)), _planes_of(spark, sf_dir))
    return t.where("diff <> 0").select("frame_index", "slice_index", "y", "x", "sample", "diff", "drift", "error_sum", "bias", "count", "k")


def _part_config(r: dict) -> StreamConfig:
    i = r["stream_id"]
    return StreamConfig(64 + i % 48, 20 + r["p_size"], 1 + i % 16, i % 2, True, i % 3 == 0, 0, 0, 1 + i % 4, 1 + i % 3, (RANGE, GOLOMB)[i % 4 // 2], i % 5 == 0)


@query("""SELECT CAST(i AS BIGINT) AS stream_id, CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS code, v.* FROM (SELECT p_partkey AS i, p_size FROM part) LEFT JOIN LATERAL (SELECT 3 AS version, CASE WHEN i % 4 < 2 THEN 'range' ELSE 'golomb' END AS entropy_mode, CAST(1 + i % 16 AS INTEGER) AS bits, CAST(i % 2 AS INTEGER) AS colorspace,
 i % 3 = 0 AS extra, CAST(1 + i % 4 AS BIGINT) AS num_h, CAST(1 + i % 3 AS BIGINT) AS num_v, i % 5 = 0 AS ec, CAST(64 + i % 48 AS BIGINT) AS width, CAST(20 + p_size AS BIGINT) AS height WHERE i % 7 <> 0) v ON true""")
def configuration_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each part, its settings derived from the row; every seventh asks for no keyframe interval and is refused."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("stream_id"), "p_size", F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(5).alias("keyframe_interval"))
    streams = codec.configure_rows(parts, _part_config)
    facts = codec.parse_records(streams.where("record is not null")).select("stream_id", "version", "entropy_mode", "bits", "colorspace", "extra", "num_h", "num_v", "ec", "width", "height")
    return streams.select("stream_id", "status.code").join(facts, "stream_id", "left")


@query("SELECT CAST(vec_id // 20 AS BIGINT) AS frame_index, CASE WHEN vec_id // 20 % 3 = 1 THEN 5 ELSE 0 END AS code, CASE WHEN vec_id // 20 % 3 = 1 THEN 3 END AS slice_index FROM embeddings GROUP BY ALL")
def damaged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame has a byte of its last slice changed: the CRC tells, and the status names frame and slice."""
    packets, streams = _packets(spark, sf_dir, interval=1)
    n = F.length("payload") - 12
    byte = F.when(F.hex(F.substring("payload", n, F.lit(1))) == "00", F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    broken = F.concat(F.substring("payload", F.lit(1), n - 1), byte, F.substring("payload", n + 1, F.lit(12)))
    packets = packets.withColumn("payload", F.when(F.col("frame_index") % 3 == 1, broken).otherwise(F.col("payload")))
    return codec.inspect(packets, streams).select("frame_index", "status.code", "status.slice_index")


@query("SELECT CAST(vec_id // 20 AS BIGINT) AS frame_index, CASE WHEN vec_id // 20 = 2 THEN 1 ELSE 0 END AS code FROM embeddings GROUP BY ALL")
def sample_over_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample over the bit depth fails its frame alone."""
    s = vector_samples(spark, sf_dir, 10).withColumn("v", F.when((F.col("frame_index") == 2) & (F.col("y") == 3) & (F.col("x") == 5), 1024).otherwise(F.col("v")))
    c = StreamConfig(64, 20, 10, num_h=2, num_v=2)
    streams = codec.configure(spark, {1: c})
    return codec.encode(framed(s, c), streams).select("frame_index", "status.code")


@query()
def compressed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each frame by entropy coder."""
    out = None
    for mode in (RANGE, GOLOMB):
        packets, _ = _packets(spark, sf_dir, StreamConfig(64, 20, entropy=mode), 1)
        p = packets.select(F.lit(mode).alias("entropy_mode"), "frame_index", "keyframe", F.length("payload").alias("bytes"))
        out = p if out is None else out.unionByName(p)
    return out


@query(f"SELECT frame_index, y, x, pred, diff, v FROM ({_residual_sql(_vectors(8), 8)})")
def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction and difference give the sample back."""
    return _res(spark, sf_dir).select("frame_index", "y", "x", "pred", "diff", C.reconstruct(F.col("pred"), F.col("diff"), 8).alias("v"))


# Streams with quant tables, initial states and state transitions of their own.
_FIRST = tuple(bytes(96 + (7 * i + 3 * j) % 64 for j in range(32)) for i in range(SMALL_SET.contexts))
_OWN = StreamConfig(64, 20, num_h=2, num_v=2, ec=True, quant_sets=(SMALL_SET, QuantSet()), initial=(_FIRST, None), transitions=adaptive_transitions(0.04))


@query(_DIGEST.format(_vectors(8)))
def round_trip_own_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = codec.configure(spark, {1: _OWN}, 5, public=False)
    planes = _planes_of(spark, sf_dir)
    return _digest(codec.decode(codec.encode(planes, streams), streams), planes)


@query(_DIGEST.format(_vectors(8)))
def round_trip_own_tables_golomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = codec.configure(spark, {1: replace(_OWN, entropy=GOLOMB, initial=(), transitions=DEFAULT_TRANSITIONS)}, 5, public=False)
    planes = _planes_of(spark, sf_dir)
    return _digest(codec.decode(codec.encode(planes, streams), streams), planes)


def _supplier_config(r: dict) -> StreamConfig:
    """A stream with tables and first states of its own for each supplier."""
    return _own_tables(r["stream_id"] % 40)


@lru_cache(maxsize=40)
def _own_tables(k: int) -> StreamConfig:
    q = quant_set([1, 2 + k, 4 + k, 121 - 2 * k], [2, 6 + k, 120 - k], [3, 125], [128], [128])
    return replace(_OWN, quant_sets=(q, QuantSet()), initial=(tuple(bytes(96 + (7 * i + 3 * j + k) % 64 for j in range(32)) for i in range(q.contexts)), None))


def _supplier_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.configure_rows(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("stream_id"), F.lit(5).alias("keyframe_interval")), _supplier_config, public=False)


#: Where each table's runs end, for k = s_suppkey % 40, and by how much a run is more than the one before.
_SUPPLIER_BOUNDS = [(["1", "3 + k", "7 + 2 * k", "128"], 1), (["2", "8 + k", "128"], 7), (["3", "128"], 35), (["128"], 105), (["128"], 105)]


@query(" UNION ALL ".join(f"SELECT s_suppkey AS stream_id, {q} AS quant_set, {t} AS \"table\", CAST(i AS INTEGER) AS i, CAST({_table_sql('i', b, s if q == 0 else 0)} AS INTEGER) AS value FROM (SELECT s_suppkey, s_suppkey % 40 AS k FROM supplier), generate_series(0, 255) AS g(i)" for q in range(2) for t, (b, s) in enumerate(_SUPPLIER_BOUNDS)))
def record_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run lengths of each supplier's record expand to."""
    return codec.record_tables(_supplier_streams(spark, sf_dir))


@query(f"SELECT s_suppkey AS stream_id, 0 AS quant_set, CAST(i AS INTEGER) AS context, CAST(j AS INTEGER) AS place, CAST(96 + (7 * i + 3 * j + s_suppkey % 40) % 64 AS INTEGER) AS state FROM supplier, generate_series(0, {SMALL_SET.contexts - 1}) AS a(i), generate_series(0, 31) AS b(j)")
def record_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first states that each supplier's record brings along."""
    return codec.record_states(_supplier_streams(spark, sf_dir))


# Frames of versions 0 and 1.
def _legacy(version: int, entropy: str, colorspace: int = 0) -> StreamConfig:
    return StreamConfig(22 if colorspace else 64, 20, 8, colorspace, colorspace == RGB, version=version, micro=0, entropy=entropy, intra=False)


def _legacy_trip(spark: SparkSession, samples: DataFrame, c: StreamConfig, embed: bool) -> DataFrame:
    """Noise makes the last frame whole: of zeros the arithmetic of range coded YCbCr could say few."""
    streams = legacy_streams(spark, {1: c}, 5)
    planes = framed(samples, c, lambda y, x: (x * 151 + y * 59 + x * y * 7) % 256)
    return _digest(codec.decode(encode_legacy(planes, streams, embed), streams), planes)


@query(_DIGEST.format(_RGBA(8, 3)))
def legacy_range_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy_trip(spark, vector_samples_rgba(spark, sf_dir, 8, 3), _legacy(0, RANGE, RGB), True)


@query(_DIGEST.format(_RGBA(8, 3)))
def legacy_range_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy_trip(spark, vector_samples_rgba(spark, sf_dir, 8, 3), _legacy(1, RANGE, RGB), False)


def _low_byte(samples: str) -> str:
    return f"SELECT stream_id, frame_index, plane, y, x, CAST(v % 256 AS INTEGER) AS v FROM ({samples})"


@query(_DIGEST.format(_low_byte(_RGBA(16, 3))))
def legacy_ycbcr_444(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1, range coder: rows of the planes take turns, chroma has half the range as border, and zero symbols raise low by one.
    The samples are low bytes: smooth ones have many zero symbols, and then more frames need other state transitions (see encode_legacy())."""
    s = vector_samples_rgba(spark, sf_dir, 16, 3).withColumn("v", F.col("v") % 256)
    return _legacy_trip(spark, s, replace(_legacy(1, RANGE), width=22, chroma=True), False)


#: All samples as luma, those of even places as the first chroma plane, those of odd ones as the second.
_HALVES = " UNION ALL ".join(f"SELECT stream_id, frame_index, {p} AS plane, CAST(y // {d} AS INTEGER) AS y, CAST(x // {d} AS INTEGER) AS x, v FROM ({_vectors(16)}) WHERE x % {d} = {o} AND y % {d} = {o}" for p, d, o in ((0, 1, 0), (1, 2, 0), (2, 2, 1)))


@query(_DIGEST.format(_low_byte(_HALVES)))
def legacy_ycbcr_420(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of version 0, with subsampled chroma: plane after plane."""
    s = vector_samples(spark, sf_dir, 16).withColumn("v", F.col("v") % 256)
    half = lambda p, odd: s.where((F.col("x") % 2 == odd) & (F.col("y") % 2 == odd)).withColumns({"plane": F.lit(p), "y": F.floor(F.col("y") / 2).cast("int"), "x": F.floor(F.col("x") / 2).cast("int")})
    return _legacy_trip(spark, s.unionByName(half(1, 0)).unionByName(half(2, 1)), replace(_legacy(0, RANGE), chroma=True, log2_h=1, log2_v=1), True)


@query(_DIGEST.format(_vectors(8)))
def legacy_golomb_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy_trip(spark, vector_samples(spark, sf_dir), _legacy(0, GOLOMB), False)


@query(_DIGEST.format(_vectors(8)))
def legacy_golomb_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy_trip(spark, vector_samples(spark, sf_dir), _legacy(1, GOLOMB), True)


@query("""SELECT CAST(s AS BIGINT) AS stream_id, frame_index, CASE WHEN frame_index % 5 <> 0 THEN 'not_present' WHEN frame_index = 0 THEN 'configured' WHEN s = 2 AND frame_index % 10 = 5 THEN 'differs' ELSE 'matches' END AS result, 0 AS code
 FROM (SELECT DISTINCT CAST(vec_id // 20 AS BIGINT) AS frame_index FROM embeddings), (VALUES (1), (2)) AS c(s)""")
def legacy_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes carry parameters; every other keyframe of stream 2 those of another coder."""
    planes, out = _planes_of(spark, sf_dir), None
    for stream, other in ((1, 1), (2, 0)):
        frames = encode_legacy(planes, legacy_streams(spark, {1: _legacy(1, GOLOMB)}, 5))
        odd = encode_legacy(planes, legacy_streams(spark, {1: _legacy(other, GOLOMB)}, 5))
        frames = frames.where(F.col("frame_index") % 10 != 5).unionByName(odd.where(F.col("frame_index") % 10 == 5)).withColumn("stream_id", F.lit(stream).cast("long"))
        out = frames if out is None else out.unionByName(frames)
    sizes = spark.createDataFrame([(1, 64, 20), (2, 64, 20)], "stream_id long, width long, height long")
    # Frames that are no keyframes start with the range coder's keyframe bit 0, as a bootstrap reads it.
    blank = F.when(F.col("frame_index") % 5 == 0, F.col("payload")).otherwise(F.lit(bytes(8)))
    return codec.bootstrap_frames(out.withColumn("payload", blank), sizes).select("stream_id", "frame_index", "result", "status.code")


@query("""SELECT s_suppkey AS frame_index, CAST(s AS INTEGER) AS slice_index, CAST(CASE WHEN s_suppkey % 3 = 0 AND s = 2 OR s_suppkey % 3 = 1 AND s = 1 OR s_suppkey % 3 = 2 AND s % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS raster_x,
 CAST(CASE WHEN s_suppkey % 3 = 0 AND s > 0 OR s_suppkey % 3 = 2 AND s > 1 THEN 1 ELSE 0 END AS BIGINT) AS raster_y, CAST(CASE WHEN s_suppkey % 3 = 0 AND s = 0 THEN 2 ELSE 1 END AS BIGINT) AS raster_w, CAST(CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 1 END AS BIGINT) AS raster_h, s_suppkey % 2 = 0 AS keyframe
 FROM supplier, generate_series(0, 3) AS g(s) WHERE s < [3, 2, 4][s_suppkey % 3 + 1]""")
def legacy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of legacy frames of several slices, a frame a supplier, in three ways to cut the grid; read one after another until they
    cover the frame."""
    c = replace(_legacy(1, RANGE), num_h=2, num_v=2)
    cuts = [[(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)], [(0, 0, 1, 2), (1, 0, 1, 2)], [(0, 0, 1, 1), (1, 0, 1, 1), (0, 1, 1, 1), (1, 1, 1, 1)]]
    frames = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit(1).cast("long").alias("stream_id"), F.col("s_suppkey").alias("frame_index"), (F.col("s_suppkey") % 2 == 0).alias("keyframe"))
    frames = encode_grids(frames, c, lambda i: [Header(*cut, (0, 0)) for cut in cuts[i % 3]])
    p = codec.inspect(frames, legacy_streams(spark, {1: c}), grid=(2, 2)).select("frame_index", "keyframe", F.explode("slices").alias("s"))
    return p.select("frame_index", "s.slice_index", "s.raster_x", "s.raster_y", "s.raster_w", "s.raster_h", "keyframe")


@query("SELECT DISTINCT CAST(vec_id // 20 AS BIGINT) AS frame_index, CASE WHEN vec_id // 20 % 5 = 0 THEN 0 ELSE 3 END AS code FROM embeddings")
def intra_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of groups of five read as a stream that promises keyframes only."""
    packets, _ = _packets(spark, sf_dir)
    return codec.inspect(packets, codec.configure(spark, {1: _GREY}, 1)).select("frame_index", "status.code")


def _damaged(packets: DataFrame, which: Column) -> DataFrame:
    """A byte of the last slice of some frames is another one."""
    n = F.length("payload") - 12
    byte = F.when(F.hex(F.substring("payload", n, F.lit(1))) == "00", F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    broken = F.concat(F.substring("payload", F.lit(1), n - 1), byte, F.substring("payload", n + 1, F.lit(12)))
    return packets.withColumn("payload", F.when(which, broken).otherwise(F.col("payload")))


@query("SELECT DISTINCT CAST(vec_id // 20 AS BIGINT) AS frame_index, CAST([0, 0, 5, 2, 2][vec_id // 20 % 5 + 1] AS INTEGER) AS code FROM embeddings")
def failed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third frame of each group is damaged: it fails as a whole, commits no state, and those that need it fail too."""
    packets, streams = _packets(spark, sf_dir)
    return codec.decode(_damaged(packets, F.col("frame_index") % 5 == 2), streams).select("frame_index", "status.code").distinct()


@query("SELECT DISTINCT CAST(vec_id // 20 AS BIGINT) AS frame_index, 4 AS slices, true AS adds_up FROM embeddings")
def total_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's bytes are those of its slices and their footers."""
    packets, streams = _packets(spark, sf_dir)
    sizes = codec.inspect(packets, streams).select("frame_index", F.size("slices").alias("slices"), F.aggregate("slices", F.lit(0).cast("long"), lambda a, s: a + s["slice_size"] + 8).alias("bytes"))
    return sizes.join(packets.select("frame_index", F.length("payload").alias("whole")), "frame_index").select("frame_index", "slices", (F.col("bytes") == F.col("whole")).alias("adds_up"))


@query("""SELECT p_partkey AS stream_id, CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 4 WHEN (p_partkey % 3 = 0) <> (p_partkey % 4 = 0) THEN 1 ELSE 0 END AS decoder, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 6 = 0 THEN 1 ELSE 0 END AS encoder FROM part""")
def option_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """threads below 0, relaxed parsing, one-sided sizes, no keyframe interval."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    threads, key = F.when(F.col("p_partkey") % 5 == 0, -1).otherwise(2), F.col("p_partkey")
    size = lambda n: F.when(key % n == 0, 0).otherwise(64)
    return p.select(key.alias("stream_id"), decoder_option_code(threads, key % 7 != 0, size(3), size(4)).alias("decoder"), encoder_option_code(threads, key % 6).alias("encoder"))


@query(f"""SELECT stream_id, plane, CASE WHEN stream_id % 11 = 0 THEN 'missing' WHEN stream_id % 7 = 0 THEN 'role' WHEN bits > 8 AND stream_id % 5 = 0 THEN 'format' WHEN stream_id % 3 = 0 AND plane = 0 THEN 'size' WHEN stream_id % 2 = 0 AND bits > 8 THEN 'stride' END AS fault
 FROM ({_PLANE_SQL}) WHERE plane < planes""")
def output_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output planes that a stream's planes do not fit in."""
    wanted = F.when(F.col("bits") <= 8, "u8").otherwise("u16")
    p = _planes(spark, sf_dir).select("stream_id", "plane", F.lit("Y").alias("wanted_role"), wanted.alias("wanted_format"), F.col("plane_width").alias("wanted_width"), F.col("plane_height").alias("wanted_height"))
    s = F.col("stream_id")
    views = p.withColumns({
        "role": F.when(s % 11 == 0, None).when(s % 7 == 0, "Cb").otherwise("Y"), "sample_format": F.when(s % 5 == 0, "u8").otherwise(F.col("wanted_format")), "height": F.col("wanted_height"),
        "width": F.when((s % 3 == 0) & (F.col("plane") == 0), F.col("wanted_width") - 1).otherwise(F.col("wanted_width") + 3), "stride_bytes": F.when(s % 2 == 0, F.col("wanted_width")).otherwise(F.col("wanted_width") * 2),
    })
    return view_faults(views).select("stream_id", "plane", "fault")


@query("SELECT DISTINCT CAST(vec_id // 20 AS BIGINT) AS frame_index, CAST(s AS INTEGER) AS slice_index, true AS same, CAST(0 AS BIGINT) AS frame_crc FROM embeddings, generate_series(0, 3) AS g(s)")
def combined_crcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRCs put together from those of chunks of 48 bytes: of each slice before its own CRC, which they equal, and of the whole frame,
    which is 0 as each slice ends in its CRC."""
    packets, streams = _packets(spark, sf_dir)
    chunk = lambda data: F.explode(F.transform(F.sequence(F.lit(0), F.length(data) - 1, F.lit(48)), lambda i: F.struct(i.alias("offset"), F.substring(data, i + 1, F.lit(48)).alias("data"))))
    slices = codec.inspect(packets, streams).select("frame_index", F.explode("slices").alias("s")).join(packets.select("frame_index", "payload"), "frame_index")
    own = F.substring("payload", (F.col("s.payload_offset") + 1).cast("int"), (F.col("s.footer_offset") + 4 - F.col("s.payload_offset")).cast("int"))
    parts = slices.select("frame_index", "s.slice_index", "s.crc", own.alias("bytes")).select("frame_index", "slice_index", F.col("crc").alias("told"), chunk(F.col("bytes")).alias("c")).select("frame_index", "slice_index", "told", "c.*")
    whole = combined_crc(packets.select("frame_index", chunk(F.col("payload")).alias("c")).select("frame_index", "c.*"), "frame_index")
    got = combined_crc(parts, "frame_index", "slice_index", "told").select("frame_index", "slice_index", (F.col("crc") == F.col("told")).alias("same"))
    return got.join(whole.select("frame_index", F.col("crc").alias("frame_crc")), "frame_index")


@query(_DIGEST.format(_vectors(10)))
def shared_header_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slice's content begins in its header's last byte."""
    planes, packets, streams = _ten_bits(spark, sf_dir)
    return _digest(codec.decode(joined(packets, streams, False), streams), planes)


@query(_DIGEST.format(_vectors(10)))
def second_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and only the second start that a decoder tries is the right one, in every slice that can't be read in both ways."""
    planes, packets, streams = _ten_bits(spark, sf_dir, 1)
    return _digest(codec.decode(joined(packets, streams, True), streams), planes)


def _ten_bits(spark: SparkSession, sf_dir: str, interval: int = 5):
    c = StreamConfig(64, 20, 10, num_h=2, num_v=2, entropy=GOLOMB)
    streams, planes = codec.configure(spark, {1: c}, interval), _planes_of(spark, sf_dir, c)
    return planes, codec.encode(planes, streams), streams


@query(f"""WITH p AS (SELECT frame_index % 7 AS s, * FROM ({_vectors(8)})),
f AS (SELECT 1 + s AS stream_id, frame_index, CASE WHEN s = 1 THEN 'missing' WHEN s = 2 THEN 'role' WHEN s = 3 THEN 'format' WHEN s = 4 THEN 'size' WHEN s = 5 THEN 'stride' END AS fault, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY s, frame_index)
SELECT stream_id, frame_index, fault, CASE WHEN fault IS NULL THEN CASE WHEN stream_id = 1 THEN CAST(64 * 20 AS BIGINT) ELSE 80 * 24 END END AS bytes, CASE WHEN fault IS NULL THEN total END AS total FROM f""")
def decoded_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames dealt to seven streams whose output planes fit, are wider and higher, or do not fit."""
    samples = vector_samples(spark, sf_dir).withColumn("stream_id", 1 + F.col("frame_index") % 7)
    streams = codec.configure(spark, {i: _GREY for i in range(1, 8)}, 1)
    views = spark.createDataFrame([(1, 0, "Y", "u8", 64, 20, 64), (3, 0, "Cb", "u8", 64, 20, 64), (4, 0, "Y", "u16", 64, 20, 128), (5, 0, "Y", "u8", 63, 20, 64), (6, 0, "Y", "u8", 64, 20, 63), (7, 0, "Y", "u8", 70, 24, 80)], "stream_id long, plane int, role string, sample_format string, width int, height int, stride_bytes int")
    planes = codec.decode(codec.encode(framed(samples, _GREY), streams), streams, options=DecoderOptions(width=64, height=20))
    out = into_views(planes, views)
    sums = codec.unpacked(out.where("data is not null").select("stream_id", "frame_index", "plane", F.lit(1 << 20).alias("width"), F.lit(1).alias("bytes_per_sample"), "data")).groupBy("stream_id", "frame_index").agg(F.sum("v").cast("long").alias("total"))
    return out.select("stream_id", "frame_index", "fault", F.length("data").cast("long").alias("bytes")).join(sums, ["stream_id", "frame_index"], "left")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Stateful operators of streaming queries need the RocksDB state store."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


@query(_DIGEST.format(_vectors(8)))
def streaming_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes as a stream through the stateful encoder, its slices joined to packets, and those decoded."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streams = codec.configure(spark, {1: _GREY}, 5)
    _planes_of(spark, sf_dir).write.parquet(f"{where}/planes")
    planes = spark.read.parquet(f"{where}/planes")
    with _state_store(spark):
        source = spark.readStream.schema(planes.schema).parquet(f"{where}/planes")
        q = encode_stream(source, streams).writeStream.format("parquet").option("path", f"{where}/slices").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    slices = spark.read.parquet(f"{where}/slices").groupBy("stream_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("slice_index", "data"))).alias("parts"))
    packets = slices.select("stream_id", "frame_index", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"])).alias("payload"))
    return _digest(codec.decode(packets, streams), planes)


@query(f"""WITH f AS (SELECT DISTINCT CAST(vec_id // 20 AS BIGINT) AS frame_index, CAST([0, 0, 5, 2, 2][vec_id // 20 % 5 + 1] AS INTEGER) AS damaged FROM embeddings),
c AS (SELECT frame_index, CASE WHEN frame_index // 5 % 2 = 1 THEN damaged ELSE 0 END AS code FROM f)
SELECT frame_index, code, n, total, weighted FROM c LEFT JOIN ({_DIGEST.format(_vectors(8))}) USING (frame_index) WHERE code = 0 UNION ALL SELECT frame_index, code, NULL, NULL, NULL FROM c WHERE code <> 0""")
def streaming_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that come out of order, every third one of all groups in a first batch, as a stream: what was decoded of each and its
    status. In every second group one slice of the third frame is damaged; none of that frame's slices commits."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    packets, streams = _packets(spark, sf_dir)
    packets = _damaged(packets.select("stream_id", "frame_index", "payload"), F.expr("frame_index % 5 = 2 and floor(frame_index / 5) % 2 = 1"))
    packets.write.parquet(f"{where}/coded")
    coded = spark.read.parquet(f"{where}/coded")
    for late in (2, 1, 0):
        coded.where(F.col("frame_index") % 3 == late).write.mode("append").parquet(f"{where}/packets")
    with _state_store(spark):
        source = spark.readStream.schema(coded.schema).option("maxFilesPerTrigger", 8).parquet(f"{where}/packets")
        q = decode_ordered(source, streams).writeStream.format("parquet").option("path", f"{where}/planes").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    planes = spark.read.parquet(f"{where}/planes")
    status = planes.select("frame_index", "status.code").distinct()
    return status.join(_digest(planes.where("plane is not null"), _planes_of(spark, sf_dir)).drop("plane"), "frame_index", "left")
