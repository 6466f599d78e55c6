"""Sample planes out of tables, in long form (a row a sample) or packed (a row a plane)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaplan.operators.stream import StreamConfig

SAMPLES = ["stream_id", "frame_index", "plane", "y", "x", "v"]
ROWS_A_FRAME = 20


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*SAMPLES)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, frame_index, payload: the frames of a demuxed stream."""
    return spark.read.parquet(path).select("stream_id", "frame_index", "payload")


def vector_samples(spark: SparkSession, sf_dir: str, bits: int = 8) -> DataFrame:
    """Vectors as rows of grey frames: 20 vectors a frame, [-1, 1] spread over the sample range."""
    top = (1 << bits) - 1
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 1) * (top / 2)), F.lit(0)), F.lit(top)).cast("int")
    return e.select(F.lit(1).cast("long").alias("stream_id"), F.floor(F.col("vec_id") / ROWS_A_FRAME).cast("long").alias("frame_index"), F.lit(0).alias("plane"), (F.col("vec_id") % ROWS_A_FRAME).cast("int").alias("y"), F.col("x").cast("int"), v.alias("v"))


def edged(samples: DataFrame, last: dict[str, int], more: dict[str, int]) -> DataFrame:
    """The samples with the edge repeated: `more` columns (x) or rows (y) behind the last one."""
    for at, n in more.items():
        places = F.when(F.col(at) == last[at], F.sequence(F.col(at), F.col(at) + n)).otherwise(F.array(at))
        samples = samples.withColumn(at, F.explode(places))
    return samples


def vector_samples_rgba(spark: SparkSession, sf_dir: str, bits: int = 8, planes: int = 4) -> DataFrame:
    """The columns of each vector in parts. Four planes: R, G, B and alpha, 16 wide; three: R, G and B, 22 wide, the last
    column repeated twice to fill B."""
    s, width = vector_samples(spark, sf_dir, bits), -(-64 // planes)
    if width * planes > 64:
        s = edged(s, {"x": 63}, {"x": width * planes - 64})
    return s.withColumns({"plane": F.floor(F.col("x") / width).cast("int"), "x": (F.col("x") % width).cast("int")})


def vector_samples_420(spark: SparkSession, sf_dir: str) -> DataFrame:
    """65 x 21 luma, whose last column and row are repeated; both chroma planes pick the samples at even places, 33 x 11."""
    s = edged(vector_samples(spark, sf_dir), {"x": 63, "y": ROWS_A_FRAME - 1}, {"x": 1, "y": 1})
    pick = s.where("x % 2 = 0 and y % 2 = 0").withColumns({"x": F.floor(F.col("x") / 2).cast("int"), "y": F.floor(F.col("y") / 2).cast("int")})
    chroma = pick.withColumn("plane", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("v", F.when(F.col("plane") == 1, F.col("v")).otherwise(255 - F.col("v")))
    return s.unionByName(chroma.select(s.columns))


def event_samples(spark: SparkSession, sf_dir: str, width: int = 50, rows: int = 20, filled: bool = False) -> DataFrame:
    """Event values in cents as 16-bit samples, 50 x 20 a frame. filled: zeros make the last frame whole."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    cell = width * rows
    if filled:
        last = e.agg(F.max("event_id").alias("m")).where((F.col("m") + 1) % cell > 0)
        e = e.unionByName(last.select(F.explode(F.sequence(F.col("m") + 1, F.ceil((F.col("m") + 1) / cell) * cell - 1)).alias("event_id"), F.lit(0.0).alias("value")))
    at = F.col("event_id") % cell
    return e.select(F.lit(2).cast("long").alias("stream_id"), F.floor(F.col("event_id") / cell).cast("long").alias("frame_index"), F.lit(0).alias("plane"), F.floor(at / width).cast("int").alias("y"), (at % width).cast("int").alias("x"), F.round(F.col("value") * 100).cast("int").alias("v"))


def halves(samples: DataFrame) -> DataFrame:
    """Grey samples of 32 bits as two planes of 16: the low half, and behind it the high one."""
    s = samples.withColumn("plane", F.explode(F.array(F.lit(0), F.lit(1))))
    return s.withColumn("v", F.when(F.col("plane") == 1, F.shiftright("v", 16)).otherwise(F.col("v")).bitwiseAND(65535))


def _digits(v: Column, bits: int) -> Column:
    """Hex of a sample as it is stored; null if it has no room there, so that its plane has a byte too few and fails."""
    digits = F.lpad(F.hex(v), 2 if bits <= 8 else 4, "0")
    if bits > 8:
        digits = F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    return F.when(v.between(0, 255 if bits <= 8 else 65535), digits)


def packed(samples: DataFrame, bits: int) -> DataFrame:
    """stream_id, frame_index, plane, width, height, data: row-major, 16-bit samples little-endian. Groups are single planes."""
    rows = samples.groupBy("stream_id", "frame_index", "plane", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", _digits(F.col("v"), bits).alias("d")))), lambda s: s["d"]), "").alias("row"), F.count(F.lit(1)).alias("width"))
    return rows.groupBy("stream_id", "frame_index", "plane").agg(F.max("width").cast("int").alias("width"), F.count(F.lit(1)).cast("int").alias("height"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda s: s["row"]), "")).alias("data"))


def framed(samples: DataFrame, c: StreamConfig, filler: Callable[[Column, Column], Column] = lambda y, x: F.lit(0)) -> DataFrame:
    """stream_id, frame_index, plane, data, given: all planes of c of each frame that has a sample. Where there is none, filler(y, x)
    makes the plane whole; given: the places (y * width + x) of the samples there are, null if that is all of them. A sample
    twice in one place, or one without room in its bits, still gives a plane of wrong size. Groups are single frames."""
    widths, heights = zip(*(c.plane_size(p) for p in range(c.planes)), strict=True)
    of = lambda sizes, plane: F.get(F.array(*map(F.lit, sizes)), plane)
    s, w = F.col("s"), of(widths, F.col("plane"))
    at = lambda x: F.get(F.filter(s, lambda e: e["x"] == x), F.lit(0))
    rows = samples.groupBy("stream_id", "frame_index", "plane", "y").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), _digits(F.col("v"), c.bits).alias("d")))).alias("s"))
    xs = F.transform(s, lambda e: e["x"])
    gaps = (F.size(s) < w) & (F.size(F.array_distinct(xs)) == F.size(s))
    filled = F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.when(at(x).isNull(), _digits(filler(F.col("y"), x), c.bits)).otherwise(at(x)["d"]))
    row = F.array_join(F.when(gaps, filled).otherwise(F.transform(s, lambda e: e["d"])), "")
    rows = rows.select("stream_id", "frame_index", F.struct("plane", F.col("y").cast("int").alias("y"), row.alias("row"), F.when(gaps, xs).alias("xs")).alias("r"))
    frames = rows.groupBy("stream_id", "frame_index").agg(F.array_sort(F.collect_list("r")).alias("rows")).withColumn("plane", F.explode(F.array(*map(F.lit, range(c.planes)))))
    w, h, rows = of(widths, F.col("plane")), of(heights, F.col("plane")), F.filter("rows", lambda r: r["plane"] == F.col("plane"))
    frames = frames.select("stream_id", "frame_index", "plane", rows.alias("rows"), w.alias("w"), h.alias("h"))
    there = lambda y: F.get(F.filter("rows", lambda r: r["y"] == y), F.lit(0))["row"]
    blank = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: _digits(filler(y, x), c.bits)), "")
    few = F.size("rows") < F.col("h")
    lines = F.when(few, F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.coalesce(there(y), blank(y)))).otherwise(F.transform("rows", lambda r: r["row"]))
    places = F.flatten(F.transform("rows", lambda r: F.transform(F.coalesce(r["xs"], F.sequence(F.lit(0), F.col("w") - 1)), lambda x: r["y"] * F.col("w") + x)))
    return frames.select("stream_id", "frame_index", "plane", F.unhex(F.array_join(lines, "")).alias("data"), F.when(few | F.exists("rows", lambda r: r["xs"].isNotNull()), places).alias("given"))


def with_given(planes: DataFrame, framed_planes: DataFrame) -> DataFrame:
    """planes (stream_id, frame_index, plane and others) with given as framed() told it: unpacked() gives those samples alone."""
    given = framed_planes.where("given is not null").select("stream_id", "frame_index", "plane", "given")
    return planes.join(given, ["stream_id", "frame_index", "plane"], "left")
