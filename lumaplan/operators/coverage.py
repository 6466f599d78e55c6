"""Checks of streams, planes and slice rectangles as DataFrame predicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaplan.functions import columns as C


def profile_faults(streams: DataFrame) -> DataFrame:
    """streams with `fault`: what a public encoder would refuse, null if nothing. Columns: width, height, bits, colorspace, chroma,
    extra, log2_h, log2_v, num_h, num_v."""
    rgb = F.col("colorspace") == 1
    sub = (F.col("log2_h") > 0) | (F.col("log2_v") > 0)
    tiny = (F.col("num_h") > F.col("width")) | (F.col("num_v") > F.col("height")) | (F.col("chroma") & ~rgb & ((F.col("num_h") > C.subsampled(F.col("width"), F.col("log2_h"))) | (F.col("num_v") > C.subsampled(F.col("height"), F.col("log2_v")))))
    rules = [
        ((F.col("width") < 1) | (F.col("height") < 1), "extent"), (~F.col("bits").between(1, 16), "bits"), (~F.col("colorspace").isin(0, 1), "colorspace"), (rgb & (~F.col("chroma") | sub), "rgb"), (~F.col("chroma") & sub, "subsampling without chroma"),
        (~((F.col("log2_h") == 0) & (F.col("log2_v") == 0) | (F.col("log2_h") == 1) & F.col("log2_v").isin(0, 1)), "subsampling"), ((F.col("num_h") < 1) | (F.col("num_v") < 1), "grid"), (C.over_cif(F.col("width"), F.col("height")) & (F.col("num_h") * F.col("num_v") < 4), "slices"), (tiny, "empty cell"),
    ]
    return streams.withColumn("fault", F.coalesce(*(F.when(test, name) for test, name in rules)))


def plane_faults(samples: DataFrame, bits: int) -> DataFrame:
    """stream_id, frame_index, plane, width, height, n, missing places, doubled places and samples over the bit depth."""
    g = samples.groupBy("stream_id", "frame_index", "plane").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count(F.lit(1)).alias("n"), F.countDistinct("y", "x").alias("places"), F.sum((F.col("v") >= (1 << bits)).cast("long")).alias("over"))
    return g.select("stream_id", "frame_index", "plane", "width", "height", "n", (F.col("width").cast("long") * F.col("height") - F.col("places")).alias("missing"), (F.col("n") - F.col("places")).alias("doubled"), "over")


def view_faults(views: DataFrame) -> DataFrame:
    """views with `fault`: why an output plane cannot take a stream's plane; null if it can. Columns: role, sample_format, width,
    height, stride_bytes of the output; wanted_role, wanted_format, wanted_width, wanted_height of the stream's plane (null
    role of the output: the plane is missing)."""
    bytes_ = F.when(F.col("wanted_format") == "u8", 1).otherwise(2)
    rules = [
        (F.col("role").isNull(), "missing"), (F.col("role") != F.col("wanted_role"), "role"), (F.col("sample_format") != F.col("wanted_format"), "format"),
        ((F.col("width") < F.col("wanted_width")) | (F.col("height") < F.col("wanted_height")), "size"), (F.col("stride_bytes") < F.col("wanted_width") * bytes_, "stride"),
    ]
    return views.withColumn("fault", F.coalesce(*(F.when(test, name) for test, name in rules)))


def into_views(planes: DataFrame, views: DataFrame) -> DataFrame:
    """Decoded planes (codec.PLANES) laid out in output planes: stream_id, frame_index, plane, data and fault. views: stream_id, plane,
    role, sample_format, width, height, stride_bytes of each output plane. data has view rows of stride_bytes, zeros behind the
    samples and below them. A plane without a view, or with one it does not fit in: data null, and why; see view_faults().
    Frames that failed: no rows."""
    view = ["role", "sample_format", "width", "height", "stride_bytes"]
    wanted = planes.where("plane is not null").select(
        "stream_id", "frame_index", "plane", F.col("data").alias("samples"), F.col("bytes_per_sample").alias("size"), F.col("role").alias("wanted_role"), F.when(F.col("bytes_per_sample") == 1, "u8").otherwise("u16").alias("wanted_format"),
        F.col("width").alias("wanted_width"), F.col("height").alias("wanted_height"),
    )
    both = view_faults(wanted.join(views.select("stream_id", "plane", *view), ["stream_id", "plane"], "left"))
    line = F.col("wanted_width") * F.col("size")
    rows = F.transform(F.sequence(F.lit(0), F.col("wanted_height") - 1), lambda y: F.rpad(F.substring(F.col("samples"), (y * line + 1).cast("int"), line.cast("int")), F.col("stride_bytes").cast("int"), F.lit(b"\0")))
    whole = F.rpad(F.aggregate(rows, F.lit(b""), lambda a, r: F.concat(a, r)), (F.col("stride_bytes") * F.col("height")).cast("int"), F.lit(b"\0"))
    return both.select("stream_id", "frame_index", "plane", F.when(F.col("fault").isNull(), whole).alias("data"), "fault")


class _Active:
    """Intervals that are open, over the distinct bounds of all: lengths that one, and that two or more of them hold. A tree whose nodes
    count the intervals that hold them whole, so that a change visits two nodes a level."""

    def __init__(self, bounds: np.ndarray):
        self.at, self.leaves = bounds.tolist(), max(1, len(bounds) - 1)
        self.count, self.once, self.twice = ([0] * (4 * self.leaves) for _ in range(3))

    def change(self, low: int, high: int, by: int, node: int = 1, begin: int = 0, end: int | None = None) -> None:
        end = self.leaves if end is None else end
        if high <= begin or end <= low:
            return
        if low <= begin and end <= high:
            self.count[node] += by
        else:
            middle = (begin + end) // 2
            self.change(low, high, by, 2 * node, begin, middle)
            self.change(low, high, by, 2 * node + 1, middle, end)
        length, leaf, n = self.at[end] - self.at[begin], end - begin == 1, self.count[node]
        below = (0, 0) if leaf else (self.once[2 * node] + self.once[2 * node + 1], self.twice[2 * node] + self.twice[2 * node + 1])
        self.once[node] = length if n else below[0]
        self.twice[node] = length if n > 1 else below[0] if n else below[1]


def swept(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """Cells that rectangles hold, and those that more than one of them holds: a sweep along x over the rectangles' edges, n log n in
    their number, whatever their size is."""
    some = (w > 0) & (h > 0)
    x, y, w, h = x[some], y[some], w[some], h[some]
    if not len(x):
        return 0, 0
    bounds = np.unique(np.concatenate([y, y + h]))
    low, high, active = np.searchsorted(bounds, y).tolist(), np.searchsorted(bounds, y + h).tolist(), _Active(bounds)
    edge, by = np.concatenate([x, x + w]), np.repeat([1, -1], len(x))
    covered = overlapping = 0
    last, order = int(edge.min()), np.argsort(edge, kind="stable")
    for e, i, d in zip(edge[order].tolist(), (order % len(x)).tolist(), by[order].tolist(), strict=True):
        covered, overlapping, last = covered + (e - last) * active.once[1], overlapping + (e - last) * active.twice[1], e
        active.change(low[i], high[i], d)
    return covered, overlapping


def coverage(slices: DataFrame, streams: DataFrame) -> DataFrame:
    """stream_id, frame_index, cells, covered, overlapping and verdict (exact, open, overlap, too large) of each frame's slices
    (stream_id, frame_index, raster_x, raster_y, raster_w, raster_h). A frame's slices are swept in one task: the work follows
    their number, not the grid's cells. Slices without cells count for nothing."""
    rows = slices.join(streams.select("stream_id", "width", "height", "num_h", "num_v"), "stream_id")
    large = C.over_cif(F.col("width"), F.col("height")) & (F.col("raster_w") * F.col("raster_h") > F.floor(F.col("num_h") * F.col("num_v") / 4))
    rows = rows.select("stream_id", "frame_index", *(F.col(f"raster_{k}").cast("long").alias(k) for k in "xywh"), large.alias("large"), (F.col("num_h") * F.col("num_v")).cast("long").alias("cells"))

    def sweep(t: pa.Table) -> pa.Table:
        covered, overlapping = swept(*(t.column(k).to_numpy() for k in "xywh"))
        head = [t.column(k)[:1] for k in ("stream_id", "frame_index", "cells")]
        return pa.table([*head, pa.array([covered]), pa.array([overlapping]), pa.array([pc.any(t.column("large")).as_py()])], names=["stream_id", "frame_index", "cells", "covered", "overlapping", "large"])

    out = rows.groupBy("stream_id", "frame_index").applyInArrow(sweep, "stream_id long, frame_index long, cells long, covered long, overlapping long, large boolean")
    verdict = F.when(F.col("large"), "too large").when(F.col("covered") < F.col("cells"), "open").when(F.col("overlapping") > 0, "overlap").otherwise("exact")
    return out.select("stream_id", "frame_index", "cells", "covered", "overlapping", verdict.alias("verdict"))
