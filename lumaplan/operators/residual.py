"""Residuals of all samples at once: the encoder predicts from original samples, so differences are window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaplan.functions import columns as C

PLANE = ("stream_id", "frame_index", "plane")


def residuals(samples: DataFrame, bits: int, partition: Sequence[str] = PLANE, signed16: bool = False, tables: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """samples with left, top, top_left, top_right, far_left, top_top, pred, context, invert and diff.

    partition names the columns of a coding rectangle (a plane, or a slice of it), inside which y and x count from 0 and every
    place has one sample. Samples are collected into rows (merged before the shuffle where a row's samples come together), and
    rows are shuffled by rectangle; the window looks back two rows, so it moves rows of samples and not single ones.
    """
    keys = list(partition)
    other = [c for c in samples.columns if c not in {*keys, "y", "x", "v"}]
    one = F.struct("x", "v", *other)
    lines = samples.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(one)).alias("line"))
    up = Window.partitionBy(*keys).orderBy("y")
    empty = F.transform("line", lambda s: F.lit(0))
    values = F.transform("line", lambda s: s["v"])
    lines = lines.withColumn("now", values)
    lines = lines.withColumn("up1", F.lag("now", 1).over(up)).withColumn("up2", F.lag("now", 2).over(up))
    lines = lines.withColumns({"up1": F.coalesce("up1", empty), "up2": F.coalesce("up2", empty)})
    at = lambda a, i: F.get(a, i)
    rows = lines.select(*keys, "y", "now", "up1", "up2", F.size("now").alias("n"), F.posexplode("line").alias("i", "s"))
    i, now, up1, up2 = F.col("i"), F.col("now"), F.col("up1"), F.col("up2")
    n = {
        "left": F.when(i > 0, at(now, i - 1)).otherwise(at(up1, F.lit(0))),
        "top": at(up1, i),
        "top_left": F.when(i > 0, at(up1, i - 1)).otherwise(at(up2, F.lit(0))),
        "top_right": F.when(i + 1 < F.col("n"), at(up1, i + 1)).otherwise(at(up1, i)),
        "far_left": F.when(i > 1, at(now, i - 2)).when(i == 1, at(up1, F.lit(0))).otherwise(F.lit(0)),
        "top_top": at(up2, i),
    }
    rows = rows.select(*keys, "y", "s.*", *(e.alias(k) for k, e in n.items()))
    c = {k: F.col(k) for k in n}
    guess = (C.median_predict_signed16 if signed16 else C.median_predict)(c["left"], c["top"], c["top_left"])
    rows = rows.withColumn("pred", guess)
    sum_ = C.context_sum(c, tables) if tables else F.lit(0)
    rows = rows.withColumn("_sum", sum_).withColumn("_diff", C.difference(F.col("v"), F.col("pred"), bits))
    return rows.withColumns({"context": F.abs("_sum"), "invert": F.col("_sum") < 0, "diff": F.when(F.col("_sum") < 0, -F.col("_diff")).otherwise(F.col("_diff"))}).drop("_sum", "_diff")


def slice_samples(samples: DataFrame, streams: DataFrame) -> DataFrame:
    """samples with slice_index, and y and x counted inside their slice. streams: stream_id, width, height, num_h, num_v, log2_h,
    log2_v, chroma, colorspace; it is one row a stream."""
    s = samples.join(streams.select("stream_id", "width", "height", "num_h", "num_v", "log2_h", "log2_v", "chroma", "colorspace"), "stream_id")
    sub = F.col("chroma") & (F.col("colorspace") == 0) & F.col("plane").isin(1, 2)
    pw = F.when(sub, C.subsampled(F.col("width"), F.col("log2_h"))).otherwise(F.col("width"))
    ph = F.when(sub, C.subsampled(F.col("height"), F.col("log2_v"))).otherwise(F.col("height"))
    s = s.withColumns({"_pw": pw, "_ph": ph})
    # The cell of position p is the last whose boundary floor(cell * extent / cells) is not over p.
    cell = lambda p, extent, cells: F.floor(((p + 1) * cells - 1) / extent).cast("int")
    s = s.withColumns({"_cx": cell(F.col("x"), F.col("_pw"), F.col("num_h")), "_cy": cell(F.col("y"), F.col("_ph"), F.col("num_v"))})
    x0, y0 = C.grid_boundary(F.col("_cx"), F.col("_pw"), F.col("num_h")), C.grid_boundary(F.col("_cy"), F.col("_ph"), F.col("num_v"))
    return s.select("stream_id", "frame_index", "plane", (F.col("_cy") * F.col("num_h") + F.col("_cx")).cast("int").alias("slice_index"), (F.col("y") - y0).cast("int").alias("y"), (F.col("x") - x0).cast("int").alias("x"), "v")


def histogram(res: DataFrame, *by: str) -> DataFrame:
    return res.groupBy(*by, "diff").agg(F.count(F.lit(1)).alias("n"))


def entropy(res: DataFrame, *by: str) -> DataFrame:
    """Bits per sample of the differences' distribution in each group, and the share of zeros."""
    h = histogram(res, *by)
    t = h.groupBy(*by).agg(F.sum("n").alias("samples"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.sum(F.when(F.col("diff") == 0, F.col("n")).otherwise(0)).alias("zeros"))
    return t.select(*by, "samples", F.round(F.log2("samples") - F.col("s") / F.col("samples"), 6).alias("bits"), F.round(F.col("zeros") / F.col("samples"), 6).alias("zero_share"))


def code_bits(res: DataFrame, bits: int, most_k: int, *by: str) -> DataFrame:
    """Golomb-Rice bits of each group at each fixed parameter 0..most_k."""
    return res.groupBy(*by).agg(*(F.sum(C.code_length(F.col("diff"), k, bits)).alias(f"bits_k{k}") for k in range(most_k + 1)))
