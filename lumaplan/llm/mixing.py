"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaplan.llm.common import written

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def queue_place(seed: int = 1) -> Column:
    """60 bits of a digest of seed, doc_id and text: a row's place in its source's queue."""
    row = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("long")


def fill_targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """budget shared by weight; no target over most * size, the excess reshared by weight until none is above."""
    caps = [most * s for s in sizes]
    targets, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], budget
    while open_:
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / share >= caps[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / share
            break
        for i in over:
            targets[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def source_targets(sized: DataFrame, weights: tuple[float, ...], budget_share: float, most: int) -> tuple[DataFrame, float]:
    """The table source, source_size, n, target, and the budget. The driver gets sums and a count a partition, nothing a source:
    sources are numbered by a range sort and partition counts; targets come by raising the level at which sources are full."""
    order = F.col("source").asc_nulls_last()
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    per = written(per.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["part"], r["count"]) for r in per.groupBy("part").count().collect())
    spark, before = sized.sparkSession, 0
    offsets = []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(offsets, "part int, ahead long"))  # a row a partition
    nth = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    per = per.join(offsets, "part").withColumn("nth", nth).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    per = written(per.select("source", "source_size", "n", "weight", "cap"), "mix-weights")

    some = F.col("source_size") > 0
    sums = per.where(some).agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.sum("weight").alias("weight")).first()
    budget = budget_share * int(sums["size"])
    left, share, full = budget, sums["weight"] or 0.0, 0
    while share:
        # Once full at a level, a source is full at every higher one, so the last level tells all that are.
        at = F.lit(left) * F.col("weight") / F.lit(share) >= F.col("cap")
        now = per.where(some).agg(F.count(F.when(at, 1)).alias("full"), F.sum(F.when(at, F.col("cap"))).alias("caps"), F.sum(F.when(~at, F.col("weight"))).alias("open")).first()
        if now["full"] == full:
            break
        full, left, share = now["full"], budget - now["caps"], now["open"] or 0.0
    target = F.col("cap") if not share else F.when(F.lit(left) * F.col("weight") / F.lit(share) >= F.col("cap"), F.col("cap")).otherwise(F.lit(left) * F.col("weight") / F.lit(share))
    return per.select("source", "source_size", "n", F.when(some, target).otherwise(F.lit(0.0)).alias("target")), budget


def _each(groups: DataFrame, n: str, nth: str, piece: int = 1000) -> DataFrame:
    """A row for each of the n equal rows that a group stands for, numbered from 1. Groups over `piece` are dealt out in pieces."""
    few = groups.where(F.col(n) <= piece).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    many = groups.where(F.col(n) > piece).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(piece).cast("long"))))
    many = many.repartition("source", "doc_id", "row_hash", "_from")
    many = many.withColumn(nth, F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + piece, F.col(n))))).drop("_from")
    return few.unionByName(many)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_share: float = 1.5, most: int = 2, seed: int = 1, rows_a_bucket: int = 500) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, row_hash and nth (from 1, among equal rows) of each row of docs.

    Each source queues its documents in a hashed order, again and again, at most `most` times. A copy's virtual finish time
    is the source's words so far divided by its target. The copies of all sources are sorted by finish time (a range sort
    over the cluster) and the mix is cut where its words would pass the budget: the driver gets the words of each sorted
    partition, and running sums are taken in the one partition where the budget ends.

    Rows equal in source, doc_id and text are one entry of the queue with a count until the end, so a row repeated any number
    of times is no group of its own. The words ahead of an entry are summed in three steps: inside buckets of about
    rows_a_bucket entries, over 1000 buckets, and over those; so no task holds a source.

    Null text: size 0, never taken. Null source: a source of its own, last in order. One id and text in several sources: each
    source queues and takes its own. Sources without words: target 0. Null doc_id: allowed. Repeated rows: the first ones
    by nth are taken more often. Empty table: no rows. Columns other than doc_id, text and source are not read.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), queue_place(seed).alias("row_hash"))
    sized = written(sized.groupBy("source", "doc_id", "row_hash", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    sources, budget = source_targets(sized, weights, budget_share, most)
    of = sources.withColumnRenamed("source", "of")
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    # The bucket follows the row's place, so places in lower buckets come first.
    buckets = F.ceil(F.col("n") / rows_a_bucket)
    rows = rows.withColumn("bucket", F.floor(F.shiftright(F.col("row_hash"), 28) * buckets / F.lit(2**32)).cast("long"))
    rows = rows.withColumn("block", F.floor(F.col("bucket") / 1000))
    sums = rows.groupBy("source", "block", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    blocks = sums.groupBy("source", "block").agg(F.sum("words").alias("words"))
    ahead = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("source").alias("of"), F.col("block").alias("in"), ahead(Window.partitionBy("source").orderBy("block")).alias("far"))
    near = sums.select("source", "block", "bucket", ahead(Window.partitionBy("source", "block").orderBy("bucket")).alias("near"))
    near = near.join(blocks, near["source"].eqNullSafe(blocks["of"]) & (near["block"] == blocks["in"]))
    near = near.select(F.col("source").alias("of"), F.col("bucket").alias("in"), (F.col("near") + F.col("far")).alias("ahead"))
    rows = rows.join(near, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))).drop("of", "in")
    inside = Window.partitionBy("source", "bucket").orderBy("row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    queued = rows.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0)) + F.col("ahead"))
    queued = written(queued.select("doc_id", "source", "size", "source_size", "target", "row_hash", "rows", "before"), "mix-queue")

    finish = lambda copy: (F.col("before") + F.col("nth") * F.col("size") + F.lit(copy) * F.col("source_size")).cast("double") / F.col("target")
    copies = _each(queued.where("target > 0 and size > 0"), "rows", "nth").select("size", F.explode(F.array(*(finish(i) for i in range(most)))).alias("finish"))
    sorted_ = written(copies.repartitionByRange("finish").sortWithinPartitions("finish").withColumn("part", F.spark_partition_id()), "mix-sorted")
    parts = sorted_.groupBy("part").agg(F.sum("size").alias("words"), F.max("finish").alias("last")).orderBy("part").collect()
    gone, end = 0, float("-inf")  # all copies that finish at `end` or before are taken
    for r in parts:
        if gone + r["words"] > budget:
            total = Window.partitionBy("part").orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)
            part = sorted_.where(F.col("part") == r["part"]).withColumn("words", F.sum("size").over(total))
            most_ = part.where(F.col("words") <= F.lit(budget - gone)).agg(F.max("finish")).first()[0]
            end = end if most_ is None else most_
            break
        gone, end = gone + r["words"], r["last"]
    copies = sum(((finish(i) <= F.lit(end)).cast("long") for i in range(most)), F.lit(0).cast("long"))
    copies = F.when((F.col("target") > 0) & (F.col("size") > 0), copies).otherwise(F.lit(0).cast("long"))
    out = _each(queued, "rows", "nth").withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "row_hash", "nth")


def op6_mixing(spark, sf_dir):
    from lumaplan.llm.common import table

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
