"""Prefix trie of conversations: partial tries of partitions, merged by hash, then rolled up from the ends to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaplan.llm.common import fresh_dir, written

#: The key of the root, and the length of keys and digests.
ROOT = bytes(16)
#: Ids of an end list that one row holds: those of one range of so many ids.
ENDS = 1024
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"
#: kind 0: a node of a partial trie; 1: a part of a node's end list; 2: a step on a conversation's path.
PARTIAL = "kind int, part int, key binary, parent binary, depth int, conv_id long, n long, words long, ends array<long>"
_FIELDS = [("kind", pa.int32()), ("part", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("ends", pa.list_(pa.int64()))]


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn's role and text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and words of each turn, in order of turn, null first; turns of one number by digest. Null role or
    text: empty. Rows without conv_id belong to no conversation and are left out. Texts don't leave the scan: only digests
    are shuffled."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return turns.withColumn("place", place).select("conv_id", "place", "digest", "words")


class _PartialTrie:
    """Nodes of one partition, by key. A batch of rows goes out when there are `room` of them; the merge puts such batches together."""

    def __init__(self, part: int, room: int):
        self.part, self.room = part, room
        self._clear()

    def _clear(self) -> None:
        self.nodes: dict[bytes, list] = {}
        self.ends: dict[tuple[bytes, int], list[int]] = {}
        self.steps: list[tuple] = []

    def visit(self, key: bytes, parent: bytes | None, depth: int, conv: int, words: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [parent, depth, conv, 1, words]
        else:
            node[2], node[3] = min(node[2], conv), node[3] + 1
        self.steps.append((key, depth, conv))

    def end(self, key: bytes, conv: int) -> None:
        self.ends.setdefault((key, conv // ENDS), []).append(conv)

    def full(self) -> bool:
        return len(self.steps) >= self.room

    def rows(self) -> pa.RecordBatch:
        out = [(0, self.part, key, parent, depth, conv, n, words, None) for key, (parent, depth, conv, n, words) in self.nodes.items()]
        out += [(1, self.part, key, None, None, bucket, None, None, ids) for (key, bucket), ids in self.ends.items()]
        out += [(2, self.part, key, None, depth, conv, None, None, None) for key, depth, conv in self.steps]
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])


def partial_tries(walk: DataFrame, room: int = 1 << 16) -> DataFrame:
    """PARTIAL of walk: conv_id, place, digest, words. Place 0 stands for the conversation itself and says that it is there; the other
    places are taken in ascending order, gaps or not. A task holds at most about `room` steps."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trie, conv, key, depth = _PartialTrie(TaskContext.get().partitionId(), room), None, ROOT, 0
        for rb in batches:
            for c, place, digest, words in zip(*(rb.column(x).to_pylist() for x in ("conv_id", "place", "digest", "words")), strict=True):
                if place == 0:
                    if conv is not None:
                        trie.end(key, conv)
                    if trie.full():
                        yield trie.rows()
                    conv, key, depth = c, ROOT, 0
                    trie.visit(ROOT, None, 0, c, 0)
                    continue
                parent, key, depth = key, hashlib.blake2b(key + digest, digest_size=16).digest(), depth + 1
                trie.visit(key, parent, depth, c, words)
                if trie.full():
                    yield trie.rows()
        if conv is not None:
            trie.end(key, conv)
        yield trie.rows()

    return walk.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "place", "digest", "words").mapInArrow(build, PARTIAL)


def merged_nodes(partials: DataFrame, parts: int, fan_in: int = 64) -> DataFrame:
    """key, parent, depth, conv_id (least member), n_convs, words: partial nodes merged by key in groups of fan_in tables, and these again,
    until one table is left. No key has more than fan_in rows in a task of a round."""
    out = partials.select("part", "key", "parent", "depth", "conv_id", "n", "words")
    while True:
        # A part's batches and then groups of parts: the last round has one group.
        out = out.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("part", "key").agg(*(F.any_value(x).alias(x) for x in ("parent", "depth", "words")), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
        parts = -(-parts // fan_in)
        if parts <= 1:
            return out.select("key", "parent", "depth", "conv_id", F.col("n").alias("n_convs"), "words")


def end_lists(partials: DataFrame) -> DataFrame:
    """key, bucket (conv_id div ENDS), ends: ids of the conversations that end at a node, ascending over the buckets; a row has ENDS ids at most."""
    return partials.groupBy("key", F.col("conv_id").alias("bucket")).agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends"))


def end_digests(lists: DataFrame) -> DataFrame:
    """key, ends_sha256 of the decimal ids joined by commas. A list's rows pass one by one, in order: none is put together whole."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for rb in batches:
            keys, said = [], []
            for key, ids in zip(rb.column("key").to_pylist(), rb.column("ids").to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        keys.append(last)
                        said.append(h.hexdigest())
                    last, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(said, pa.string())], names=["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

    rows = lists.select("key", "bucket", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids"))
    return rows.repartition("key").sortWithinPartitions("key", "bucket").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def conversation_trie(walk: DataFrame) -> DataFrame:
    """key, parent, depth, conv_id (least member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    A node is a sequence of digests; its members are the conversations that begin with it. The least member of a node is that of
    all nodes below on its own path, so each node lies on the path of one owner, and each owner has the lower end of its path.
    Rolled up from there: an owner's sums over its own nodes go, at every step up to the root, to that step's node, one row
    a step, and are added by key. So no level of the tree is a round of its own, and depth costs nothing. walk: see partial_tries().
    Empty walk: no rows.
    """
    spark = walk.sparkSession
    path = fresh_dir(spark, "tries")
    partial_tries(walk).write.partitionBy("kind").parquet(path)
    partials = spark.read.schema(PARTIAL).parquet(path)
    parts = (partials.where("kind = 0").agg(F.max("part")).first()[0] or 0) + 1
    nodes = written(merged_nodes(partials.where("kind = 0"), parts), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    # Sums over an owner's path from its end on: own nodes add, the steps (those above its own nodes too) receive.
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("key"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    steps = partials.where("kind = 2").select("conv_id", "depth", "key", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0)
    sums = own.unionByName(steps).select("key", F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved")).where("key is not null and (leaf > 0 or saved > 0)")
    rolled = sums.groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    # A parent is of another owner only where an owner's own nodes begin; many of these may have one parent, so both sides are salted.
    first = nodes.groupBy("conv_id").agg(F.min_by(F.struct("key", "parent"), "depth").alias("first")).select("first.*").where("parent is not null")
    salted = first.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    above = nodes.where("n_children > 0").join(first.select(F.col("parent").alias("key")).distinct(), "key", "left_semi")
    above = above.select(F.col("key").alias("parent"), F.col("conv_id").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt"))
    other = salted.join(above, ["parent", "salt"]).select("key", "other")

    ends = end_digests(end_lists(partials.where("kind = 1")))
    out = nodes.join(rolled, "key", "left").join(ends, "key", "left").join(other, "key", "left")
    return out.select(
        "key", "parent", F.col("depth").cast("long").alias("depth"), "conv_id", F.when(F.col("depth") > 0, F.coalesce("other", "conv_id")).alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"),
        "n_leaves", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def grafted_walk(conversations: DataFrame, every: int = 20) -> DataFrame:
    """The walk of conversations that begin like others: the first h turns of conversation c - c % every, then c's own after its first h;
    h = crc32 of the decimal c, modulo 4."""
    turns = written(numbered_turns(conversations), "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4))
    roster = turns.where("place = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    heads = turns.where(F.col("place") <= 3).where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    grafts = roster.join(heads, "base").where("place <= h").select("conv_id", "place", "digest", "words")
    there = roster.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return there.unionByName(grafts).unionByName(turns.where(F.col("place") > h))


def op12_prefix_trie(spark, sf_dir):
    """One row for each distinct beginning of the rebuilt conversations; see conversation_trie(), grafted_walk() and numbered_turns()."""
    from lumaplan.llm.common import table

    return conversation_trie(grafted_walk(table(spark, sf_dir, "conversations"))).drop("key", "parent")
