"""Distributed prefix doubling on chosen places: which strings of m bytes start earlier in the corpus too, by Spark's range sort.

A window is a string of m bytes. In each window the first of its places with the least name of k bytes is chosen; equal windows
choose the same place in them, so they can only be found at chosen places, of which there is one in some m / 3 bytes. A block is
a run of windows of one text that chose the same place: at first all of them, up to w of them, where k = m - w + 1.

A row is a block (doc, place, reach) with two keys: that of its core, the bytes which all windows of its full block share, and that
of its hull, all bytes of its own windows. Each round range-sorts all rows by (core, hull, doc, place) and ranks them anew: a
row's rank is the global index of the first row of its core. A block whose core is nowhere else leaves, as all its windows are
unique. A block whose hull is also earlier leaves, as all its windows are repeated. Of the others, each block is cut in eight and
its core grows: the key of the new core is the pair of the rank and the name of the bytes now in reach. For m = 100 cores are of
37, 93 and 100 bytes; in the last round a block is a window, and core and hull are one.

A core's key of 40 bits only lets blocks leave that are alone, so an accidental equal costs a row, not a result. Equal hulls are those
of equal keys of 128 bits: the core's 40, and 88 bits of the hull's BLAKE2b digest.

The whole sort key is the range key, so a group of any size is dealt over partitions. A group that goes over the edge of a
partition is joined by a table of each partition's first and last row (two rows a partition; the only thing the driver sees).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaplan.llm.common import BYTE_NAMES, C1, chunks, join2, mix, ragged, shuffle_partitions, text_buffer, written

#: place: 32 bits of the text's hash, then 31 bits of the position of the block's first window.
POSITION = 31
_AT = (1 << POSITION) - 1
#: reach: windows of the block less one, and bytes from its first window to the chosen place, of 15 bits each.
REACH = 15
PAIRS = "r1 long, r2 long, doc long, place long"
#: Of r1, the low bits that are of the hull.
HULL_BITS = 24
#: mark: 1 first row of its partition, 2 last, 3 both; r1, r2, least and first are kept for these only. alone: no row of the same core
#: beside it. opening: of the first hull of its partition.
RANKED = "rank long, doc long, place long, reach int, again boolean, alone boolean, opening boolean, mark int, r1 long, r2 long, least long, first long"
_RANKED = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[t]) for n, t in (c.split() for c in RANKED.split(", "))])
BLOCKS = PAIRS + ", reach int"
_BLOCKS = pa.schema([*((n, pa.int64()) for n in ("r1", "r2", "doc", "place")), ("reach", pa.int32())])
#: Text of a sort's partition, about.
BYTES_A_PARTITION = 1 << 25
#: Bytes of a long text that are read at a time.
SEGMENT = 1 << 18
_FACTOR = int(C1)
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
_PLACE_BITS = np.uint64((1 << 24) - 1)


def sizes(m: int) -> list[int]:
    """Windows of a full block, round by round."""
    out = [min(1 << 12, 1 << max(0, (2 * m // 3).bit_length() - 1))]
    while out[-1] > 1:
        out.append(max(1, out[-1] // 8))
    return out


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse."""
    global _POWERS
    if len(_POWERS[0]) < n:
        _POWERS = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, f, np.uint64)]), dtype=np.uint64) for f in (_FACTOR, _INVERSE)]
    return [p[:n] for p in _POWERS]


def short_names(flat: np.ndarray, k: int) -> np.ndarray:
    """A name of the k bytes at each place; to choose places and to leave out what is alone, no more."""
    up, down = _powers(len(flat))
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_NAMES[flat] * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(flat) - k + 1])


def first_blocks(flat: np.ndarray, offsets: np.ndarray, m: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """low, high (first and last window), place and name of the first k bytes there, of each block of the texts in flat."""
    n, k = len(flat), m - w + 1
    z = np.zeros(0, np.int64)
    if n < m:
        return z, z, z, z.view(np.uint64)
    name = short_names(flat, k)
    low, h = name & ~_PLACE_BITS | np.arange(len(name), dtype=np.uint64), 1
    while h < w:
        low = np.minimum(low[:-h], low[h:])
        h *= 2
    place = (low & _PLACE_BITS).astype(np.int64)
    inside = np.ones(len(place), bool)
    ends = offsets[1:]
    begins = np.minimum(np.maximum(ends - m + 1, offsets[:-1]), len(place))
    inside[ragged(begins, np.minimum(ends, len(place)) - begins)] = False
    other = np.ones(len(place) + 1, bool)
    other[1:-1] = (place[1:] != place[:-1]) | ~inside[1:] | ~inside[:-1]
    heads, tails = np.flatnonzero(inside & other[:-1]), np.flatnonzero(inside & other[1:])
    at = place[heads]
    return heads, tails, at, name[at]


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 128-bit BLAKE2b digest of each string, as two integers."""
    out = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(out, "<u8").reshape(-1, 2)


def _rows(core: np.ndarray, hull: np.ndarray, doc: np.ndarray, th: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    own = np.uint64((1 << HULL_BITS) - 1)
    r1 = (core & ~own | hull[:, 0] & own).view(np.int64)
    r2 = np.ascontiguousarray(hull[:, 1]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(r1), pa.array(r2), pa.array(doc), pa.array((th << POSITION) + low), pa.array(((high - low) << REACH | at - low).astype(np.int32))], schema=_BLOCKS)


def blocks(docs: DataFrame, m: int) -> DataFrame:
    """All blocks of all texts, with the keys of the first round. docs: doc_id, th, text."""
    w = sizes(m)[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            doc, th = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            for i, j in chunks(off, SEGMENT):
                for s in range(off[i], off[j], SEGMENT):
                    e = min(off[j], s + SEGMENT + m - 1)
                    inner = off[i : j + 1] - s if j > i + 1 else np.array([0, e - s])
                    low, high, at, name = first_blocks(flat[s:e], inner, m, w)
                    text = np.searchsorted(inner, low, "right") - 1
                    hull = digests(flat[s:e].tobytes(), low, high + m)
                    begin = off[i:j][text] - s
                    yield _rows(name, hull, doc[i:j][text], th[i:j][text], low - begin, high - begin, at - begin)

    return docs.select("doc_id", "th", "text").mapInArrow(cut, BLOCKS)


def smaller_blocks(docs: DataFrame, asked: DataFrame, m: int, size: int) -> DataFrame:
    """The blocks of asked (doc, place, reach, rank) cut to size, with the keys of the next round."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            doc, th = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            for i, lists in enumerate(rb.column("asked")):
                s = lists.values
                start, reach, rank = (s.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "reach", "rank"))
                raw, n = flat[off[i] : off[i + 1]].tobytes(), 1 << 16
                for a in range(0, len(start), n):
                    at = start[a : a + n] + (reach[a : a + n] & (1 << REACH) - 1)
                    far = at - start[a : a + n]
                    near = far - (reach[a : a + n] >> REACH)
                    count = far // size - near // size + 1
                    part = ragged(near // size, count)
                    near, far, at = (np.repeat(x, count) for x in (near, far, at))
                    low, high = at - np.minimum(far, part * size + size - 1), at - np.maximum(near, part * size)
                    hull = digests(raw, low, high + m)
                    grown = hull if size == 1 else digests(raw, at - part * size, at - part * size - size + 1 + m)
                    core = mix(join2(np.repeat(rank[a : a + n], count).view(np.uint64) + part.view(np.uint64) * C1, grown[:, 0]))
                    yield _rows(core, hull, np.full(len(at), doc[i]), np.full(len(at), th[i]), low, high, at)

    text = F.shiftright("place", POSITION)
    start = (F.col("place") - F.shiftleft(text, POSITION)).cast("int")
    one = F.struct(start.alias("start"), "reach", "rank")
    lists = asked.select(F.col("doc").alias("doc_id"), text.alias("th"), one.alias("one")).groupBy("doc_id", "th").agg(F.collect_set("one").alias("asked"))
    return docs.select("doc_id", "th", "text").join(lists, ["doc_id", "th"]).select("doc_id", "th", "text", "asked").mapInArrow(cut, BLOCKS)


def _ranker(hull_bits: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks the sorted rows of a partition. The last row of a batch waits for the next batch, which may hold its equal."""
        base = TaskContext.get().partitionId() << 33
        seen = 0
        kept: dict[str, np.ndarray] | None = None

        def rows(c: dict[str, np.ndarray], last: bool) -> pa.RecordBatch:
            n = len(c["doc"])
            mark = np.zeros(n, np.int32)
            if c["index"][0] == 0:
                mark[0] = 1
            if last:
                mark[-1] += 2
            alone = ~c["equal"]
            alone[:-1] &= ~c["equal"][1:]
            use = np.flatnonzero((~alone | (mark > 0))[: n if last else n - 1])
            null = mark[use] == 0
            arrays = [pa.array(c[k][use]) for k in ("rank", "doc", "place", "reach", "again")] + [pa.array(alone[use]), pa.array(c["opening"][use]), pa.array(mark[use])]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c[k][use], mask=null) for k in ("r1", "r2", "least", "first"))], schema=_RANKED)

        def groups(same: np.ndarray) -> np.ndarray:
            return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))

        for rb in batches:
            if not len(rb):
                continue
            c = {k: rb.column(k).to_numpy() for k in ("r1", "r2", "doc", "place", "reach")}
            n = len(rb)
            c["index"] = np.arange(seen, seen + n)
            seen += n
            if kept is not None:
                c = {k: np.concatenate([kept[k], v]) for k, v in c.items()}
                n += 1
            core, hull, text = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
            core[1:] = c["r1"][1:] >> hull_bits == c["r1"][:-1] >> hull_bits
            hull[1:] = (c["r1"][1:] == c["r1"][:-1]) & (c["r2"][1:] == c["r2"][:-1])
            text[1:] = hull[1:] & (c["doc"][1:] == c["doc"][:-1]) & (c["place"][1:] >> POSITION == c["place"][:-1] >> POSITION)
            by_core, by_hull, by_text = groups(core), groups(hull), groups(text)
            c["rank"], c["least"], c["first"] = base + c["index"][by_core], c["doc"][by_hull], c["place"][by_text]
            c["opening"] = c["index"][by_hull] == 0
            if kept is not None:
                for name, head in (("rank", by_core), ("least", by_hull), ("opening", by_hull), ("first", by_text)):
                    c[name][head == 0] = kept[name][0]
                core[0] = kept["equal"][0]
            c["equal"] = core
            c["again"] = (c["doc"] > c["least"]) | (c["place"] > c["first"])
            yield rows(c, False)
            kept = {k: v[-1:] for k, v in c.items()}
        if kept is not None:
            yield rows(kept, True)

    return rank


def _joined(edges: list, hull_bits: int) -> list[tuple]:
    """Of each core that goes over an edge of a partition: its rank in that partition, its rank; and if the partition's first hull goes
    over the edge too, that hull's least doc, and the doc and place of the partition's first row if it repeats its own text. edges:
    marked rows in order."""
    out: dict[int, tuple] = {}
    for a, b in zip(edges, edges[1:]):
        if not (a["mark"] & 2 and b["mark"] & 1 and a["r1"] >> hull_bits == b["r1"] >> hull_bits):
            continue
        rank, least, doc, place = out.setdefault(a["rank"], (a["rank"], None, None, None))
        if (a["r1"], a["r2"]) != (b["r1"], b["r2"]):
            out[b["rank"]] = (rank, None, None, None)
            continue
        if not a["opening"] or least is None:
            least, doc, place = a["least"], None, None
        again = a["doc"] == b["doc"] and a["place"] >> POSITION == b["place"] >> POSITION and (b["place"] > a["first"] or (doc, place) == (b["doc"], b["place"]))
        out[b["rank"]] = (rank, least, b["doc"] if again else None, b["place"] if again else None)
    return [(k, *v) for k, v in out.items()]


def lean(df: DataFrame, name: str) -> DataFrame:
    """written(), after which Spark deletes the shuffle files that led to it."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        # Another frame of the same plan: it is the one made under the setting that counts.
        return written(df.select("*"), name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def reranked(pairs: DataFrame, partitions: int, hull_bits: int = 0) -> DataFrame:
    """doc, place, reach, rank, again (a row of the same r1 and r2 has a smaller doc, or is earlier in the same text) of all rows
    whose r1, without its low hull_bits, is not theirs alone. pairs: PAIRS or BLOCKS."""
    spark = pairs.sparkSession
    if "reach" not in pairs.columns:
        pairs = pairs.withColumn("reach", F.lit(0))
    key = ["r1", "r2", "doc", "place"]
    ranked = lean(pairs.repartitionByRange(partitions, *key).sortWithinPartitions(*key).mapInArrow(_ranker(hull_bits), RANKED), "ranked")
    edges = ranked.where("mark > 0").collect()
    edges.sort(key=lambda e: (e["rank"] >> 33, e["mark"] == 2))
    over = _joined(edges, hull_bits)
    if not over:
        return ranked.where("not alone").select("doc", "place", "reach", "rank", "again")
    fix = F.broadcast(spark.createDataFrame(over, "rank long, new_rank long, new_least long, edge_doc long, edge_place long"))
    later = F.col("opening") & ((F.col("doc") > F.col("new_least")) | (F.col("doc") == F.col("edge_doc")) & (F.col("place") == F.col("edge_place")))
    again = F.col("again") | F.coalesce(later, F.lit(False))
    return ranked.join(fix, "rank", "left").where("not alone or new_rank is not null").select("doc", "place", "reach", F.coalesce("new_rank", "rank").alias("rank"), again.alias("again"))


def repeated_starts(docs: DataFrame, m: int) -> DataFrame:
    """doc_id, th, starts (start << REACH | count - 1): runs of windows of m bytes that also start earlier. docs: as keyed() gives it;
    rows of one doc_id and th count once."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(shuffle_partitions(docs.sparkSession), -(-total // BYTES_A_PARTITION))
    shared = reranked(blocks(docs, m), partitions, HULL_BITS)
    found = shared.where("again")
    for size in sizes(m)[1:]:
        shared = reranked(lean(smaller_blocks(docs, shared.where("not again"), m, size), "blocks"), partitions, HULL_BITS)
        found = found.unionByName(shared.where("again"))
    text = F.shiftright("place", POSITION)
    run = F.shiftleft(F.col("place") - F.shiftleft(text, POSITION), REACH) + F.shiftright("reach", REACH)
    return found.select(F.col("doc").alias("doc_id"), text.alias("th"), run.alias("run")).groupBy("doc_id", "th").agg(F.collect_set("run").alias("starts"))
