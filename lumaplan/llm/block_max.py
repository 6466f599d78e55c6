"""Ranked lexical search: an inverted index of compressed blocks with their greatest impacts, searched by Block-Max WAND."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaplan.llm.common import NULL_ID, chunks, ragged, real_id, span_hashes, text_buffer, word_spans, written

#: Postings of a block.
BLOCK = 128
#: A row for each shard and term. The row of the empty term holds the shard's documents: blocks are their ids, places how many terms each has.
INDEX = "shard long, term binary, df long, blocks binary, places binary, counts binary"
_BLOCK = np.dtype([("first", "<u4"), ("last", "<u4"), ("top", "<u4"), ("places_at", "<u4"), ("counts_at", "<u4"), ("place_bits", "u1"), ("count_bits", "u1"), ("size", "u1")])
_TERM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TERM[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOUND = "item long, item_id long, doc_id long, score long"


def terms(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the terms in them, and how many each text has: runs of letters and digits, of which all
    code points over 127 are."""
    return _LOWER[flat], *word_spans(flat, offsets, _TERM)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + 25 * n * n_docs // max(n_terms, 1)


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pack(values: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of values (sizes of them, beginning at heads), each with as many bits a value as its greatest needs: bytes, where each
    block's begin, and its bits."""
    bits = np.frexp(np.maximum.reduceat(values, heads).astype(np.float64))[1]
    room = (sizes * bits + 7) // 8
    at = np.cumsum(room) - room
    width = np.repeat(bits, sizes)
    bit = np.repeat(8 * at, sizes) + (np.arange(len(values)) - np.repeat(heads, sizes)) * width
    out = np.zeros(8 * int(room.sum()), np.uint8)
    for b in range(int(bits.max(initial=0))):
        has = width > b
        out[bit[has] + width[has] - 1 - b] = values[has] >> b & 1
    return np.packbits(out), at, bits


def unpack(data: bytes, at: int, size: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(size, np.int64)
    raw = np.unpackbits(np.frombuffer(data, np.uint8, (size * bits + 7) // 8, at))[: size * bits]
    return raw.reshape(size, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column out of bytes and where each row ends in them."""
    at = np.zeros(len(ends) + 1, np.int32)
    at[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


class _Shard:
    """Postings of some documents, until they are written."""

    def __init__(self) -> None:
        self.names: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs, self.bytes = 0, 0

    def _number(self, name: bytes) -> int:
        return self.names.setdefault(name, len(self.names))

    def add(self, flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        low, starts, ends, n = terms(flat, offsets)
        if len(starts):
            _, first, back = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
            raw, size = low.tobytes(), ends - starts
            number = np.array([self._number(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)[back]
            # Each term against the first one of its hash, byte for byte.
            short = np.minimum(size, size[first][back])
            differ = low[ragged(starts, short)] != low[ragged(starts[first][back], short)]
            for i in np.flatnonzero((np.add.reduceat(differ, np.cumsum(short) - short) > 0) | (size != size[first][back])).tolist():
                number[i] = self._number(raw[starts[i] : ends[i]])
            both, tf = np.unique(np.repeat(np.arange(len(n)), n) << 40 | number, return_counts=True)
            self.postings.append((both & (1 << 40) - 1, (both >> 40) + self.docs, tf))
        self.ids.append(ids)
        self.sizes.append(n)
        self.docs, self.bytes = self.docs + len(ids), self.bytes + len(flat)

    def rows(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        names = ["shard", "term", "df", "blocks", "places", "counts"]
        ids, n = np.concatenate(self.ids), np.concatenate(self.sizes)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([b""]), pa.array([len(ids)]), pa.array([ids.astype("<i8").tobytes()]), pa.array([n.astype("<i8").tobytes()]), pa.array([b""])], names=names)
        if not self.postings:
            return
        term, place, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        order = np.argsort(term, kind="stable")
        term, place, tf = term[order], place[order], tf[order]
        df = np.bincount(term, minlength=len(self.names))
        first = np.cumsum(df) - df
        head = (np.arange(len(term)) - first[term]) % BLOCK == 0
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, len(term)))
        gaps = np.diff(place, prepend=0)
        gaps[heads] = 0
        blocks = np.zeros(len(heads), _BLOCK)
        blocks["first"], blocks["last"], blocks["size"] = place[heads], place[heads + sizes - 1], sizes
        blocks["top"] = np.maximum.reduceat(impact(tf, length_factor(n, n_docs, n_terms)[place]), heads)
        places, places_at, blocks["place_bits"] = pack(gaps, sizes, heads)
        counts, counts_at, blocks["count_bits"] = pack(tf - 1, sizes, heads)
        # Offsets inside each term's own bytes.
        per = -(-df // BLOCK)
        ends = np.cumsum(per)
        begin = ends - per
        blocks["places_at"], blocks["counts_at"] = places_at - np.repeat(places_at[begin], per), counts_at - np.repeat(counts_at[begin], per)
        cut = lambda at, whole: np.append(at, whole)[ends]
        said = pa.array(list(self.names), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df), shard)), said, pa.array(df), _binaries(blocks.view(np.uint8), ends * _BLOCK.itemsize), _binaries(places, cut(places_at, len(places))), _binaries(counts, cut(counts_at, len(counts)))], names=names)


@dataclass
class LexicalIndex:
    """INDEX, in the shared folder; how many documents hold a term, and how many terms they hold."""

    table: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, shard_bytes: int = 32 << 20, shard_docs: int = 1 << 20) -> LexicalIndex:
    """An index of the whole texts of docs. No shuffle: a task cuts its documents into shards of about shard_bytes of text (or one
    longer text) and writes each shard's lists. The terms of all documents are counted first, as blocks state their greatest
    impact, which depends on the mean length.

    Null or empty text: a document without terms. Null doc_id: kept, before all others. Repeated rows: documents each. Other
    columns are not read. Empty table: an empty index.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            for lo, hi in chunks(off, 1 << 20):
                n = word_spans(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], _TERM)[2]
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n_docs", "n_terms"])

    total = rows.select("text").mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            ids = rb.column("doc_id").to_numpy()
            for lo, hi in chunks(off, 1 << 20):
                shard.add(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ids[lo:hi])
                if shard.bytes >= shard_bytes or shard.docs >= shard_docs:
                    yield from shard.rows(number, n_docs, n_terms)
                    number, shard = number + 1, _Shard()
        if shard.docs:
            yield from shard.rows(number, n_docs, n_terms)

    return LexicalIndex(written(rows.mapInArrow(build, INDEX), "lexical-index"), n_docs, n_terms)


class _Postings:
    """A term's blocks in a shard. Nothing is decompressed before it is asked for, and nothing twice."""

    def __init__(self, blocks: bytes, places: bytes, counts: bytes):
        self.blocks, self.places, self.counts = np.frombuffer(blocks, _BLOCK), places, counts
        self.first, self.last, self.top = (self.blocks[x].astype(np.int64) for x in ("first", "last", "top"))
        self.known: dict[int, np.ndarray] = {}
        self.times: dict[int, np.ndarray] = {}

    def places_of(self, k: int) -> np.ndarray:
        if k not in self.known:
            b = self.blocks[k]
            self.known[k] = np.cumsum(unpack(self.places, int(b["places_at"]), int(b["size"]), int(b["place_bits"]))) + int(b["first"])
        return self.known[k]

    def times_of(self, k: int) -> np.ndarray:
        if k not in self.times:
            b = self.blocks[k]
            self.times[k] = unpack(self.counts, int(b["counts_at"]), int(b["size"]), int(b["count_bits"])) + 1
        return self.times[k]


class ShardSearch:
    """Block-Max WAND in one shard, for ranges of documents at a time: shallow moves read the blocks' bounds only, and split the shard
    where a block begins or ends. A range whose bounds add up to less than the threshold is skipped, and a block that lies in
    such ranges alone is never decompressed. In the others a document is a pivot if the bounds of the blocks that hold it
    reach the threshold; only for pivots are counts decompressed and scores computed. Ranges go by bound, highest first, a few
    and then more at a time, each batch against the threshold that those before have raised."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, postings: dict[bytes, _Postings]):
        self.ids, self.m, self.postings = ids, m, postings

    def best(self, wanted: list[tuple[bytes, int]], top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the documents with the highest scores of at least `least`, equal ones by id; wanted: terms and weights."""
        there = [(self.postings[t], w) for t, w in wanted if w > 0 and t in self.postings]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not there:
            return ids, scores
        of = np.repeat(np.arange(len(there)), [len(p.blocks) for p, _ in there])
        nth = np.concatenate([np.arange(len(p.blocks)) for p, _ in there])
        first, stop = np.concatenate([p.first for p, _ in there]), np.concatenate([p.last for p, _ in there]) + 1
        bound = np.concatenate([p.top * w for p, w in there])
        edges = np.unique(np.concatenate([first, stop]))
        low, high = np.searchsorted(edges, first), np.searchsorted(edges, stop)
        size = len(edges)
        ranges = np.cumsum(np.bincount(low, bound, size) - np.bincount(high, bound, size))[:-1]
        order = np.argsort(-ranges, kind="stable")
        at, take = 0, 4
        while at < len(order) and ranges[order[at]] >= least:
            now = order[at : at + take]
            now = now[ranges[now] >= least]
            at, take = at + take, 4 * take
            open_ = np.zeros(len(ranges), bool)
            open_[now] = True
            before = np.concatenate([[0], np.cumsum(open_)])
            some = np.flatnonzero(before[high] > before[low])
            lists = [there[i][0].places_of(k) for i, k in zip(of[some].tolist(), nth[some].tolist(), strict=True)]
            block = np.repeat(some, [len(x) for x in lists])
            place = np.concatenate(lists)
            inside = open_[np.searchsorted(edges, place, "right") - 1]
            # Sums of integers under 2**53 are exact in doubles.
            reach = np.bincount(place[inside], bound[block[inside]], len(self.ids))
            pivot = inside & (reach[place] >= least)
            held = np.add.reduceat(pivot, np.cumsum([0] + [len(x) for x in lists[:-1]])) > 0
            if not held.any():
                continue
            tf = np.concatenate([there[i][0].times_of(k) if h else np.ones(len(x), np.int64) for i, k, h, x in zip(of[some].tolist(), nth[some].tolist(), held.tolist(), lists, strict=True)])[pivot]
            place, weight = place[pivot], np.array([w for _, w in there])[of[block[pivot]]]
            total = np.bincount(place, weight * impact(tf, self.m[place]), len(self.ids)).astype(np.int64)
            hit = np.flatnonzero(total >= least)
            ids, scores = np.concatenate([ids, self.ids[hit]]), np.concatenate([scores, total[hit]])
            keep = np.lexsort((ids, -scores))[:top]
            ids, scores = ids[keep], scores[keep]
            if len(scores) == top:
                least = max(least, int(scores[-1]))
        return ids, scores


def _items(items: DataFrame) -> list[tuple[int | None, Counter]]:
    """item_id and terms with their repeats, in order of item_id and text."""
    got = items.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    low, starts, ends, n = terms(*text_buffer(got.column("text")))
    raw, out, at = low.tobytes(), [], 0
    for item, k in zip(got.column("item_id").to_pylist(), n.tolist(), strict=True):
        out.append((item, Counter(raw[a:b] for a, b in zip(starts[at : at + k].tolist(), ends[at : at + k].tolist(), strict=True))))
        at += k
    return out


def _found(rows: DataFrame, index: LexicalIndex, queries: list[tuple[int, int | None, list[tuple[bytes, int]], int]], top: int) -> DataFrame:
    """_FOUND of each shard's own best. queries: item, item_id, terms with weights, least score."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def search(t: pa.Table) -> pa.Table:
        postings, ids, m = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for term, blocks, places, counts in zip(*(t.column(x).to_pylist() for x in ("term", "blocks", "places", "counts")), strict=True):
            if term:
                postings[term] = _Postings(blocks, places, counts)
            else:
                ids, m = np.frombuffer(blocks, "<i8"), length_factor(np.frombuffer(places, "<i8"), n_docs, n_terms)
        shard, out = ShardSearch(ids, m, postings), []
        for item, item_id, wanted, least in queries:
            found, scores = shard.best(wanted, top, least)
            out += [(item, item_id, d, s) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
        return pa.table([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], names=["item", "item_id", "doc_id", "score"])

    return rows.groupBy("shard").applyInArrow(search, _FOUND)


def ranked_search(index: LexicalIndex, items: DataFrame, top: int = 20, block_items: int = 2000, block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of highest score above 0 for each row (item_id, text) of items, equal scores by
    ascending doc_id.

    Items go in blocks of bounded number and bytes; their terms are a broadcast of that size. Of the index only the lists of a
    block's terms are shuffled, by shard, and searched shard by shard. About the square root of all shards is searched first;
    the scores that they reach are the threshold in the others, which so skip almost all blocks. Both give exact results.

    Null or empty items, and those without a known term: no rows. Repeated rows of items count once; two texts of one item_id are
    ranked apart. Null item_id: kept.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks, out, item = max(-(-size["n"] // block_items), -(-size["bytes"] // block_bytes)), None, 0
    for b in range(blocks):
        part = _items(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b))
        known = {t for _, words in part for t in words}
        wanted = spark.createDataFrame([(bytearray(t),) for t in sorted(known | {b""})], "term binary")
        rows = written(index.table.join(F.broadcast(wanted), "term", "left_semi"), "lexical-lists")
        df = {bytes(r["term"]): r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = {t: term_weight(df[t], index.n_docs) for t in known if t in df}
        queries = [(item + i, item_id, [(t, k * weight[t]) for t, k in sorted(words.items()) if t in weight], 1) for i, (item_id, words) in enumerate(part)]
        item += len(part)
        every = max(1, math.isqrt(rows.where(F.col("term") == F.lit(b"")).count()))
        primer = F.pmod(F.xxhash64("shard"), F.lit(every)) == 0
        early = written(_found(rows.where(primer), index, queries, top), "lexical-found")
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        reached = {r["item"]: r["score"] for r in early.withColumn("rank", nth).where(F.col("rank") == top).collect()}
        late = _found(rows.where(~primer), index, [(i, x, w, reached.get(i, 1)) for i, x, w, _ in queries], top)
        ranked = early.unionByName(late).withColumn("rank", nth).where(F.col("rank") <= top).select("item_id", "rank", real_id().alias("doc_id"), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_block_max(spark, sf_dir):
    """The 20 best documents of each benchmark item; see ranked_search() and build_index()."""
    from lumaplan.llm.common import table

    return ranked_search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
