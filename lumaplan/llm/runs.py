"""Repeats of at least M units (bytes, lines) across a corpus: find what starts earlier too, as intervals of units.

Names stand for substrings: name_1 is a unit's hash, and name_2h(p) is named after the pair (name_h(p), name_h(p+h)).
Doubling is local to a text. Of all positions only content-chosen ones go on to Spark: the smallest k-unit name in each
window of M units (the guaranteed fingerprint of winnowing). Two equal windows choose the same place, so each window is
held by one chosen place, and each chosen place p holds the consecutive windows that start in [low, high].

  level 1: places sorted by name_k; a place with a unique name leaves, as all windows it holds are unique.
  level 2: places of one name sorted by the name of all that their windows cover; all but the earliest leave, as wholly
           repeated.
  level 3: where a name has different surroundings, the windows themselves sorted by name_M, until the threshold.

Names of a map task go to buckets as packed arrays after equal ones of the task were merged; so a group of thousands of
copies sends one entry a task, and no row of a shuffle holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaplan.llm.common import C1, join2, keyed, mix, ragged, shuffle_partitions, written

#: One chosen place, window or chunk, as it goes to its bucket.
ENTRY = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("low", "<i4"), ("high", "<i4")])
SPANS = "doc_id long, th long, ask boolean, spans binary"
SPAN = np.dtype([("key", "<u8"), ("low", "<i4"), ("high", "<i4")])
_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("ask", pa.bool_()), ("spans", pa.binary())])
_BUCKETS_ARROW = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("spans", pa.binary())])
BUCKETS = "bucket int, entries binary, doc_id long, th long, spans binary"


@dataclass(frozen=True)
class Units:
    """name_1 of all units of some texts, the same in a second family of names, and len+1 offsets of the texts in them. A place
    counts as repeated only if its names in both families are equal: 128 bits."""

    names: np.ndarray
    twins: np.ndarray
    offsets: np.ndarray


_HALF = np.uint64(2**32 - 1)
#: Units of a long text that are named at a time.
SEGMENT = 1 << 21


def name_of(names: np.ndarray, length: int) -> np.ndarray:
    """name_length by doubling; position p is meaningful only if p+length is still inside its text."""
    x, h = names, 1
    while 2 * h <= length:
        y = x.copy()
        if len(x) > h:
            y[: len(x) - h] = join2(x[: len(x) - h], x[h:])
        x, h = y, 2 * h
    if h < length:
        y, shift = x.copy(), length - h
        if len(x) > shift:
            y[: len(x) - shift] = join2(x[: len(x) - shift], x[shift:]) + np.uint64(length)
        x = y
    return x


def window_names(names: np.ndarray, m: int) -> np.ndarray:
    """name_m of every window of one text, segment by segment."""
    n = max(0, len(names) - m + 1)
    out = np.empty(n, np.uint64)
    for s in range(0, n, SEGMENT):
        e = min(n, s + SEGMENT)
        out[s:e] = name_of(names[s : e + m - 1], m)[: e - s]
    return out


def chosen(u: Units, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text index, low, high (offsets inside the text), name_k and surroundings' name of each chosen place."""
    n, w = len(u.names), m - k + 1
    lengths = np.diff(u.offsets)
    if len(lengths) == 1 and n - m + 1 > SEGMENT:
        parts = []
        for s in range(0, n - m + 1, SEGMENT):
            e = min(n, s + SEGMENT + m - 1)
            t, low, high, *names = chosen(Units(u.names[s:e], u.twins[s:e], np.array([0, e - s])), k, m)
            parts.append((t, low + s, high + s, *names))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    windows = np.maximum(lengths - m + 1, 0)
    if not windows.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    name_k, name_m = name_of(u.names, k), name_of(u.twins, m)
    bits = np.uint64(max(1, int(n).bit_length()))
    order = mix(name_k) >> bits << bits | np.arange(n, dtype=np.uint64)
    low, h = order, 1
    while 2 * h <= w:
        nxt = low.copy()
        nxt[: n - h] = np.minimum(low[: n - h], low[h:])
        low, h = nxt, 2 * h
    if h < w:
        nxt = low.copy()
        nxt[: n - (w - h)] = np.minimum(low[: n - (w - h)], low[w - h :])
        low = nxt
    start = ragged(u.offsets[:-1], windows)
    text = np.repeat(np.arange(len(lengths)), windows)
    place = (low[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.empty(len(start), bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    s0, s1, p, t = start[first], start[last], place[first], text[first]
    around = join2(join2(name_m[s0], name_m[s1]), ((s1 - s0) * 65536 + (p - s0)).astype(np.uint64) * C1)
    return t, s0 - u.offsets[t], s1 - u.offsets[t], name_k[p], around


def _first_of(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts entries by (k1, k2, doc, th, low). Gives them, a mask of those that are repeats (an equal entry has a smaller
    doc, or is earlier in the same text), and the smallest doc of each one's group."""
    e = e[np.lexsort((e["low"], e["th"], e["doc"], e["k2"], e["k1"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["k1"][1:] != e["k1"][:-1]) | (e["k2"][1:] != e["k2"][:-1])
    least = e["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.zeros(len(e), bool)
    again[1:] = ~new[1:] & (e["doc"][1:] == e["doc"][:-1]) & (e["th"][1:] == e["th"][:-1]) & (e["low"][1:] != e["low"][:-1])
    return e, (e["doc"] > least) | again, new


def _by_text(e: np.ndarray, ask: bool, keep_keys: bool) -> dict[str, list]:
    """Rows of SPANS: the spans of each text together."""
    out: dict[str, list] = {"doc_id": [], "th": [], "ask": [], "spans": []}
    if not len(e):
        return out
    e = e[np.lexsort((e["low"], e["th"], e["doc"]))]
    s = np.empty(len(e), SPAN)
    s["key"], s["low"], s["high"] = (e["k1"] if keep_keys else 0), e["low"], e["high"]
    cut = np.flatnonzero((e["doc"][1:] != e["doc"][:-1]) | (e["th"][1:] != e["th"][:-1])) + 1
    heads = np.concatenate([[0], cut])
    tails = np.append(heads[1:], len(e))
    out["doc_id"], out["th"], out["ask"] = e["doc"][heads].tolist(), e["th"][heads].tolist(), [ask] * len(heads)
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        out["spans"].append((s[a:b] if keep_keys else merged(s[a:b])).tobytes())
    return out


def merged(s: np.ndarray) -> np.ndarray:
    """Spans sorted by low, those that touch joined."""
    if len(s) < 2:
        return s
    top = np.maximum.accumulate(s["high"])
    new = np.ones(len(s), bool)
    new[1:] = s["low"][1:] > top[:-1]
    heads = np.flatnonzero(new)
    out = s[heads].copy()
    out["high"] = top[np.append(heads[1:], len(s)) - 1]
    return out


def pack(e: np.ndarray) -> bytes:
    """Entries column by column, and of each 64-bit column first all low halves, then all high ones, which are often zero: shuffles
    compress this better than rows."""
    wide = [e[c].view("<u8") for c in ("k1", "k2", "doc", "th")]
    halves = [h.astype("<u4").tobytes() for c in wide for h in (c, c >> np.uint64(32))]
    return b"".join([*halves, e["low"].tobytes(), (e["high"] - e["low"]).tobytes()])


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // ENTRY.itemsize
    columns = np.frombuffer(data, "<u4").reshape(-1, n)
    e = np.empty(n, ENTRY)
    for i, c in enumerate(("k1", "k2", "doc", "th")):
        e[c] = (columns[2 * i].astype("<u8") | columns[2 * i + 1].astype("<u8") << np.uint64(32)).view(ENTRY[c])
    e["low"], e["high"] = columns[8].view("<i4"), columns[8].view("<i4") + columns[9].view("<i4")
    return e


def to_buckets(parts: list[np.ndarray], buckets: int, spread: bool) -> pa.RecordBatch:
    """The entries of one batch, equal ones merged, packed by bucket; repeats inside the batch are settled at once. spread: by k1
    and k2, so that one k1 with many k2 is no bucket of its own."""
    e, again, _ = _first_of(np.concatenate(parts) if parts else np.zeros(0, ENTRY))
    done = _by_text(e[again], False, False)
    e = e[~again]
    b = (mix(e["k1"] ^ (e["k2"] if spread else C1)) % np.uint64(buckets)).astype(np.int32)
    e = e[np.argsort(b, kind="stable")]
    b = np.sort(b, kind="stable")
    ids, heads = np.unique(b, return_index=True)
    edges = [*heads.tolist(), len(e)]
    packed = [pack(e[x:y]) for x, y in zip(edges, edges[1:])]
    n, d = len(packed), len(done["doc_id"])
    dealt = (np.arange(d) % buckets).astype(np.int32) if d else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ids.astype(np.int32), dealt])), pa.array(packed + [None] * d, pa.binary()), pa.array([None] * n + done["doc_id"], pa.int64()), pa.array([None] * n + done["th"], pa.int64()), pa.array([None] * n + done["spans"], pa.binary())], schema=_BUCKETS_ARROW)


def _reduce(levels: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def settle(t: pa.Table) -> pa.Table:
        packed = t.column("entries").drop_null().to_pylist()
        e = np.concatenate([unpack(x) for x in packed]) if packed else np.zeros(0, ENTRY)
        del packed
        ready = t.filter(pa.compute.is_valid(t.column("spans")))
        e, again, new = _first_of(e)
        rows = [_by_text(e[again], False, False)]
        if levels and len(e):
            firsts = np.flatnonzero(new)
            k1 = e["k1"][firsts]
            several = np.zeros(len(firsts), bool)
            same = k1[1:] == k1[:-1]
            several[1:] |= same
            several[:-1] |= same
            rows.append(_by_text(e[~again & several[np.cumsum(new) - 1]], True, True))
        rows = [pa.table([pa.array(r[c], f.type) for c, f in zip(_SPANS_ARROW.names, _SPANS_ARROW, strict=True)], schema=_SPANS_ARROW) for r in rows]
        rows.append(pa.table([ready.column("doc_id"), ready.column("th"), pa.array([False] * len(ready), pa.bool_()), ready.column("spans")], schema=_SPANS_ARROW))
        return pa.concat_tables(rows)

    return settle


def settled(packed: DataFrame, levels: bool) -> DataFrame:
    """Rows of SPANS from rows of BUCKETS: repeats (ask false), and places that need their windows compared (ask true)."""
    return packed.groupBy("bucket").applyInArrow(_reduce(levels), SPANS)


def bucket_count(docs: DataFrame) -> int:
    return shuffle_partitions(docs.sparkSession) * 2


def repeats(docs: DataFrame, units_of: Callable[[np.ndarray, np.ndarray], Units], k: int, m: int) -> DataFrame:
    """doc_id, th, spans (list of packed SPANs: first units of windows that start earlier too). docs: as keyed() gives it."""
    from lumaplan.llm.common import chunks, text_buffer

    buckets = bucket_count(docs)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            ids, th = rb.column("doc_id").to_numpy(zero_copy_only=False), rb.column("th").to_numpy(zero_copy_only=False)
            parts = []
            for lo, hi in chunks(off):
                t, low, high, k1, k2 = chosen(units_of(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), k, m)
                e = np.empty(len(t), ENTRY)
                e["k1"], e["k2"], e["doc"], e["th"], e["low"], e["high"] = k1, k2, ids[lo:hi][t], th[lo:hi][t], low, high
                parts.append(e)
            yield to_buckets(parts, buckets, False)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            parts = []
            for i, (doc, th, asked) in enumerate(zip(rb.column("doc_id").to_pylist(), rb.column("th").to_pylist(), rb.column("asked").to_pylist(), strict=True)):
                u = units_of(flat[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                name_m = window_names(u.twins, m)
                s = np.concatenate([np.frombuffer(x, SPAN) for x in asked])
                n = (s["high"] - s["low"] + 1).astype(np.int64)
                at = ragged(s["low"].astype(np.int64), n)
                e = np.empty(len(at), ENTRY)
                # Half of the place's name is enough beside the window's own: 96 bits in all.
                e["k1"], e["k2"], e["doc"], e["th"], e["low"], e["high"] = np.repeat(s["key"] & _HALF, n), name_m[at], doc, th, at, at
                parts.append(e)
            yield to_buckets(parts, buckets, True)

    first = written(settled(docs.select("doc_id", "th", "text").mapInArrow(places, BUCKETS), True), "repeats")
    asked = first.where("ask").groupBy("doc_id", "th").agg(F.collect_list("spans").alias("asked"))
    some = docs.select("doc_id", "th", "text").join(asked, ["doc_id", "th"])
    more = settled(some.mapInArrow(windows, BUCKETS), False)
    found = first.where("not ask").select("doc_id", "th", "spans").unionByName(more.select("doc_id", "th", "spans"))
    return found.groupBy("doc_id", "th").agg(F.collect_list("spans").alias("spans"))


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each row of docs with its spans; null if it has none."""
    return docs.join(found, ["doc_id", "th"], "left")


def covered(spans: list[bytes] | None, m: int) -> np.ndarray:
    """Maximal [start, end) of units that the windows starting in the spans cover."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    s = np.concatenate([np.frombuffer(x, SPAN) for x in spans])
    s = np.sort(s, order="low").copy()
    s["high"] += m
    s = merged(s)
    return np.stack([s["low"], s["high"]], 1).astype(np.int64)
