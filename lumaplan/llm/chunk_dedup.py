"""Substring dedup with content-defined chunks cut by a gear rolling hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumaplan.llm.common import BYTE_NAMES, chunks, keyed, real_id, span_digests, text_buffer
from lumaplan.llm.runs import BUCKETS, ENTRY, bucket_count, covered, settled, to_buckets, with_spans
from pyspark.sql import functions as F

RESULT = "doc_id long, n_bytes long, n_chunks long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
#: The gear: a fixed 32-bit word for each byte value.
GEAR = (BYTE_NAMES >> np.uint64(17)).astype(np.uint32)


def gear_hash(flat: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i-1) + GEAR[byte i] modulo 2**32, by doubling: only the last 32 bytes matter."""
    h, step = GEAR[flat], 1
    while step < 32 and len(h) > step:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, step * 2
    return h


def cut_points(flat: np.ndarray, offsets: np.ndarray, least: int, mean_bits: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk starts, ends and text index. A chunk ends after a byte where the top mean_bits bits of the gear hash are zero,
    after at least `least` and at most `most` bytes, or with its text. A tail under `least` bytes belongs to the chunk before it."""
    h = gear_hash(flat)
    marks = np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1
    starts, ends, text = [], [], []
    first = np.searchsorted(marks, offsets[:-1], "right").tolist()
    end_of = np.searchsorted(marks, offsets[1:], "right").tolist()
    marks = marks.tolist()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = a
        # The first 31 bytes of a text would hash bytes of the one before; no chunk can end there, as least is 32 or more.
        for c in [*marks[first[i] : end_of[i]], b]:
            while c - at > most:
                starts.append(at)
                ends.append(at := at + most)
                text.append(i)
            if c == b and 0 < c - at < least and at > a:
                ends[-1] = at = c
            elif c - at >= least or (c == b and c > at):
                starts.append(at)
                ends.append(at := c)
                text.append(i)
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(text, np.int64)


def chunk_dedup(docs: DataFrame, least: int = 64, mean_bits: int = 5, most: int = 512, keep_bytes: bool = True) -> DataFrame:
    """Removes each chunk whose bytes are also a chunk earlier (smaller doc_id, or same text and earlier start). Chunks have
    `least` to most + least - 1 bytes, shorter only where the whole text is. 128-bit BLAKE2b digests are compared. A repeated
    passage loses the chunks that lie in it whole: of passages of 300 to 500 bytes, 95 percent lose one at least.

    Null text: as empty. Empty text: no chunks. Null doc_id: before all other ids. Rows of one doc_id: neither is earlier.
    Empty table: no rows. Other columns are not read.
    """
    if least < 32:
        raise ValueError("least >= 32: the gear hash looks back 32 bytes")
    rows = keyed(docs)
    buckets = bucket_count(docs)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            ids, th = rb.column("doc_id").to_numpy(zero_copy_only=False), rb.column("th").to_numpy(zero_copy_only=False)
            parts = []
            for lo, hi in chunks(off):
                part, o = flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                s, e, t = cut_points(part, o, least, mean_bits, most)
                x = np.empty(len(s), ENTRY)
                x["k1"], x["k2"] = span_digests(part, s, e)
                x["doc"], x["th"], x["low"], x["high"] = ids[lo:hi][t], th[lo:hi][t], s - o[t], e - o[t] - 1
                parts.append(x)
            yield to_buckets(parts, buckets, True)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            counts = np.zeros(len(off) - 1, np.int64)
            for lo, hi in chunks(off):
                t = cut_points(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], least, mean_bits, most)[2]
                counts[lo:hi] = np.bincount(t, minlength=hi - lo)
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_chunks", "n_removed", "n_spans", "kept_sha256", "kept_bytes")}
            for i, spans in enumerate(rb.column("spans").to_pylist()):
                raw, cut = flat[off[i] : off[i + 1]].tobytes(), covered(spans, 1)
                edges = [0, *cut.ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out["n_bytes"].append(len(raw))
                out["n_chunks"].append(int(counts[i]))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(cut))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept_bytes"].append(kept if keep_bytes else None)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", *out])

    found = settled(rows.select("doc_id", "th", "text").mapInArrow(digests, BUCKETS), False).groupBy("doc_id", "th").agg(F.collect_list("spans").alias("spans"))
    return with_spans(rows, found).select("doc_id", "text", "spans").mapInArrow(apply, RESULT).withColumn("doc_id", real_id())


def op10_chunk_dedup(spark, sf_dir):
    from lumaplan.llm.common import table

    return chunk_dedup(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept_bytes")
