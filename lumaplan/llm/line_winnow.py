"""Line dedup by winnowing: delete later copies of runs of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaplan.llm.common import chunks, keyed, real_id, span_digests, text_buffer, word_spans
from lumaplan.llm.runs import BUCKETS, ENTRY, Units, bucket_count, covered, repeats, settled, to_buckets, with_spans

RESULT = "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string, kept_text string"


def line_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (LF ends one; a text has one more line than LFs, an empty text none), and offsets of texts in them."""
    breaks = np.flatnonzero(flat == 10)
    full = np.diff(offsets) > 0
    begins = offsets[:-1][full]
    starts = np.sort(np.concatenate([begins, breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:][full]]), kind="stable")
    per = np.zeros(len(full), np.int64)
    per[full] = 1 + np.diff(np.searchsorted(breaks, offsets))[full]
    return starts, ends, np.concatenate([[0], np.cumsum(per)])


def line_units(flat: np.ndarray, offsets: np.ndarray) -> Units:
    starts, ends, off = line_spans(flat, offsets)
    return Units(*span_digests(flat, starts, ends), off)


def lone_runs(flat: np.ndarray, offsets: np.ndarray, min_lines: int, min_words: int) -> np.ndarray:
    """What counts as a run with fewer than min_lines lines: each line of min_words words, and each text of fewer lines as a
    whole. ENTRYs with the text's index as doc; low and high are such that covered() gives the lines of the run."""
    starts, ends, of = line_spans(flat, offsets)
    counts, begins = np.diff(of), word_spans(flat, offsets)[0]
    long = np.flatnonzero(np.searchsorted(begins, ends) - np.searchsorted(begins, starts) >= min_words)
    short = np.flatnonzero((counts > 0) & (counts < min_lines))
    text = np.repeat(np.arange(len(counts)), counts)[long]
    e = np.empty(len(long) + len(short), ENTRY)
    e["doc"] = np.concatenate([text, short])
    e["low"] = np.concatenate([long - of[text], np.zeros(len(short), np.int64)])
    e["high"] = np.concatenate([long - of[text], counts[short] - 1]) - (min_lines - 1)
    for part, a, b in ((slice(len(long)), starts[long], ends[long]), (slice(len(long), None), offsets[short], offsets[short + 1])):
        e["k1"][part], e["k2"][part] = span_digests(flat, a, b)
    return e


def line_dedup(docs: DataFrame, min_lines: int = 3, gram_lines: int = 2, min_words: int = 50) -> DataFrame:
    """Deletes each line that lies in a run which also starts earlier (smaller doc_id, or earlier in the same text). A run is
    min_lines lines or more, or a line of min_words words or more, or a whole text of fewer than min_lines lines (equal to a
    whole text).

    Lines are named by 128-bit digests. The fingerprint of each window of min_lines lines is the least name of
    gram_lines lines in it, so equal windows choose the same place. Places of one fingerprint are joined; a match is extended
    both ways over all windows that hold the fingerprint: at once where all of these are equal, else window by window. The
    union of the windows found is the maximal run. A run of fewer lines is its own fingerprint.

    Null or empty text: no lines. Null doc_id: before all other ids. Rows of one
    doc_id: neither is earlier. Empty table: no rows. Other columns are not read.
    """
    rows = keyed(docs)
    buckets = bucket_count(docs)

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            ids, th = rb.column("doc_id").to_numpy(zero_copy_only=False), rb.column("th").to_numpy(zero_copy_only=False)
            parts = []
            for lo, hi in chunks(off):
                e = lone_runs(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], min_lines, min_words)
                t = e["doc"] + lo
                e["doc"], e["th"] = ids[t], th[t]
                parts.append(e)
            yield to_buckets(parts, buckets, True)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            starts, ends, of = line_spans(flat, off)
            out: dict[str, list] = {k: [] for k in ("n_lines", "n_removed", "n_runs", "kept_sha256", "kept_text")}
            for i, spans in enumerate(rb.column("spans").to_pylist()):
                cut, n = covered(spans, min_lines), int(of[i + 1] - of[i])
                raw = flat[off[i] : off[i + 1]].tobytes()
                if len(cut):
                    left = np.ones(n, bool)
                    for a, b in cut.tolist():
                        left[a:b] = False
                    s, e = starts[of[i] : of[i + 1]][left] - off[i], ends[of[i] : of[i + 1]][left] - off[i]
                    raw = b"\n".join(raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True))
                out["n_lines"].append(n)
                out["n_removed"].append(int((cut[:, 1] - cut[:, 0]).sum()))
                out["n_runs"].append(len(cut))
                out["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["kept_text"].append(raw.decode())
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", *out])

    alone = settled(rows.select("doc_id", "th", "text").mapInArrow(lone, BUCKETS), False).select("doc_id", "th", F.array("spans").alias("spans"))
    found = repeats(rows, line_units, gram_lines, min_lines).unionByName(alone)
    found = found.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return with_spans(rows, found).select("doc_id", "text", "spans").mapInArrow(apply, RESULT).withColumn("doc_id", real_id())


def op7_line_winnow(spark, sf_dir):
    from lumaplan.llm.common import table

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256")
