"""Suffix-array dedup: remove bytes covered by a long string that starts earlier in the corpus too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumaplan.llm.common import BYTE_NAMES, C2, keyed, mix, real_id, text_buffer
from lumaplan.llm.prefix_doubling import REACH, repeated_starts
from lumaplan.llm.runs import SPAN, Units, covered, repeats, with_spans

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans array<struct<start:long,end:long>>, kept_bytes binary"


_BYTE_TWINS = mix(BYTE_NAMES + C2)


def byte_units(flat: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(BYTE_NAMES[flat], _BYTE_TWINS[flat], offsets)


def as_spans(runs: np.ndarray) -> list[bytes]:
    """Runs of windows, as prefix_doubling packs them, as packed SPANs."""
    s = np.zeros(len(runs), SPAN)
    s["low"] = runs >> REACH
    s["high"] = s["low"] + (runs & (1 << REACH) - 1)
    return [s.tobytes()]


def suffix_dedup(docs: DataFrame, min_bytes: int = 100, sample_bytes: int | None = None, keep_bytes: bool = True) -> DataFrame:
    """Removes each byte covered by a string of min_bytes bytes that also starts earlier (smaller doc_id, or same text and
    earlier start). Prefix doubling: Spark sorts chosen places of all texts by ranks of growing length; see prefix_doubling.py.
    Overlaps count; strings are judged on the input.

    With sample_bytes the same result comes from winnowed names of that many bytes, grouped in buckets; see runs.py.

    Null text: as empty. Empty or short text: nothing removed. Null doc_id: before all other ids. Rows of one doc_id with
    different texts: neither is earlier; equal rows: both get the same result, nothing is removed between them. Empty
    table: no rows. Other columns are not read.
    """
    if min_bytes < 1 or sample_bytes is not None and not 1 <= sample_bytes <= min_bytes:
        raise ValueError("1 <= sample_bytes <= min_bytes")
    rows = keyed(docs)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans", "kept_bytes")}
            for i, spans in enumerate(rb.column("spans")):
                text = flat[off[i] : off[i + 1]]
                found = None if spans.values is None else as_spans(spans.values.to_numpy()) if sample_bytes is None else spans.as_py()
                cut = covered(found, min_bytes)
                left = np.ones(len(text), bool)
                for a, b in cut.tolist():
                    left[a:b] = False
                kept = (text[left] if len(cut) else text).tobytes()
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(cut))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["removed_spans"].append([{"start": a, "end": b} for a, b in cut.tolist()])
                out["kept_bytes"].append(kept if keep_bytes else None)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64()] * 3 + [pa.string(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", *out])

    if sample_bytes is None:
        found = repeated_starts(rows, min_bytes).withColumnRenamed("starts", "spans")
    else:
        found = repeats(rows, byte_units, sample_bytes, min_bytes)
    return with_spans(rows, found).select("doc_id", "text", "spans").mapInArrow(apply, RESULT).withColumn("doc_id", real_id())


def op1_suffix_dedup(spark, sf_dir):
    from lumaplan.llm.common import table

    return suffix_dedup(table(spark, sf_dir, "documents"), keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
