"""Helpers that the corpus operators share: tables, the shared work folder, text buffers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in sort orders and hashes: nulls come before every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset on a local master
    (tests). On a cluster there is no folder to fall back to, so an unset one is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='corpus-work-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(2**32 - 1))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id (null: NULL_ID), th (32 bits of a hash of the text, tell rows of one id apart), text (null: empty) and the named columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_hash(text).alias("th"), text.alias("text"), *extra)


def real_id(name: str = "doc_id"):
    """The inverse of what keyed() does to ids."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and len+1 offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = 1 << 18, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about size bytes, and of so many rows at most: numpy temporaries stay in cache, and memory stays bounded
    by the longest text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1), lo + (rows or n))
        yield lo, hi
        lo = hi


C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * C1
    h ^= h >> np.uint64(29)
    h *= C2
    h ^= h >> np.uint64(32)
    return h


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    h = a * C1
    h += b * C2
    h ^= h >> np.uint64(31)
    h *= C3
    h ^= h >> np.uint64(30)
    return h


#: A name for each byte value.
BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * C3)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... start+length-1 of each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


_KEYS = np.zeros(0, np.uint64)


def position_keys(n: int) -> np.ndarray:
    """An independent pseudo-random odd number for each of the first n places. Sums of names times these keys are a multilinear
    hash: no structure of a text (as with powers of one number) makes them equal."""
    global _KEYS
    if len(_KEYS) < n:
        size = 1 << max(10, (n - 1).bit_length())
        _KEYS = mix(mix(np.arange(1, size + 1, dtype=np.uint64) * C1) + C2) | np.uint64(1)
    return _KEYS[:n]


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span [start, end) of flat; spans are in order and don't overlap. For features, signatures
    and looking up; where equal spans decide a result, bytes or span_digests() are compared."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if int(lengths.sum()) == len(flat):
        at = np.arange(len(flat), dtype=np.int64) - np.repeat(starts, lengths)
        value = BYTE_NAMES[flat]
    else:
        idx = ragged(starts, lengths)
        at = idx - np.repeat(starts, lengths)
        value = BYTE_NAMES[flat[idx]]
    value = value * position_keys(int(lengths.max()))[at]
    heads = np.cumsum(lengths) - lengths
    return mix(np.add.reduceat(value, heads) + lengths.astype(np.uint64) * C2)


def span_digests(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit BLAKE2b digest of each span, as uint64."""
    raw = flat.tobytes()
    out = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(out, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(flat: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a kind (not ASCII space), none across rows, and how many each row has."""
    if not len(flat):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    word = inside[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(flat), bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(len(flat), bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts
