"""Token ids in Arrow stream-file format: fixed-size-list batches of equal-length sequences and masks."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaplan.llm.common import chunks, fresh_dir, ragged, real_id, shuffle_partitions, span_hashes, text_buffer

RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
#: Bytes of new pieces that are given to the library as one text, about.
JOINED = 1 << 13
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text's first byte, and at white space that a byte of the same text follows which is none."""
    space = _SPACE[flat]
    start = np.zeros(len(flat), bool)
    start[:-1] = space[:-1] & ~space[1:]
    # What follows a text's last byte is another text: it says nothing about this one.
    full = np.diff(offsets) > 0
    start[offsets[1:][full] - 1] = False
    start[offsets[:-1][full]] = True
    return np.flatnonzero(start)


def rows_for_the_library(flat: np.ndarray, offsets: np.ndarray, special: list[str]) -> set[int]:
    """Rows that can't be cut into pieces: they hold white space other than ASCII's, or a special token's string."""
    suspect = (flat >= 0x1C) & (flat <= 0x1F)
    lead = flat[:-1]
    nxt = flat[1:]
    suspect[:-1] |= (lead == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0)) | (lead == 0xE1) & (nxt == 0x9A) | (lead == 0xE2) & ((nxt == 0x80) | (nxt == 0x81)) | (lead == 0xE3) & (nxt == 0x80)
    hit = np.flatnonzero(suspect)
    rows = set((np.searchsorted(offsets, hit, "right") - 1).tolist()) if len(hit) else set()
    raw = flat.tobytes() if special else b""
    for token in special:
        where, at = token.encode(), 0
        while (at := raw.find(where, at)) >= 0:
            rows.add(int(np.searchsorted(offsets, at, "right") - 1))
            at += 1
    return rows


class PieceEncoder:
    """Encodes with the tokenizers library, each distinct piece of text once.

    A piece starts at the last white-space byte before a word. The byte-level pre-tokenizer always splits there, and merges
    never cross its splits, so ids of the pieces joined are the ids of the text. Pieces are grouped by hash and then compared
    byte for byte; known ones are kept by their bytes. Given to the library whole: texts that hold a special token's string,
    white space other than ASCII's, or a piece whose hash another piece has; and all texts of a tokenizer that is not
    byte-level, or has a normalizer or a prefix space.
    """

    def __init__(self, path: str, cache_size: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.kind = np.uint32 if self.wide else np.uint16
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        # A byte-level token has a character for each of its bytes.
        self.bytes_of = np.zeros(max(self.tokenizer.get_vocab_size(), *vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(x) for x in vocab]
        self.joins = self.by_piece and not any(set(s) & set(" \t\n\v\f\r") for s in self.special)
        self.cache_size = cache_size
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, self.kind)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _split(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces that start with white space before a word, and how many each has: they are encoded joined, as the
        pre-tokenizer splits at their starts, and told apart by their tokens' bytes. None: some token goes over a piece's end."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        raw, cuts = b"".join(pieces), np.unique(np.searchsorted(ends, np.arange(JOINED, int(ends[-1]) + JOINED, JOINED)).clip(max=len(ends) - 1))
        bounds = [0, *ends[cuts].tolist()]
        texts = [raw[a:b].decode() for a, b in zip(bounds, bounds[1:]) if b > a]
        ids = np.concatenate([np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        after = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(after, ends)
        if not len(after) or after[-1] != ends[-1] or (after[last] != ends).any():
            return None
        return ids.astype(self.kind), np.diff(last + 1, prepend=0)

    def _learn(self, pieces: list[bytes]) -> None:
        word = [len(p) > 1 and _SPACE[p[0]] and not _SPACE[p[1]] for p in pieces] if self.joins else [False] * len(pieces)
        joined = [p for p, w in zip(pieces, word, strict=True) if w]
        split = self._split(joined) if joined else None
        if split is not None:
            self._keep(joined, *split)
            pieces = [p for p, w in zip(pieces, word, strict=True) if not w]
        if pieces:
            got = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self._keep(pieces, np.fromiter((i for x in got for i in x), self.kind, int(sizes.sum())), sizes)

    def _keep(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(pieces)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + m > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.lengths[n : n + m] = sizes
        self.known.update(zip(pieces, range(n, n + m), strict=True))
        self.used += len(ids)

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets of the texts in them."""
        n = len(offsets) - 1
        if not len(flat):
            return np.zeros(0, self.kind), np.zeros(n + 1, np.int64)
        odd = rows_for_the_library(flat, offsets, self.special) if self.by_piece else set(range(n))
        starts = piece_starts(flat, offsets)
        ends = np.append(starts[1:], len(flat))
        per = np.diff(np.searchsorted(starts, offsets))
        _, first, back = np.unique(span_hashes(flat, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        # Each piece against the first one of its hash, byte for byte.
        same = np.arange(len(flat)) + np.repeat(starts[first][back] - starts, size)
        other = (flat[np.minimum(same, len(flat) - 1)] != flat) | np.repeat(size != size[first][back], size)
        if other.any():
            odd |= set((np.searchsorted(offsets, np.flatnonzero(other), "right") - 1).tolist())
        if len(self.known) > self.cache_size:
            self._clear()
        raw = flat.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        at = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(at) if x is None]
        if odd:
            rows = np.repeat(np.arange(n), per)
            wanted = np.zeros(len(first), bool)
            wanted[back[~np.isin(rows, list(odd))]] = True
            new = [i for i in new if wanted[i]]
        if new:
            self._learn([pieces[i] for i in new])
            for i in new:
                at[i] = self.known[pieces[i]]
        slot = np.array([0 if x is None else x for x in at], np.int64)[back]
        if odd:
            parts = []
            bounds = np.concatenate([[0], np.cumsum(per)])
            for i in range(n):
                if i in odd:
                    parts.append(self.whole(raw[offsets[i] : offsets[i + 1]].decode()))
                else:
                    x = slot[bounds[i] : bounds[i + 1]]
                    parts.append(self.pool[ragged(self.starts[x], self.lengths[x].astype(np.int64))])
            return np.concatenate(parts) if parts else np.zeros(0, self.kind), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        lengths = self.lengths[slot].astype(np.int64)
        ids = self.pool[ragged(self.starts[slot], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.concatenate([[0], np.cumsum(per)])]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One a worker process, so that later tasks find known pieces."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


class _File:
    """An Arrow file that grows batch by batch under a name of its own and is then moved, so a repeated task leaves whole files only."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.name, self.part = name, f"{self.path}/_{name}-{uuid.uuid4().hex}"
        self.sink = self.fs.open_output_stream(self.part)
        self.out = ipc.new_file(self.sink, schema)

    def write(self, batch: pa.RecordBatch) -> None:
        self.out.write_batch(batch)

    def close(self) -> None:
        self.out.close()
        self.sink.close()
        try:
            self.fs.move(self.part, f"{self.path}/{self.name}")
        except OSError:
            # Some stores do not replace files: the same task may have left the same file before.
            if self.fs.get_file_info(f"{self.path}/{self.name}").type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.part)


def _batches(uri: str) -> Iterator[pa.RecordBatch]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path) as f:
        reader = ipc.open_file(f)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


class _Sequences:
    """Writes ids as rows of a fixed length; holds back less than a batch."""

    def __init__(self, file: _File, schema: pa.Schema, kind: np.dtype, sequence: int, batch_rows: int):
        self.file, self.schema, self.kind, self.sequence, self.size = file, schema, kind, sequence, sequence * batch_rows
        self.held: list[np.ndarray] = []
        self.n = 0

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.sequence)
        padded = np.zeros(rows * self.sequence, self.kind)
        padded[: len(ids)] = ids
        mask = np.packbits(np.arange(len(padded)) < len(ids), bitorder="little")
        mask = pa.Array.from_buffers(pa.bool_(), len(padded), [None, pa.py_buffer(mask.tobytes())])
        self.file.write(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(a, self.sequence) for a in (pa.array(padded), mask)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.size:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.size * self.size
            for a in range(0, whole, self.size):
                self._write(ids[a : a + self.size])
            self.held, self.n = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.n:
            self._write(np.concatenate(self.held))
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, sequence: int = 2048, end_id: int | None = 0, batch_rows: int = 256, shards: int | None = None) -> DataFrame:
    """Shards of docs in ascending order of doc_id (then text): the table shard, path, n_docs, n_tokens.

    A shard is two Arrow files: <path>.seq.arrow with ids (fixed_size_list<uint16 or uint32>[sequence]) and mask
    (fixed_size_list<bool>[sequence], false for padding after the shard's last id), uncompressed, so that row i is found and
    mapped without copying; and <path>.doc.arrow with doc_id, start (inside the shard) and n_tokens. Ids of a document may
    go over several sequences. folder is a URI that executors can write. Batches are written as they come: a task holds one
    batch and the longest text, whatever the shard's size is.

    Null text: as empty, so end_id only. Null doc_id: first. Rows of one doc_id: by text. Empty table: no shards.
    """
    parts = shards or shuffle_partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, seq, doc, n_docs, n_tokens = encoder(tokenizer), None, None, 0, 0
        kind = np.dtype(enc.kind)
        seq_schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}"
        for rb in batches:
            if not len(rb):
                continue
            if seq is None:
                seq = _Sequences(_File(folder, f"{name}.seq.arrow", seq_schema), seq_schema, kind, sequence, batch_rows)
                doc = _File(folder, f"{name}.doc.arrow", doc_schema)
            flat, off = text_buffer(rb.column("text"))
            for lo, hi in chunks(off, 1 << 20):
                ids, at = enc.encode(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                seq.add(ids)
                doc.write(pa.RecordBatch.from_arrays([rb.column("doc_id")[lo:hi], pa.array(at[:-1] + n_tokens), pa.array(np.diff(at))], schema=doc_schema))
                n_docs, n_tokens = n_docs + hi - lo, n_tokens + len(ids)
        if seq is not None:
            seq.close()
            doc.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n_docs]), pa.array([n_tokens])], names=["shard", "path", "n_docs", "n_tokens"])

    return ordered.mapInArrow(write, MANIFEST)


def _read_back(path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens and ids_crc32 of a shard's documents; one batch of sequences is held at a time."""
    sequences, ids, at, used = _batches(f"{path}.seq.arrow"), np.zeros(0, np.uint16), 0, 0
    total = 0
    for doc in _batches(f"{path}.doc.arrow"):
        sums = []
        for n in doc.column("n_tokens").to_numpy().tolist():
            crc, total = 0, total + n
            while n:
                if at == len(ids):
                    rb = next(sequences, None)
                    if rb is None:
                        raise ValueError(f"{path}: ids are missing")
                    ids, at, used = rb.column("ids").flatten().to_numpy(), 0, used + rb.column("mask").flatten().true_count
                part = ids[at : at + n]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                at, n = at + len(part), n - len(part)
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([*doc.columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    if used != total:
        raise ValueError(f"{path}: mask and documents differ")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before, over all shards), n_tokens, ids_crc32 of each document, from the files.

    manifest: a row for each shard, as write_token_files() gives it; it is gathered on the driver, a few hundred bytes a
    shard. Null ids come back as null. No shards: no rows.
    """
    spark = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: r["shard"])
    starts = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in shards])]).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for path, base in zip(rb.column("path").to_pylist(), rb.column("base").to_pylist(), strict=True):
                for part in _read_back(path):
                    yield part.set_column(1, "start", pc.add(part.column("start"), base))

    if not shards:
        return spark.createDataFrame([], RESULT)
    paths = spark.createDataFrame([(i, r["path"], starts[i]) for i, r in enumerate(shards)], "n int, path string, base long")
    return paths.repartition(len(shards), "n").select("path", "base").mapInArrow(read, RESULT)


def op3_token_arrow(spark, sf_dir, docs: DataFrame | None = None):
    from lumaplan.llm.common import table

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return read_token_files(write_token_files(docs, fresh_dir(spark, "token-files"), default_tokenizer()))
