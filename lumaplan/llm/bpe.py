"""Byte-level BPE: merges from a priority queue over a doubly linked list of symbols; decoding by the vocabulary's strings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaplan.llm.common import chunks, ragged, span_hashes, text_buffer
from lumaplan.llm.token_arrow import default_tokenizer, piece_starts, rows_for_the_library

# Code points that the regex module calls letters or numbers, and the tokenizers library, with its older Unicode, neither.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    r"\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_L, _N = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
# The words of byte-level tokenizers; the second pattern is quicker and for texts below the first of those code points.
WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]+|\s+(?!\S)|\s+")
OLD_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is visible in Latin-1, else the next free one from U+0100 on."""
    out, free = [], 256
    for b in range(256):
        seen = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if seen else free))
        free += not seen
    return out


class BytePairs:
    """Vocabulary and merges of a tokenizer file of the tokenizers library: byte-level BPE without normalizer and prefix space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE files are read")
        added = spec.get("added_tokens", [])
        if any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with rules about their neighbours are not read")
        vocab, letters = model["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.of_byte = [vocab[c] for c in letters]
        of_letter = {c: b for b, c in enumerate(letters)}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.strings = [b""] * (max(names) + 1)
        for i, t in names.items():
            self.strings[i] = bytes(of_letter[c] for c in t) if all(c in of_letter for c in t) else t.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Both symbols of each rank, what they become, and the rank of each pair.
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.merges)}
        self.sizes = np.array([len(s) for s in self.strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.strings), np.uint8)
        #: Ids of words: those met of late, and those met before them.
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word. The queue holds rank and place of pairs next to each other; an entry whose symbols have changed since is
        stale and skipped. Equal ranks go from left to right."""
        symbols = [self.of_byte[b] for b in word]
        n, rank, merges = len(symbols), self.rank, self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [r * n + i for i, r in enumerate(map(rank.get, zip(symbols, symbols[1:]))) if r is not None]  # noqa: B905
        heapify(queue)
        while queue:
            r, i = divmod(heappop(queue), n)
            left, right, whole = merges[r]
            j = after[i]
            if symbols[i] != left or j == n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get((whole, symbols[k]))) is not None:
                    heappush(queue, s * n + i)
            h = before[i]
            if h >= 0 and (s := rank.get((symbols[h], whole))) is not None:
                heappush(queue, s * n + h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text: special tokens' strings first, then words, then merges."""
        if not any(t in text for t in self.special):
            return self._words(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[int]:
        out: list[int] = []
        for word in (OLD_WORDS if max(text, default="") < "\u0558" else WORDS).findall(text):
            ids = self.known.get(word)
            if ids is None:
                ids = self.older.get(word)
                if ids is None:
                    ids = self.merged(word.encode())
                if len(word) < 64:
                    if len(self.known) >= 1 << 18:
                        self.known, self.older = {}, self.known
                    self.known[word] = ids
            out += ids
        return out

    def strings_of(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
        """The text of each row of ids: the vocabulary's strings one after another; bytes that are no UTF-8 become U+FFFD."""
        size = self.sizes[ids]
        flat = self.pool[ragged(self.starts[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield flat[a:b].decode("utf-8", "replace")


class Pieces:
    """Encodes each distinct piece of text once; see piece_starts(). Equal pieces are found by hash and then compared byte for
    byte; known ones are kept by their bytes, at most `room` of them, then all are forgotten."""

    def __init__(self, coder: BytePairs, room: int = 1_000_000):
        self.coder, self.room = coder, room
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _slot(self, piece: bytes) -> int:
        slot = self.known.get(piece)
        if slot is None:
            ids, slot = self.coder.encode(piece.decode()), len(self.known)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            if slot == len(self.starts):
                self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
            self.pool[self.used : self.used + len(ids)] = ids
            self.starts[slot], self.lengths[slot] = self.used, len(ids)
            self.used += len(ids)
            self.known[piece] = slot
        return slot

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets of the texts in them."""
        n = len(offsets) - 1
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if len(self.known) > self.room:
            self._clear()
        raw, whole = flat.tobytes(), rows_for_the_library(flat, offsets, list(self.coder.special))
        starts = piece_starts(flat, offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        ends = np.append(starts[1:], len(flat))
        if whole:
            cut = ~np.isin(row, list(whole))
            starts, ends, row = starts[cut], ends[cut], row[cut]
        slot = np.zeros(len(starts), np.int64)
        if len(starts):
            _, first, back = np.unique(span_hashes(flat, starts, ends), return_index=True, return_inverse=True)
            size = ends - starts
            twin = np.array([self._slot(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
            slot = twin[back]
            # Each piece against the first one of its hash.
            short = np.minimum(size, size[first][back])
            differ = flat[ragged(starts, short)] != flat[ragged(starts[first][back], short)]
            other = (np.add.reduceat(differ, np.cumsum(short) - short) > 0) | (size != size[first][back])
            for i in np.flatnonzero(other).tolist():
                slot[i] = self._slot(raw[starts[i] : ends[i]])
        lengths = self.lengths[slot]
        ids = self.pool[ragged(self.starts[slot], lengths)]
        counts = np.bincount(row, lengths, n).astype(np.int64)
        if whole:
            parts, at = [], np.concatenate([[0], np.cumsum(counts)])
            for i in range(n):
                parts.append(np.array(self.coder.encode(raw[offsets[i] : offsets[i + 1]].decode()), np.int32) if i in whole else ids[at[i] : at[i + 1]])
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """One a worker process, so that later tasks find known pieces."""
    if path not in _PIECES:
        _PIECES.clear()
        _PIECES[path] = Pieces(BytePairs(path))
    return _PIECES[path]


def _coded(batches: Iterator[pa.Array], tokenizer: str) -> Iterator[tuple[pa.Array, tuple[np.ndarray, np.ndarray]]]:
    """Ids of texts as lists, and flat with offsets; some 512 KB of text (or one long text) at a time, whatever a batch holds."""
    coder = _pieces(tokenizer)
    for texts in batches:
        flat, off = text_buffer(texts)
        for lo, hi in chunks(off, 1 << 19):
            ids, at = coder.encode(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), (ids, at)


def bpe_ids(text: Column, tokenizer: str) -> Column:
    """array<int>: the ids of a text, without added special tokens, truncation or padding. tokenizer: a file that executors can read.

    Null or empty text: no ids. The string of a special token in a text is that token. A word of n bytes takes O(n log n), so
    very long ones are no special case. Only the texts go to Python; it is a column, so no name of a table can clash.
    """

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids, _ in _coded(batches, tokenizer):
            yield ids

    # Dear to compute: an expression that uses the ids twice must not compute them twice.
    return encode.asNondeterministic()(text.cast("string"))


def bpe_text(ids: Column, tokenizer: str) -> Column:
    """string: what the ids say, special tokens included; bytes that make no UTF-8 become U+FFFD. Null or no ids: empty. An id outside
    the vocabulary is an error."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _pieces(tokenizer).coder
        for rows in batches:
            offsets = rows.offsets.to_numpy()
            flat = rows.values.to_numpy()[offsets[0] : offsets[-1]]
            offsets = (offsets - offsets[0]).astype(np.int64)
            for lo, hi in chunks(offsets, 1 << 18):
                yield pa.array(coder.strings_of(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), pa.string())

    return decode(F.coalesce(ids.cast("array<int>"), F.array().cast("array<int>")))


def bpe_round_trip(text: Column, tokenizer: str) -> Column:
    """struct<ids:array<int>,text:string>: bpe_ids() of a text and bpe_text() of these, in one visit to Python."""

    @F.arrow_udf("struct<ids:array<int>,text:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _pieces(tokenizer).coder
        for ids, (flat, at) in _coded(batches, tokenizer):
            yield pa.StructArray.from_arrays([ids, pa.array(coder.strings_of(flat, at), pa.string())], ["ids", "text"])

    return both.asNondeterministic()(text.cast("string"))


def op11_bpe(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document. Null text: as empty. Null or repeated doc_id: kept, a row each."""
    from lumaplan.llm.common import table

    coded = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), bpe_round_trip(F.col("text"), default_tokenizer()).alias("said"))
    ids = F.col("said.ids")
    return coded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("said.text", 256).alias("decoded_sha256"))
