"""Benchmark decontamination by latent semantic retrieval, then longest common subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaplan.llm.common import C3, chunks, keyed, mix, ragged, real_id, text_buffer, written
from lumaplan.llm.runs import name_of
from lumaplan.llm.toxicity import lower_words

BITS = 17
#: Bits of the table that tells which runs of words are in an item, whatever the number of items.
RUN_BITS = 27
#: Words of a block; windows are whole blocks.
STEP = 4
#: Words of a run by which texts are seen to hold a part of an item.
RUN = 3
HITS = "doc_id long, th long, item_id long, cosine double, overlap double, answer double, start long, end long"
_HITS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answer", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def features(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def word_runs(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name of the RUN words from each place on; 0 where the text ends before."""
    if not len(words):
        return words
    name = name_of(words, RUN)
    return np.where(np.arange(len(words)) + RUN <= np.repeat(at[1:], np.diff(at)), name | np.uint64(1), np.uint64(0))


def _bit(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = names >> np.uint64(64 - RUN_BITS)
    return (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def run_table(parts: Iterator[DataFrame]) -> np.ndarray:
    """2**RUN_BITS bits, set for the runs of words of all items; parts: blocks of items. Another run has a set bit by chance with a
    probability of runs / 2**RUN_BITS, and then counts a little less."""
    table = np.zeros(1 << RUN_BITS - 3, np.uint8)
    for part in parts:
        names = word_runs(*lower_words(*text_buffer(part.select("text").toArrow().column("text"))))
        byte, bit = _bit(names[names != 0])
        np.bitwise_or.at(table, byte, bit)
    return table


def document_frequency(docs: DataFrame, runs: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts each hashed word is outside the given runs (a run_table(), that of all benchmark items), over all texts,
    and the number of texts: an item that many texts hold does not make its own words common. 2**BITS counters and
    2**RUN_BITS bits, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, table = np.zeros(1 << BITS, np.int64), 0, shared.value
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            n += len(off) - 1
            for lo, hi in chunks(off, 1 << 20):
                words, at = lower_words(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                both = np.repeat(np.arange(hi - lo), np.diff(at)) << BITS | features(words)
                if len(words):
                    name = word_runs(words, at)
                    byte, bit = _bit(name)
                    of_item = (name != 0) & (table[byte] & bit != 0)
                    inside = of_item.copy()
                    for j in range(1, RUN):
                        inside[j:] |= of_item[:-j]
                    both = both[~inside]
                both = np.sort(both)
                new = np.ones(len(both), bool)
                new[1:] = both[1:] != both[:-1]
                total += np.bincount(both[new] & ((1 << BITS) - 1), minlength=1 << BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], n))], names=["feature", "n"])

    out = np.zeros(1 << BITS)
    got = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    f, n = got.column("feature").to_numpy(), got.column("n").to_numpy()
    out[f[f >= 0]] = n[f >= 0]
    return out, int(n[f < 0].sum())


@dataclass
class Items:
    """A block of benchmark passages: word hashes, the row of each feature in the basis (-1: none), the basis with each row
    weighed by its idf, the items' latent vectors of unit length, and how much of an item's vector (of length 1) lies in the
    basis: an item's cosine with itself."""

    ids: list[int]
    words: list[np.ndarray]
    idf: np.ndarray
    at: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    own: np.ndarray


def _weights(words: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF as (row, feature, weight), a row for each text, of unit length."""
    n = len(offsets) - 1
    both, count = np.unique(np.repeat(np.arange(n), np.diff(offsets)) << BITS | features(words), return_counts=True)
    row, f = both >> BITS, both & ((1 << BITS) - 1)
    w = count * idf[f]
    return row, f, w / np.maximum(np.sqrt(np.bincount(row, w * w, n)), 1e-12)[row]


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, oversample: int = 16, power: int = 1, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and the right singular basis (features x rank) of the passages' TF-IDF matrix A.

    Randomised range finder with oversampling and power iterations, each a distributed pass: Z = A'(A R) with a random R, then
    Z = A'(A Q) for Q = orth(Z), whose rows are summed by feature; last the small Gram matrix of A Q, of whose eigenvectors
    the first `rank` stay. The driver holds at most 2**BITS rows of Z, whatever the number of passages.
    """
    text, wide = passages.select("text"), rank + oversample

    def noise(f: np.ndarray) -> np.ndarray:
        h = mix(f.astype(np.uint64)[:, None] * C3 + np.arange(wide, dtype=np.uint64)[None, :] + np.uint64(seed << 32))
        return np.where(h >> np.uint64(63), 1.0, -1.0)

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in t.column("z").to_pylist())
        return pa.table([t.column("feature")[:1], pa.array([total.tobytes()], pa.binary())], names=["feature", "z"])

    def passed(rows_of: Callable[[np.ndarray], np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and rows of A'(A X), X given by rows of features."""

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                words, at = lower_words(*text_buffer(rb.column("text")))
                row, f, w = _weights(words, at, idf)
                used, back = np.unique(f, return_inverse=True)
                y = np.zeros((len(at) - 1, columns))
                np.add.at(y, row, w[:, None] * rows_of(f))
                z = np.zeros((len(used), columns))
                np.add.at(z, back, w[:, None] * y[row])
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([x.tobytes() for x in z], pa.binary())], names=["feature", "z"])

        got = text.mapInArrow(sketch, "feature int, z binary").groupBy("feature").applyInArrow(add, "feature int, z binary").toArrow().sort_by("feature")
        return got.column("feature").to_numpy().astype(np.int64), np.frombuffer(b"".join(got.column("z").to_pylist())).reshape(-1, columns)

    used, z = passed(noise, wide)
    if not len(used):
        return used, np.zeros((0, rank))
    for _ in range(power):
        q, _ = np.linalg.qr(z)
        _, z = passed(lambda f, q=q: q[np.searchsorted(used, f)], q.shape[1])
    q, _ = np.linalg.qr(z)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((q.shape[1], q.shape[1]))
        for rb in batches:
            words, at = lower_words(*text_buffer(rb.column("text")))
            row, f, w = _weights(words, at, idf)
            y = np.zeros((len(at) - 1, q.shape[1]))
            np.add.at(y, row, w[:, None] * q[np.searchsorted(used, f)])
            g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

    g = sum(np.frombuffer(r["g"]) for r in text.mapInArrow(gram, "g binary").collect()).reshape(q.shape[1], -1)
    values, turn = np.linalg.eigh(g)
    keep = (values > 1e-9 * max(values.max(), 1e-12)) & (np.arange(len(values)) >= len(values) - rank)
    return used, q @ turn[:, keep][:, ::-1]


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; masks: bits of each word's places in the item."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def window_classes(longest: int) -> list[int]:
    """Widths of windows in blocks: each at most a quarter (or one block) wider than the one before, the last for `longest` words."""
    out = [1]
    while out[-1] * STEP < longest:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


class Matcher:
    """Finds items in texts, batch by batch."""

    def __init__(self, items: Items, least_cosine: float, least_overlap: float, least_answer: float):
        self.x, self.least_cosine, self.least_overlap, self.least_answer = items, least_cosine, least_overlap, least_answer
        self.size = np.array([len(w) for w in items.words], np.int64)
        classes = np.array(window_classes(int(self.size.max(initial=1))))
        # Blocks of each item's window, the narrowest that holds it; items without words have none.
        self.window = np.where(self.size > 0, classes[np.searchsorted(classes * STEP, np.maximum(self.size, 1))], 0)
        # Every window is a candidate for an item that the basis does not hold at all.
        self.need = np.where(items.own > 1e-6, least_cosine * items.own, -1.0)
        self.masks: dict[int, tuple[dict[int, int], set[int]]] = {}
        self.answers = np.zeros(1 << BITS, bool)
        #: For each width, the fewest words of an answer that some item of it asks for.
        self.fewest: dict[int, int] = {}
        for i in np.flatnonzero(self.size).tolist():
            answer, width = self._answer(i), int(self.window[i])
            self.answers[features(np.array(list(answer), np.uint64))] = True
            self.fewest[width] = min(self.fewest.get(width, len(answer)), max(1, int(np.ceil(least_answer * len(answer) - 1e-9))))

    def _answer(self, i: int) -> set[int]:
        """The item's rarest quarter of distinct words."""
        u = np.unique(self.x.words[i])
        rare = np.lexsort((u, -self.x.idf[features(u)]))
        return set(u[rare[: max(1, len(u) // 4)]].tolist())

    def _item(self, i: int) -> tuple[dict[int, int], set[int]]:
        """Places of each word, and the answer."""
        if i not in self.masks:
            m: dict[int, int] = {}
            for j, v in enumerate(self.x.words[i].tolist()):
                m[v] = m.get(v, 0) | 1 << j
            self.masks[i] = m, self._answer(i)
        return self.masks[i]

    def find(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, float, float, int, int]]:
        """(text, item, cosine, overlap, answer, first word, end) of the best match of each text and item.

        Each text is cut into blocks of STEP words, followed by empty ones, so that no window leaves its text. A window's vector
        is the difference of two running sums of blocks' vectors. Windows of a class, as wide as its items or up to a quarter
        wider, begin at every quarter of their width. Those with fewer words of answers in reach than any item asks for can't be accepted.
        """
        x, best = self.x, {}
        classes = np.unique(self.window[self.window > 0]).tolist()
        if not classes or not len(words):
            return []
        f = features(words)
        place, g = x.at[f], x.idf[f]
        n = np.diff(at)
        blocks = -(-n // STEP) + classes[-1]
        base = np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(words)) - at[text]
        block = base[:-1][text] + within // STEP
        known = place >= 0
        vec = np.zeros((base[-1] + 1, x.basis.shape[1]))
        for i in range(STEP):  # words of one place in their blocks: no block twice
            of = np.flatnonzero(known & (within % STEP == i))
            vec[block[of] + 1] += x.basis[place[of]]
        np.cumsum(vec, axis=0, out=vec)
        energy = np.concatenate([[0], np.cumsum(np.bincount(block, np.where(known, g * g, 0), base[-1]))])
        telling = np.concatenate([[0], np.cumsum(np.bincount(block, self.answers[f], base[-1]))])
        owner = np.repeat(np.arange(len(n)), blocks)
        filled = np.repeat(-(-n // STEP), blocks)
        nth = np.arange(base[-1]) - base[owner]
        for width in classes:
            half = -(-width // 2)
            start = np.flatnonzero((nth % max(1, width // 4) == 0) & (nth < filled))
            near = telling[np.minimum(start + width + half, base[owner[start] + 1])] - telling[np.maximum(start - half, base[owner[start]])]
            start = start[near >= self.fewest[width]]
            self._windows(words, at, f, base, owner, width, start, vec, energy, best)
        return [(t, i, *v) for (t, i), v in best.items()]

    def _norms(self, words: np.ndarray, f: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Lengths of the TF-IDF vectors of the words [first, stop), over words that an item has."""
        size = stop - first
        word = ragged(first, size)
        row = np.repeat(np.arange(len(first)), size)
        some = self.x.at[f[word]] >= 0
        both, times = np.unique(row[some] << BITS | f[word[some]], return_counts=True)
        return np.sqrt(np.bincount(both >> BITS, (times * self.x.idf[both & (1 << BITS) - 1]) ** 2, len(first)))

    def _windows(self, words, at, f, base, owner, width, starts, vec, energy, best) -> None:
        """Windows of `width` blocks that begin with the given ones, against the items of this width."""
        x, span = self.x, width * STEP
        mine = np.flatnonzero(self.window == width)
        need = self.need[mine]
        # At most 2**22 cosines at a time.
        size = max(64, (1 << 22) // len(mine))
        for s in range(0, len(starts), size):
            j = starts[s : s + size]
            dot = (vec[j + width] - vec[j]).astype(np.float32) @ x.latent[mine].T
            # Repeated words only lengthen a vector, so that this is a cosine or more.
            row, col = np.nonzero(dot >= need * np.sqrt(np.maximum(energy[j + width] - energy[j], 0))[:, None] * 0.9999 - 1e-6)
            if not len(row):
                continue
            texts = owner[j]
            first = at[texts] + (j - base[texts]) * STEP
            used, back = np.unique(row, return_inverse=True)
            norm = self._norms(words, f, first[used], np.minimum(first[used] + span, at[texts[used] + 1]))[back]
            cos = dot[row, col] / np.maximum(norm, 1e-12)
            true = cos >= need[col]
            row, col, cos = row[true], col[true], cos[true]
            begins, ends = np.maximum(at[texts], first - span // 2), np.minimum(at[texts + 1], first + span + span // 2)
            last = -1
            for r, t, i, c, a, b in zip(row.tolist(), texts[row].tolist(), mine[col].tolist(), cos.tolist(), begins[row].tolist(), ends[row].tolist(), strict=True):
                held = best.get((t, i))
                if held and held[1] >= 0.999:
                    continue
                masks, answer = self._item(i)
                if r != last:
                    said, last = words[a:b].tolist(), r
                got = len(answer.intersection(said)) / len(answer)
                if got < self.least_answer:
                    continue
                overlap = common_subsequence(masks, int(self.size[i]), said) / int(self.size[i])
                if overlap >= self.least_overlap and (held is None or (overlap, got) > held[1:3]):
                    best[(t, i)] = (c, overlap, got, a - int(at[t]), b - int(at[t]))


def _block(items: DataFrame, idf: np.ndarray, used: np.ndarray, basis: np.ndarray) -> Items:
    got = items.select("item_id", "text").toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    words, at = lower_words(*text_buffer(got.column("text")))
    where = np.full(1 << BITS, -1, np.int32)
    where[used] = np.arange(len(used))
    row, f, w = _weights(words, at, idf)
    latent = np.zeros((len(at) - 1, basis.shape[1]))
    np.add.at(latent, row, w[:, None] * basis[where[f]])
    own = np.sqrt((latent * latent).sum(1))
    latent /= np.maximum(own, 1e-12)[:, None]
    return Items(got.column("item_id").to_pylist(), [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], idf, where, (basis * idf[used][:, None]).astype(np.float32), latent.astype(np.float32), own)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.35, least_overlap: float = 0.6, least_answer: float = 0.34, rank: int = 96, block_items: int = 20000, block_bytes: int = 32 << 20) -> DataFrame:
    """Rows of HITS: each text and benchmark item it holds, verbatim or paraphrased, with the words [start, end) around it.

    Document frequencies are over all docs, without the words that lie in runs of three words of an item. The TF-IDF matrix of
    all items is factorised once. Texts and items are vectors over the words that some item has, so that strange words beside a
    passage do not count. Windows of an item's length, or up to a quarter more, at every quarter of it, are compared with the
    item's latent vector; where fewer words of answers are in reach than any item asks for, no item can be there, and the window is passed over.
    A window is a candidate if the cosine of its TF-IDF vector reaches least_cosine of the item's cosine with itself, which tells
    how much of the item the basis holds. Candidates stay if a common subsequence of words (the window and half of it on both
    sides) has least_overlap of the item and least_answer of its rarest words are there. Items go in blocks of bounded number
    and bytes, each against all docs: a stated set of queries, compared in slices of 2**22 cosines. Frequencies and basis are
    the same for all blocks, so the number of blocks changes no result.

    Null or empty texts and items: no hits. Null item_id: dropped. Repeated rows of docs: hits each. Empty tables: no rows.
    docs: as keyed() gives it.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    spark = docs.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], HITS)
    blocks = max(-(-size["n"] // block_items), -(-size["bytes"] // block_bytes))
    parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]
    df, n = document_frequency(docs, run_table(iter(parts)))
    idf = np.log((n + 1) / (df + 1)) + 0.05
    used, basis = randomised_svd(items, idf, rank)
    out = None
    for part in parts:
        block = _block(part, idf, used, basis)

        def match(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            m = Matcher(block, least_cosine, least_overlap, least_answer)
            for rb in batches:
                flat, off = text_buffer(rb.column("text"))
                ids, th = rb.column("doc_id").to_pylist(), rb.column("th").to_pylist()
                rows = []
                for lo, hi in chunks(off, 1 << 19, 1024):
                    words, at = lower_words(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    rows += [(ids[lo + t], th[lo + t], block.ids[i], *v) for t, i, *v in m.find(words, at)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_HITS)], schema=_HITS)

        hits = docs.select("doc_id", "th", "text").mapInArrow(match, HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """doc_id, th, contaminated, n_items, item_id (the best match), overlap, cosine of every row of docs. See benchmark_hits()."""
    rows = keyed(docs)
    hits = benchmark_hits(rows, benchmark, **limits).withColumn("order", F.struct(F.col("overlap"), F.col("answer"), -F.col("item_id")))
    best = hits.groupBy("doc_id", "th").agg(F.countDistinct("item_id").alias("n_items"), F.max(F.struct("order", "item_id", "cosine")).alias("best"))
    best = written(best.select("doc_id", "th", "n_items", "best.item_id", F.col("best.order.overlap").alias("overlap"), F.round("best.cosine", 4).alias("cosine")), "hits")
    return rows.select("doc_id", "th").join(best, ["doc_id", "th"], "left").select(real_id().alias("doc_id"), "th", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "overlap", "cosine")


def op5_decontaminate(spark, sf_dir):
    from lumaplan.llm.common import table

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")
