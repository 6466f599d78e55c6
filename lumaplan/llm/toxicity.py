"""Toxicity by cumulative-link ordinal regression over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaplan.llm.common import chunks, mix, span_hashes, text_buffer, written

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Besides whole words, prefixes of so many bytes are features of longer words: stems with many endings.
PREFIXES = (5, 6, 7, 8)


def lower_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _words(flat, offsets, ())


def stems(flat: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Feature numbers of words and of their prefixes, each with the text they are in, and the number of words of each text."""
    hashes, at, starts, ends = _words(flat, offsets, None)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    low, features, owners = _LOWER[flat], [hashes >> np.uint64(64 - bits)], [text]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        if len(long):
            features.append(mix(span_hashes(low, starts[long], starts[long] + n) + np.uint64(n)) >> np.uint64(64 - bits))
            owners.append(text[long])
    return [f.astype(np.int64) for f in features], owners, np.diff(at)


def _words(flat: np.ndarray, offsets: np.ndarray, also: tuple | None):
    """Hashes of the lower-case words (letters, digits and bytes over 127) of all texts, and offsets of the texts in them."""
    if not len(flat):
        z = np.zeros(0, np.int64)
        return (z.astype(np.uint64), np.zeros(len(offsets), np.int64)) + ((z, z) if also is None else ())
    word = _LETTER[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    found = span_hashes(_LOWER[flat], starts, ends), np.searchsorted(starts, offsets)
    return found + (starts, ends) if also is None else found


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - severity score); the score is `scale` times the weights of a text's words and their
    prefixes, over the root of the number of words."""

    weights: np.ndarray
    cuts: np.ndarray
    scale: float
    bits: int

    def grade_probabilities(self, score: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -40, 40)))
        full = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1)
        return np.diff(full, axis=1)

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for lo, hi in chunks(offsets):
            features, owners, n = stems(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], self.bits)
            total = sum(np.bincount(o, self.weights[f], hi - lo) for f, o in zip(features, owners, strict=True))
            out[lo:hi] = self.scale * total / np.sqrt(np.maximum(n, 1))
        return out


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, bits: int, scale: float = 3.0, steps: int = 800, ridge: float = 1e-7) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows at once; all thresholds share the weights. values: the feature's weight in its row."""
    k = int(grades.max()) if len(grades) else 0
    size = 1 << bits
    if k == 0:
        return OrdinalModel(np.zeros(size, np.float32), np.array([40.0]), scale, bits)
    n = len(grades)
    used, cols = np.unique(cols, return_inverse=True)
    w = np.zeros(len(used))
    share = np.array([(grades <= j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    c = np.log(share / (1 - share))
    raw = np.concatenate([[c[0]], np.log(np.maximum(np.diff(c), 1e-3))])
    m1, m2, r1, r2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)
    x = values * scale
    for t in range(1, steps + 1):
        cuts = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        s = np.bincount(rows, x * w[cols], n)
        padded = np.concatenate([[-40.0], cuts, [40.0]])
        upper, lower = (1 / (1 + np.exp(-np.clip(padded[grades + i] - s, -40, 40))) for i in (1, 0))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = (du - dl) / n
        g = np.bincount(cols, x * ds[rows], len(used)) + ridge * w
        gc = -np.bincount(grades, du / n, k + 1)[:k] + np.bincount(grades, dl / n, k + 1)[1:]
        gr = np.concatenate([[gc.sum()], np.exp(raw[1:]) * np.cumsum(gc[::-1])[::-1][1:]])
        for v, grad, a, b, rate in ((w, g, m1, m2, 0.3), (raw, gr, r1, r2, 0.05)):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.999
            b += 0.001 * grad * grad
            v -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-10)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return OrdinalModel(weights, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]), scale, bits)


def telling(held: np.ndarray, bad: np.ndarray, n: int, n_bad: int, least_z: float) -> np.ndarray:
    """Which features go with grades over 0, or with grade 0, by least_z standard deviations. held, bad: texts, and texts of grades
    over 0, that have the feature."""
    base = np.clip(n_bad / max(n, 1), 1e-6, 1 - 1e-6)
    return np.abs(bad - held * base) >= least_z * np.sqrt(np.maximum(held, 1) * base * (1 - base))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 8000, bits: int = 18, least_z: float = 6.0) -> OrdinalModel:
    """Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality. At most max_train labelled rows are used, those first by a
    hash of their id. Only telling() features get a weight: labels may be noisy, and rare words would learn them by heart. The
    driver gets two counters a feature (2**bits), then each text's telling features. Labels of one id twice: the worst holds.
    Null ids and null labels are left out."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).otherwise(1)
    some = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = written(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            features, owners, _ = stems(flat, off, bits)
            both = np.unique(np.concatenate(owners) << bits | np.concatenate(features))
            bad = rb.column("grade").to_numpy()[both >> bits] > 0
            for i, own in enumerate((both, both[bad])):
                total[i] += np.bincount(own & ((1 << bits) - 1), minlength=1 << bits)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[0][used]), pa.array(total[1][used])], names=["feature", "held", "bad"])

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0)).alias("bad")).first()
    counts = rows.mapInArrow(count, "feature int, held long, bad long").groupBy("feature").agg(F.sum("held").alias("held"), F.sum("bad").alias("bad")).toArrow()
    told = np.zeros(1 << bits, bool)
    feature, held, bad = (counts.column(c).to_numpy() for c in ("feature", "held", "bad"))
    told[feature] = telling(held, bad, size["n"], size["bad"], least_z)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            features, owners, n = stems(flat, off, bits)
            features, owners = np.concatenate(features), np.concatenate(owners)
            both, times = np.unique((owners << bits | features)[told[features]], return_counts=True)
            at = np.searchsorted(both >> bits, np.arange(len(off)))
            col, share = (both & ((1 << bits) - 1)).astype(np.uint32), (times / np.sqrt(np.maximum(n, 1))[both >> bits]).astype(np.float32)
            cols = [col[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            shares = [share[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("grade"), pa.array(cols, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "grade", "cols", "shares"])

    got = rows.mapInArrow(weigh, "doc_id long, grade int, cols binary, shares binary").toArrow().sort_by([("doc_id", "ascending"), ("cols", "ascending")])
    sizes = np.array([len(x) // 4 for x in got.column("cols").to_pylist()], np.int64)
    cols = np.frombuffer(b"".join(got.column("cols").to_pylist()), np.uint32)
    shares = np.frombuffer(b"".join(got.column("shares").to_pylist()), np.float32)
    return fit_ordinal(np.repeat(np.arange(len(sizes)), sizes), cols, shares.astype(np.float64), got.column("grade").to_numpy().astype(np.int64), bits)


SAID = "struct<grade:int,severity:double,p_toxic:double,toxic:boolean>"


def judgement(text: Column, model: OrdinalModel, reject: float = 0.2) -> Column:
    """SAID of a text column: most likely grade, expected grade, P(grade >= 1), and whether that is at least `reject` and some word
    speaks for it. Only the texts go to Python; it is a column, so no name of a table can clash.

    Null or empty text, or one without words: score 0, which the fitted cuts grade. Clean texts score near the share of toxic
    ones among texts without telling words, far below reject.
    """

    @F.arrow_udf(SAID)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = model.scores(*text_buffer(texts))
            p = model.grade_probabilities(scores)
            p0 = 1 - p[:, 0]
            said = [pa.array(p.argmax(1).astype(np.int32)), pa.array((p * np.arange(p.shape[1])).sum(1)), pa.array(p0), pa.array((p0 >= reject) & (scores > 0))]
            yield pa.StructArray.from_arrays(said, ["grade", "severity", "p_toxic", "toxic"])

    return judge(text.cast("string"))


def score_toxicity(docs: DataFrame, model: OrdinalModel, reject: float = 0.2) -> DataFrame:
    """doc_id, grade, severity, p_toxic and toxic of each row of docs; see judgement(). Null doc_id: kept as null. Repeated rows: one
    result each. Empty table: no rows. Other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), judgement(F.col("text"), model, reject).alias("said")).select("doc_id", "said.*")


def op9_toxicity(spark, sf_dir):
    from lumaplan.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
