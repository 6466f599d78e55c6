"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaplan.llm.common import written

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def _numerals() -> str:
    """Ranges of characters that count as word characters without being letters or decimal digits: fractions, Roman numerals ..."""
    odd = [c for c in range(0x110000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    heads = [c for c, before in zip(odd, [-2, *odd], strict=False) if c != before + 1]
    tails = [c for c, after in zip(odd, [*odd[1:], -2], strict=True) if c + 1 != after]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(heads, tails, strict=True))


#: Runs of letters (Unicode category L).
WORD = re.compile(rf"[^\W\d_{_numerals()}]+")
#: Characters of a long text that are split into words at a time.
PIECE = 1 << 20
GRAMS = (4, 3, 2, 1)


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case, some at a time; a long text is cut between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        yield WORD.findall(text[at:end].lower())
        at = end


class _Places(dict):
    """word -> its row in the table of scores; a word that is looked up first gets one by backing off."""

    def __init__(self, model: BackoffModel):
        super().__init__(model.words)
        self.model = model
        self.table = np.concatenate([model.word_rows, np.zeros((1024, len(model.langs)))])

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = self.model.unseen(word)
        self[word] = n
        return n


@dataclass
class BackoffModel:
    """Rows of log frequencies less their mean over the languages; languages in order of code points."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    word_rows: np.ndarray
    gram_rows: list[np.ndarray]
    cache_size: int = 300_000
    _places: _Places | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the known n-grams of the longest length that has any; half the weight of a known word."""
        for of, known, rows in zip(GRAMS, self.grams, self.gram_rows, strict=True):
            at = [known[g] for g in grams(word, of) if g in known]
            if at:
                return 0.5 * rows[at].mean(0)
        return np.zeros(len(self.langs))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its share of the likelihood, for a batch of texts: words are looked up and summed all at once."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def add() -> None:
            if not held:
                return
            if self._places is None or len(self._places) > self.cache_size + len(self.words):
                self._places = _Places(self)
            at = np.fromiter(map(self._places.__getitem__, held), np.int64, len(held))
            sizes = np.array([n for _, n in owners])
            sums = np.add.reduceat(self._places.table[at], np.cumsum(sizes) - sizes, axis=0)
            np.add.at(total, [i for i, _ in owners], sums)
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for found in words_of(text or ""):
                if found:
                    count[i] += len(found)
                    held.extend(found)
                    owners.append((i, len(found)))
                if len(held) > 100_000:
                    add()
        add()
        best = total.argmax(1)
        score = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
        return [self.langs[b] if n else "und" for b, n in zip(best.tolist(), count.tolist(), strict=True)], np.where(count > 0, score, 0.0)


def _rows(keys: dict[str, int], counts: np.ndarray, smooth: float) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies of each key, less their mean over the languages."""
    if not keys:
        return {}, np.zeros((0, counts.shape[1]))
    lp = np.log((counts + smooth) / (counts.sum(0) + smooth * len(keys)))
    return keys, lp - lp.mean(1, keepdims=True)


def _labelled(docs: DataFrame, max_docs: int) -> DataFrame:
    """lang and text of about max_docs rows with neither null, shared evenly among the languages and chosen by a hash of id and text.
    A language with fewer rows than its share gives all. The counts of languages are broadcast if there are few of them."""
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    per = written(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "languages")
    n = max(1, per.count())
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("langid")), F.lit(1_000_000)) / F.lit(1e6)
    return docs.join(F.broadcast(per) if n <= 10_000 else per, "lang").where(draw * F.col("of") < max_docs / n).select("lang", "text")


def _counts(rows: DataFrame, key: str, langs: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """Keys in order, and how often each is in each language. rows: a key, lang, n; each key and language once."""
    got = rows.select(key, "lang", "n").toArrow()
    keys = {k: i for i, k in enumerate(sorted(set(got.column(key).to_pylist())))}
    out = np.zeros((len(keys), len(langs)))
    at, lang = ([of[x] for x in got.column(c).to_pylist()] for of, c in ((keys, key), (langs, "lang")))
    out[at, lang] = got.column("n").to_numpy()
    return keys, out


def train_language_id(docs: DataFrame, max_docs: int = 12000, max_words: int | None = None) -> BackoffModel:
    """From text and lang of about max_docs labelled rows; see _labelled(). Words and n-grams are counted by Spark over the whole texts
    of these rows; the driver gets the table of words that occur twice or more, the table of n-grams of all words, and the
    rows' languages: all of it is bounded by those rows. max_words: only so many of the commonest words of each language, for a
    smaller model; by default all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            out = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for rb in batches:
            for text, lang in zip(rb.column("text").to_pylist(), rb.column("lang").to_pylist(), strict=True):
                for found in words_of(text):
                    seen[lang].update(found)
                    if sum(map(len, seen.values())) > 500_000:
                        yield flush()
        yield flush()

    counted = _labelled(docs, max_docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    if max_words is not None:
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        counted = counted.withColumn("nth", nth).where(F.col("nth") <= max_words).drop("nth")
    counted = written(counted, "words")
    langs = {r["lang"]: i for i, r in enumerate(counted.select("lang").distinct().orderBy(F.col("lang").cast("binary")).collect())}
    if not langs:
        return BackoffModel([], {}, [{}] * len(GRAMS), np.zeros((0, 0)), [np.zeros((0, 0))] * len(GRAMS))
    often = counted.groupBy("word").agg(F.sum("n").alias("all")).where("all >= 2").select("word")
    words, word_rows = _rows(*_counts(counted.join(often, "word"), "word", langs), 0.5)
    made = []
    for of in GRAMS:
        marked = F.concat(F.lit("<"), "word", F.lit(">")) if of > 1 else F.col("word")
        cut = F.explode(F.when(F.length(marked) >= of, F.transform(F.sequence(F.lit(1), F.length(marked) - (of - 1)), lambda i: F.substring(marked, i, F.lit(of)))))  # noqa: B023
        made.append(_rows(*_counts(counted.select("lang", "n", cut.alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n")), "gram", langs), 0.5))
    return BackoffModel(list(langs), words, [m[0] for m in made], word_rows, [m[1] for m in made])


def held_out():
    """Rows that training must not see: crc32(doc_id as text) mod 3 is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify_language(docs: DataFrame, model: BackoffModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the prediction's share of the likelihood, 0 to 1).

    Null text or no letter (Unicode category L; fractions, circled and Roman numerals are none) in it: und with score 0. Ties: first language by code point. Null doc_id: kept. Repeated rows:
    one result each. Empty table: no rows. lang, source and doc_id are no inputs of the prediction.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            langs, scores = model.predict(rb.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(predict, RESULT)


def op8_language_id(spark, sf_dir):
    from lumaplan.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, train_language_id(docs.where(~held_out())))
