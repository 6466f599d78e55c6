import hashlib
import itertools
import random

import numpy as np
import pytest
from fixtures import SCHEMA, rows
from pyspark.sql import functions as F

from lumaplan.llm.bpe import BytePairs, Pieces, bpe_ids, bpe_round_trip, bpe_text, op11_bpe
from lumaplan.llm.token_arrow import PieceEncoder, default_tokenizer, read_token_files, write_token_files


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def coder():
    return BytePairs(default_tokenizer())


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def hard_texts():
    rng = random.Random(1)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = ["".join(x) for n in range(5) for x in itertools.product("aß語\n \t\r\x0b", repeat=n)]
    out += ["".join(rng.choice("a ß語\n \t\r\x0b1'!s<") for _ in range(rng.randrange(12))) for _ in range(5000)]
    out += ["".join(rng.choice(every) for _ in range(rng.randrange(12))) for _ in range(5000)]
    return [*out, "a" * 5000, "ab" * 3000, "<|endoftext|>" * 3 + " x<|endoftext|> y", "漢字" * 500, " " * 1000 + "x", "don't we'll I'd  "]


@pytest.mark.parametrize("kind", [lambda c: Pieces(c), lambda c: PieceEncoder(default_tokenizer())], ids=["merges", "library"])
def test_ids_do_not_depend_on_the_neighbour(plain, coder, kind):
    """All strings of up to four of eight characters, and others, in one batch: each has the ids that it has alone."""
    texts = hard_texts()
    ids, at = kind(coder).encode(*buffers(texts))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [t for i, t in enumerate(texts) if ids[at[i] : at[i + 1]].tolist() != want[i]] == []


def test_every_code_point(plain, coder):
    texts = [f"a{chr(c)}1!" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    assert [t for t, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True) if coder.encode(t) != e.ids] == []


def test_decoding_any_ids(plain, coder):
    rng = random.Random(2)
    some = [[rng.randrange(50257) for _ in range(rng.randrange(6))] for _ in range(3000)]
    flat, at = np.array([i for x in some for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in some])])
    assert list(coder.strings_of(flat, at)) == plain.decode_batch(some, skip_special_tokens=False)


def test_stale_entries_and_ties(coder):
    """The queue against the plain rule: of all pairs next to each other the one of least rank, the leftmost of equals, is joined."""
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"aehnrst ") for _ in range(rng.randrange(30)))
        symbols = [coder.of_byte[b] for b in word]
        while True:
            best = min(((coder.rank[p], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in coder.rank), default=None)
            if best is None:
                break
            symbols[best[1] : best[1] + 2] = [coder.merges[best[0]][2]]
        assert coder.merged(word) == symbols


def test_columns(spark, plain):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    said = docs.select("doc_id", "text", bpe_ids(F.col("text"), default_tokenizer()).alias("ids")).withColumn("back", bpe_text(F.col("ids"), default_tokenizer()))
    got = said.collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["ids"] == plain.encode(r["text"] or "", add_special_tokens=False).ids and r["back"] == (r["text"] or "")
    assert said.limit(0).count() == 0
    once = docs.select("text", bpe_round_trip(F.col("text"), default_tokenizer()).alias("said")).collect()
    assert all(r["said"]["ids"] == plain.encode(r["text"] or "", add_special_tokens=False).ids and r["said"]["text"] == (r["text"] or "") for r in once)
    nothing = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>").select(bpe_text(F.col("ids"), default_tokenizer()).alias("t"))
    assert [r["t"] for r in nothing.collect()] == ["", "", plain.decode([0, 1])]


def test_query(spark, plain, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t, *_ in rows():
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(map(tuple, op11_bpe(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)


def test_token_files_do_not_depend_on_the_shards(spark, tmp_path):
    texts = ["first text\n\n", "second text", "x \n", "\n\n", " y\r\n\r\n", "z", "", "\t\t", "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    one, four = (sorted(map(tuple, read_token_files(write_token_files(docs, f"file://{tmp_path}/{n}", default_tokenizer(), shards=n)).collect())) for n in (1, 4))
    assert one == four
