"""Texts whose polynomial hashes would be equal (Thue-Morse words and their complements) must stay apart everywhere."""

import numpy as np
import pytest

from lumaplan.llm.common import span_digests, span_hashes
from lumaplan.llm.line_winnow import line_dedup
from lumaplan.llm.minhash_dart import shingles
from lumaplan.llm.token_arrow import PieceEncoder, default_tokenizer


def thue_morse(n: int, a: str, b: str) -> list[str]:
    return [(a, b)[i.bit_count() & 1] for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_spans(n):
    one, two = "".join(thue_morse(n, "a", "b")).encode(), "".join(thue_morse(n, "b", "a")).encode()
    flat, starts, ends = np.frombuffer(one + two, np.uint8), np.array([0, n]), np.array([n, 2 * n])
    assert len(set(span_hashes(flat, starts, ends).tolist())) == 2
    assert all(len(set(x.tolist())) == 2 for x in span_digests(flat, starts, ends))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_token_ids(n):
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(default_tokenizer()), PieceEncoder(default_tokenizer())
    texts = ["".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))]
    flat, off = np.frombuffer("".join(texts).encode(), np.uint8), np.array([0, n, 2 * n])
    ids, at = enc.encode(flat, off)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_token_ids_when_hashes_collide(monkeypatch):
    """Every piece gets the same hash: bytes decide."""
    from tokenizers import Tokenizer

    from lumaplan.llm import token_arrow

    monkeypatch.setattr(token_arrow, "span_hashes", lambda flat, starts, ends: np.zeros(len(starts), np.uint64))
    plain, enc = Tokenizer.from_file(default_tokenizer()), PieceEncoder(default_tokenizer())
    texts = ["one two three", "four", "", "one one one", "four four"]
    flat, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for _ in range(2):
        ids, at = enc.encode(flat, off)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_sequences():
    texts = [" ".join(thue_morse(n, *ab)) for n in (1024, 2048, 4096) for ab in (("abba", "baab"), ("baab", "abba"))]
    flat, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert len(set(shingles(flat, off)[2].tolist())) == 6


def test_lines(spark):
    lines = [["".join(thue_morse(n, *ab)) for n in (1024, 2048, 4096)] for ab in (("a", "b"), ("b", "a"))]
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup(d).collect()] == [0, 0]
