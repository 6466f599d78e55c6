import hashlib
import re
from collections import defaultdict

import pytest
from fixtures import SCHEMA, rows

from lumaplan.llm.chunk_dedup import chunk_dedup, cut_points
from lumaplan.llm.line_winnow import line_dedup
from lumaplan.llm.prefix_doubling import PAIRS, POSITION, reranked
from lumaplan.llm.suffix_dedup import suffix_dedup

import numpy as np


def brute(docs, units, m):
    """(key of row) -> covered units, from the rule itself."""
    seen = defaultdict(list)
    for doc, row, u in docs:
        for s in range(len(u) - m + 1):
            seen[tuple(u[s : s + m]) if not isinstance(u, bytes) else u[s : s + m]].append((doc, row, s))
    gone = defaultdict(set)
    for places in seen.values():
        for doc, row, s in places:
            if any(d < doc or (d == doc and r == row and t < s) for d, r, t in places):
                gone[row].update(range(s, s + m))
    return gone


def lone(docs, m, words):
    """(key of row) -> lines that are runs by themselves, from the rule itself."""
    whole, long, gone = defaultdict(list), defaultdict(list), defaultdict(set)
    for doc, row, u in docs:
        if 0 < len(u) < m:
            whole[tuple(u)].append(doc)
        for s, line in enumerate(u):
            if len([w for w in re.split("[\x20\x09-\x0d]+", line) if w]) >= words:
                long[line].append((doc, row, s))
    for doc, row, u in docs:
        if 0 < len(u) < m and min(whole[tuple(u)]) < doc:
            gone[row].update(range(len(u)))
        gone[row].update(s for s, line in enumerate(u) if any(d < doc or (d == doc and r == row and t < s) for d, r, t in long.get(line, [])))
    return gone


def runs(xs):
    return sum(x - 1 not in xs for x in xs)


def table():
    return [(-(2**63) if d is None else d, i, (t or "")) for i, (d, t, *_) in enumerate(rows())]


@pytest.mark.parametrize("m,k", [(100, None), (33, None), (7, None), (100, 32), (20, 20), (33, 5)])
def test_suffix_dedup_is_the_rule(spark, m, k):
    docs = [(d, i, t.encode()) for d, i, t in table()]
    gone = brute(docs, None, m)
    want = sorted((d, len(t), len(gone[i]), runs(gone[i]), hashlib.sha256(bytes(b for j, b in enumerate(t) if j not in gone[i])).hexdigest()) for d, i, t in docs)
    got = suffix_dedup(spark.createDataFrame(rows(), SCHEMA).repartition(5), m, k).collect()
    assert want == sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert sum(x[2] for x in want) > 1000


@pytest.mark.parametrize("m,k", [(3, 2), (2, 1), (4, 2)])
def test_line_dedup_is_the_rule(spark, m, k):
    docs = [(d, i, t.split("\n") if t else []) for d, i, t in table()]
    gone = brute(docs, None, m)
    for i, lines in lone(docs, m, 50).items():
        gone[i] |= lines
    want = sorted((d, len(u), len(gone[i]), runs(gone[i]), "\n".join(x for j, x in enumerate(u) if j not in gone[i])) for d, i, u in docs)
    got = line_dedup(spark.createDataFrame(rows(), SCHEMA).repartition(5), m, k).collect()
    assert want == sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_removed"], r["n_runs"], r["kept_text"]) for r in got)


def test_lines_that_are_runs_by_themselves(spark):
    long = " ".join(f"w{i}" for i in range(50))
    texts = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{long}"), (3, long), (4, "one\ntwo"), (5, "one\ntwo"), (6, "one"), (7, "one"), (8, long[4:]), (9, f"e\n{long[4:]}\nf"), (10, "\n"), (11, "\n"), (12, "one\ntwo\nthree"), (None, "one")]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    kept = {1: texts[0][1], 2: "c\nd", 3: "", 4: "one\ntwo", 5: "", 6: "", 7: "", 8: long[4:], 9: texts[8][1], 10: "\n", 11: "", 12: "one\ntwo\nthree", None: "one"}
    assert {k: r["kept_text"] for k, r in got.items()} == kept
    assert {k: r["n_removed"] for k, r in got.items() if r["n_removed"]} == {2: 2, 3: 1, 5: 2, 6: 1, 7: 1, 11: 2}


def test_chunk_dedup_is_the_rule(spark):
    docs, pieces = [(d, i, t.encode()) for d, i, t in table()], {}
    seen = defaultdict(list)
    for d, i, t in docs:
        s, e, _ = cut_points(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 64, 5, 512)
        assert b"".join(t[a:b] for a, b in zip(s, e)) == t
        assert all(64 <= b - a < 576 or b - a == len(t) for a, b in zip(s, e))
        pieces[i] = [(int(a), int(b)) for a, b in zip(s, e)]
        for a, b in pieces[i]:
            seen[t[a:b]].append((d, i, int(a)))
    want = []
    for d, i, t in docs:
        kept = b""
        for a, b in pieces[i]:
            first = any(x < d or (x == d and r == i and c < a) for x, r, c in seen[t[a:b]])
            if not first:
                kept += t[a:b]
        want.append((d, len(t), len(pieces[i]), len(t) - len(kept), hashlib.sha256(kept).hexdigest()))
    got = chunk_dedup(spark.createDataFrame(rows(), SCHEMA).repartition(5)).collect()
    assert sorted(want) == sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_chunks"], r["n_removed"], r["kept_sha256"]) for r in got)


def test_exact_copies_go_whole(spark):
    texts = [t for _, t, *_ in rows() if t]
    made = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, t) for i, t in enumerate(texts)]
    got = chunk_dedup(spark.createDataFrame(made, "doc_id long, text string")).where("doc_id >= 10000").collect()
    assert len(got) == len(texts) and all(r["n_removed"] == r["n_bytes"] for r in got)


def test_chunks_survive_insertions():
    text = bytes(range(32, 127)) * 3 + bytes(i * 37 % 251 for i in range(20000))
    chunks = lambda t: {t[a:b] for a, b in zip(*cut_points(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 64, 5, 512)[:2])}
    a, b = chunks(text), chunks(text[:5000] + b"inserted" + text[5000:])
    assert len(b - a) <= 6


@pytest.mark.parametrize("op", [suffix_dedup, line_dedup, chunk_dedup])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("op", [suffix_dedup, lambda d: suffix_dedup(d, sample_bytes=32), line_dedup, chunk_dedup])
def test_batches_without_a_place(spark, op):
    """Partitions that hold nothing but null, empty and short texts, alone and beside one that holds a repeat."""
    few = [(i, t) for i, t in enumerate([None, "", "x", "y\nz"])]
    more = [(10 + i, "line of some words\n" * 40 + f"{i}") for i in range(2)]
    for made in (few, few + more):
        got = op(spark.createDataFrame(made, "doc_id long, text string").repartitionByRange(len(made), "doc_id")).collect()
        assert len(got) == len(made) and all(r["n_removed"] == 0 for r in got if r["doc_id"] < 10)


def test_groups_over_the_edges_of_partitions(spark):
    made = [(k % 3 if k % 50 else k, 7, k * 31 % 17, k % 5 << POSITION | k) for k in range(4000)]
    got = {(r["doc"], r["place"]): (r["rank"], r["again"]) for r in reranked(spark.createDataFrame(made, PAIRS).repartition(3), 16).collect()}
    groups = defaultdict(list)
    for r1, _, doc, place in made:
        groups[r1].append((doc, place))
    want = {p for g in groups.values() if len(g) > 1 for p in g}
    assert set(got) == want
    for g in groups.values():
        if len(g) > 1:
            assert len({got[p][0] for p in g}) == 1
            for doc, place in g:
                assert got[doc, place][1] == any(d < doc or (d == doc and p >> POSITION == place >> POSITION and p < place) for d, p in g)
    assert len({v[0] for v in got.values()}) == sum(len(g) > 1 for g in groups.values())
