import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SCHEMA, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaplan.llm.block_max import BLOCK, LexicalIndex, ShardSearch, _Postings, build_index, length_factor, op13_block_max, pack, ranked_search, unpack


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for d, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, (d is not None, d or 0), d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:top])]
    return out


def shown(found):
    return sorted(map(repr, map(tuple, found)))


ITEMS = [(1, "bare mi lu to"), (2, None), (3, ""), (4, "one two three one"), (4, "one two three one"), (4, "changed"), (None, "Straße 漢字 X"), (5, "unheard of qqq"), (6, "the short re"), (7, "ba re mi to lu sä ne bare remi milu " * 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.mark.parametrize("shard_bytes", [1, 4000, 1 << 25])
def test_search_is_the_brute_force(spark, docs, shard_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([(r[0], r[1]) for r in rows()], ITEMS)
    assert shown(ranked_search(build_index(docs, shard_bytes), items).collect()) == shown(want)


def test_blocks_of_items(spark, docs):
    items, index = spark.createDataFrame(ITEMS, "item_id long, text string"), build_index(docs, 9000)
    assert shown(ranked_search(index, items, block_items=2).collect()) == shown(ranked_search(index, items).collect())


def test_query_and_empty_tables(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, score string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert shown(op13_block_max(spark, str(tmp_path)).collect()) == shown(brute([(r[0], r[1]) for r in rows()], ITEMS))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(build_index(docs.limit(0)), items).count() == 0
    assert ranked_search(build_index(docs.where("text is null")), items).count() == 0
    assert ranked_search(build_index(docs), items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), min_size=1, max_size=20), min_size=1, max_size=6))
def test_blocks_round_trip(blocks):
    sizes = np.array([len(b) for b in blocks])
    data, at, bits = pack(np.array([v for b in blocks for v in b], np.int64), sizes, np.cumsum(sizes) - sizes)
    assert [unpack(data.tobytes(), int(a), len(b), int(w)).tolist() for a, b, w in zip(at, blocks, bits, strict=True)] == blocks


def shard_of(index: LexicalIndex):
    postings, ids, m = {}, None, None
    for r in index.table.collect():
        if r["term"]:
            postings[bytes(r["term"])] = _Postings(r["blocks"], r["places"], r["counts"])
        else:
            ids, m = np.frombuffer(r["blocks"], "<i8"), length_factor(np.frombuffer(r["places"], "<i8"), index.n_docs, index.n_terms)
    return ShardSearch(ids, m, postings)


def test_skipped_blocks_stay_compressed(spark):
    """Of 20,000 documents with a common word, 30 have rare ones: few blocks of the common word's list are opened, and only they."""
    rng = random.Random(5)
    texts = ["common " + " ".join(f"w{rng.randrange(4000)}" for _ in range(20)) + (" rare words" if 9000 <= i < 9030 else "") for i in range(20000)]
    index = build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id"))
    shard = shard_of(index)
    common, rare = shard.postings[b"common"], shard.postings[b"rare"]
    assert len(common.blocks) == -(-20000 // BLOCK) and len(common.known) == 0
    ids, scores = shard.best([(b"common", 1), (b"rare", 9000)], 20, 1)
    assert len(ids) == 20 and all(9000 <= i < 9030 for i in ids.tolist()) and len(common.known) <= 4 and len(rare.known) == 1
    everything = defaultdict(int)
    for t, w in ((common, 1), (rare, 9000)):
        for k in range(len(t.blocks)):
            for p, tf in zip(t.places_of(k).tolist(), t.times_of(k).tolist(), strict=True):
                everything[p] += w * (1_000_000_000 * tf // (1000 * tf + 12 * int(shard.m[p])))
    assert sorted(((-s, shard.ids[p]) for p, s in everything.items()))[:20] == [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
