import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumaplan.llm.prefix_trie import ENDS, conversation_trie, end_digests, end_lists, grafted_walk, merged_nodes, numbered_turns, op12_prefix_trie, partial_tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"


def turns():
    rng = random.Random(4)
    said = [(r, t) for r in ("user", "assistant", None, "") for t in ("a b", "a  b c\n", "", None, "x")]
    out = []
    for c in [*range(70), 2000, 2001, 5000, -20, -19, -3]:
        if c % 20 == 0 and c % 3 == 1:
            continue
        for i in range(rng.randrange(1, 6)):
            out.append((c, None if rng.random() < 0.1 else i // 2 if c == 7 else i, *rng.choice(said), "clash", "clash"))
    out += [out[3], (None, 0, "user", "of nobody", "", ""), (9, 0, "user", "long " * 30000, "", ""), *[(33, i, "user", f"t {i % 3}", "", "") for i in range(300)]]
    rng.shuffle(out)
    return out


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
        ends[path].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * words(p[-1][1]) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p] if p in children else 0, leaves[p], saved[p], digest(p)) for p, m in nodes.items()]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_is_the_brute_force(spark, tmp_path):
    spark.createDataFrame(turns(), SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_prefix_trie(spark, str(tmp_path)).select(COLUMNS).collect()
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(turns()), key=key)


def test_no_conversations(spark):
    none = spark.createDataFrame([(None, 1, "user", "of nobody", "", "")], SCHEMA)
    assert conversation_trie(grafted_walk(none)).count() == 0


def test_copies_of_one_conversation(spark):
    """A third of all conversations are one: its end list goes over many rows, none longer than ENDS."""
    n = 3 * ENDS + 10
    turns = spark.range(n).select(F.col("id").alias("conv_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 3 == 0, "same words").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"))
    rows = numbered_turns(turns)
    walk = rows.unionByName(rows.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words")).distinct())
    partials = partial_tries(walk, room=500)
    lists = end_lists(partials.where("kind = 1"))
    assert lists.agg(F.max(F.size("ends"))).first()[0] <= ENDS
    same = [i for i in range(n) if i % 3 == 0]
    want = hashlib.sha256(",".join(map(str, same)).encode()).hexdigest()
    assert want in {r["ends_sha256"] for r in end_digests(lists).collect()}
    trie = {(r["conv_id"], r["depth"]): r for r in conversation_trie(walk).collect()}
    assert (trie[0, 0]["n_convs"], trie[0, 0]["n_leaves"], trie[0, 2]["n_convs"], trie[0, 2]["saved_tokens"]) == (n, n - len(same) + 1, len(same), 2 * (len(same) - 1))
    assert trie[1, 1]["parent_conv_id"] == 0 and trie[0, 0]["parent_conv_id"] is None


@pytest.mark.parametrize("fan_in", [2, 64])
def test_merging_in_rounds(spark, fan_in):
    walk = grafted_walk(spark.createDataFrame(turns(), SCHEMA))
    partials = partial_tries(walk, room=7).where("kind = 0").cache()
    parts = partials.agg(F.max("part")).first()[0] + 1
    key = lambda r: (r[3], r[2])
    rows = sorted(map(tuple, merged_nodes(partials, parts, fan_in).collect()), key=key)
    assert len(rows) == len({r[0] for r in rows}) and sum(r[4] for r in rows) == partials.agg(F.sum("n")).first()[0]
