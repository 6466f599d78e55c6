import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fixtures import SCHEMA, rows
from lumaplan.llm.common import keyed
from lumaplan.llm.prefix_doubling import BLOCKS, HULL_BITS, POSITION, REACH, SEGMENT, blocks, lean, reranked, sizes
from lumaplan.llm.suffix_dedup import suffix_dedup


@pytest.mark.parametrize("m,few", [(100, 12), (33, 4), (7, 1), (1, 0)])
def test_chosen_places_hold_each_window_once(spark, m, few):
    """A sort of all places writes a row a byte; of ordinary text one in some m / 3 is enough."""
    docs = keyed(spark.createDataFrame(rows(), SCHEMA)).dropDuplicates(["doc_id", "th"])
    held = defaultdict(list)
    for r in blocks(docs, m).collect():
        low = r["place"] & (1 << POSITION) - 1
        held[r["doc"], r["place"] >> POSITION] += range(low, low + (r["reach"] >> REACH) + 1)
    texts = {(r["doc_id"], r["th"]): len(r["text"].encode()) for r in docs.collect()}
    assert {k: sorted(v) for k, v in held.items()} == {k: list(range(n - m + 1)) for k, n in texts.items() if n >= m}
    plain = docs.where("length(text) > 700")
    assert blocks(plain, m).count() * few < plain.agg(F.sum(F.octet_length("text"))).first()[0]


def test_block_sizes():
    assert sizes(100) == [64, 8, 1] and sizes(33) == [16, 2, 1] and sizes(7) == [4, 1] and sizes(1) == [1]
    assert all(s[0] <= m and all(a % b == 0 for a, b in zip(s, s[1:])) for m in range(1, 20000, 7) for s in [sizes(m)])


def test_repeats_over_the_edges_of_segments(spark):
    rng = random.Random(3)
    fresh = lambda n, letters="ABCDEFGH": "".join(rng.choice(letters) for _ in range(n))
    long = fresh(2 * SEGMENT + 5000, "abcdefgh")
    other = fresh(300) + long[SEGMENT - 150 : SEGMENT + 170] + fresh(200) + long[2 * SEGMENT - 99 : 2 * SEGMENT + 1] + "!" + long[2 * SEGMENT - 49 : 2 * SEGMENT + 50] + "?"
    twice = long + long[SEGMENT - 60 : SEGMENT + 60]
    made = [(1, twice), (2, other), (3, other), (3, other), (3, "z" + other[1:]), (None, long[:150])]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], tuple(map(tuple, r["removed_spans"]))) for r in suffix_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect())
    n, whole = len(other), ((0, len(other)),)
    want = [(0, 150, ()), (1, len(twice), ((0, 150), (len(long), len(twice)))), (2, n, ((300, 620), (820, 920))), (3, n, whole), (3, n, whole), (3, n, ((1, n),))]
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_cores_and_hulls_over_the_edges_of_partitions(spark, seed):
    """Groups of one core with several hulls, and the same place more than once, dealt over more partitions than there are groups."""
    rng = random.Random(seed)
    made = [(rng.choice([1, 2, 5 + k]) << HULL_BITS | rng.randrange(2), rng.randrange(2), rng.randrange(4), rng.randrange(2) << POSITION | rng.randrange(30), 7) for k in range(300)]
    made += [(9 << HULL_BITS, 0, 1, 5, 7)] * 90 + [(9 << HULL_BITS, 0, 1, 6, 7)] * 3
    got = reranked(spark.createDataFrame(made, BLOCKS).repartition(3), 24, HULL_BITS).collect()
    cores, hulls = defaultdict(list), defaultdict(list)
    for r1, r2, doc, place, _ in made:
        cores[r1 >> HULL_BITS].append((doc, place))
        hulls[r1, r2].append((doc, place))
    want = sorted((doc, place, any(d < doc or (d == doc and p >> POSITION == place >> POSITION and p < place) for d, p in hulls[r1, r2])) for r1, r2, doc, place, _ in made if len(cores[r1 >> HULL_BITS]) > 1)
    assert sorted((r["doc"], r["place"], r["again"]) for r in got) == want
    assert len({r["rank"] for r in got}) == sum(len(g) > 1 for g in cores.values()) and {r["reach"] for r in got} == {7}


def test_setting_is_as_before(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    assert lean(spark.range(1000).repartition(3, "id"), "some").count() == 1000 and spark.conf.get(key) == before
