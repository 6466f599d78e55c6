import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_others import lcs

from lumaplan.llm.common import keyed
from lumaplan.llm.decontaminate import STEP, benchmark_hits, decontaminate, window_classes


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")


def test_windows_are_near_an_items_length():
    classes = window_classes(5000)
    for n in range(1, 5001):
        width = next(c for c in classes if c * STEP >= n)
        assert width * STEP <= max(n * 1.25, n + STEP) + STEP


@pytest.mark.parametrize("repeat", [False, True])
def test_verbatim_passages_between_rare_words(spark, repeat):
    """Items of common words, 16 to 70 long, four times each between words that are nowhere else (or one of another item's, again and
    again): all are found, and nothing else."""
    rng = random.Random(31)
    vocabulary = [f"{a}{b}" for a in ("ba", "re", "mi", "to", "lu", "ne", "sa", "po") for b in ("n", "l", "st", "r", "m", "d", "k", "t")]
    sizes = [16, 17, 18, 20, 22, 24, 28, 30, 32, 33, 34, 36, 38, 40, 44, 48, 52, 56, 60, 64, 65, 66, 68, 70]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in sizes]
    strange = lambda: [f"{rng.getrandbits(48):x}" for _ in range(60)]
    around = lambda i: [rng.choice(items[(i + 7) % 24])] * 60 if repeat else strange()
    docs = [(i, " ".join([rng.choice(vocabulary) for _ in range(rng.randrange(50, 200))])) for i in range(300)]
    docs += [(1000 + i, " ".join(around(i % 24)[rng.randrange(9) :] + items[i % 24] + around(i % 24))) for i in range(96)]
    d, bench = frames(spark, docs, [(i, " ".join(w)) for i, w in enumerate(items)])
    found = {(r["doc_id"], r["item_id"]) for r in benchmark_hits(keyed(d), bench).where("overlap > 0.999").collect()}
    assert {(1000 + i, i % 24) for i in range(96)} <= found


def test_paraphrases_of_any_degree(spark):
    """Of all plantings that keep 0.6 or more of an item in order, nine in ten are found, and of those of 0.6 to 0.75 four in five."""
    rng = random.Random(33)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    draw = lambda n: [vocabulary[int(3000 * rng.random() ** 2.5)] for _ in range(n)]
    items, made, share = [draw(rng.randrange(20, 70)) for _ in range(60)], [], {}
    for i in range(300):
        body, k = draw(rng.randrange(40, 300)), i % 60
        rate, w = rng.uniform(0, 0.5), []
        for x in items[k]:
            w += [x] if rng.random() > rate else rng.choice([[], draw(1)])
        share[i] = k, lcs(items[k], w) / len(items[k])
        at = rng.randrange(len(body))
        made.append((i, " ".join(body[:at] + w + body[at:])))
    d, bench = frames(spark, made, [(i, " ".join(w)) for i, w in enumerate(items)])
    found = {(r["doc_id"], r["item_id"]) for r in benchmark_hits(keyed(d), bench).collect()}
    must = {(i, k) for i, (k, s) in share.items() if s >= 0.6}
    weak = {(i, k) for i, (k, s) in share.items() if 0.6 <= s < 0.75}
    assert len(weak) > 50 and len(found & must) >= 0.9 * len(must) and len(found & weak) >= 0.8 * len(weak)


def test_the_cosine_is_one_and_blocks_change_nothing(spark):
    rng = random.Random(32)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    items = [[rng.choice(names[i : i + 60]) for _ in range(rng.randrange(16, 70))] for i in range(24)]
    docs = [(i, " ".join([rng.choice(names) for _ in range(80)] + (items[i % 24] if i % 2 else []) + [rng.choice(names) for _ in range(50)])) for i in range(120)]
    docs += [(500 + i, " ".join(w)) for i, w in enumerate(items)]
    d, bench = frames(spark, docs, [(i, " ".join(w)) for i, w in enumerate(items)])
    one, six = ({tuple(r) for r in benchmark_hits(keyed(d), bench, block_items=n).collect()} for n in (24, 4))
    short = lambda rows: {(r[0], r[2], round(r[3], 4), *r[4:]) for r in rows}
    assert short(one) == short(six) and len(one) >= 84
    assert all(0 < r[3] <= 1 + 1e-5 for r in one)
    assert all(abs(r[3] - 1) < 0.05 for r in one if r[0] >= 500 and r[2] == r[0] - 500)


def test_items_without_any_share_of_the_basis(spark):
    """A basis of one dimension holds most items hardly: passages are found all the same."""
    rng = random.Random(34)
    items = [[f"i{i}w{rng.randrange(30)}" for _ in range(25)] for i in range(6)]
    docs = [(i, " ".join([f"n{rng.randrange(50)}" for _ in range(40)] + items[i % 6] + [f"n{rng.randrange(50)}" for _ in range(40)])) for i in range(12)]
    d, bench = frames(spark, docs, [(i, " ".join(w)) for i, w in enumerate(items)])
    got = decontaminate(d, bench, rank=1).where(F.col("contaminated")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i % 6) for i in range(12)]
    assert np.isfinite([r["cosine"] for r in got]).all()
