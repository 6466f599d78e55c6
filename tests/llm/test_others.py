import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SCHEMA, rows, words
from pyspark.sql import functions as F

from lumaplan.llm.components import components
from lumaplan.llm.common import keyed
from lumaplan.llm.decontaminate import _weights, benchmark_hits, common_subsequence, decontaminate, randomised_svd
from lumaplan.llm.language_id import _labelled, held_out, identify_language, train_language_id
from lumaplan.llm.minhash_dart import dart_minhash, near_duplicates, similarity
from lumaplan.llm.mixing import fill_targets, mix_sources
from lumaplan.llm.token_arrow import PieceEncoder, default_tokenizer, read_token_files, write_token_files
from lumaplan.llm.toxicity import fit_ordinal, judgement, lower_words, score_toxicity, stems, train_toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def counts(text):
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_near_duplicates_against_all_pairs(spark, docs):
    texts = sorted({t or "" for _, t, *_ in rows()})
    bags = [counts(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    degree = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i].split() == texts[j].split() or jaccard(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    del degree
    least = defaultdict(lambda: 2**63)
    for d, t, *_ in rows():
        r = root(texts.index(t or ""))
        least[r] = min(least[r], -(2**63) if d is None else d)
    want = sorted((-(2**63) if d is None else d, least[root(texts.index(t or ""))]) for d, t, *_ in rows())
    got = near_duplicates(docs).collect()
    low = lambda x: -(2**63) if x is None else x
    assert want == sorted((low(r["doc_id"]), low(r["class_id"])) for r in got)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_large_group_in_blocks(spark):
    rng = random.Random(3)
    base = words(rng, 150)
    made = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 12):
            w[rng.randrange(150)] = f"new{rng.random()}"
        made.append((i, " ".join(w)))
    bags = [counts(t) for _, t in made]
    parent = list(range(150))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(150):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), block=16).collect()
    assert [root(i) for i in range(150)] == [r["class_id"] for r in sorted(got, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("block", [4096, 16])
def test_near_duplicates_of_a_family_whose_base_is_absent(spark, block):
    rng = random.Random(11)
    base, made = words(rng, 300), []

    def edited(w, n):
        w = list(w)
        for i in rng.sample([i for i in range(6, 294, 6) if w[i] == base[i]], n):
            w[i] = f"new{rng.random()}"
        return w

    for _ in range(60):
        made.append(edited(base, 5))
        half = edited(base, 2)
        made += [edited(half, 3), edited(half, 3)]
    rng.shuffle(made)
    bags = [counts(" ".join(w)) for w in made]
    parent = list(range(len(made)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = [root(i) for i in range(len(made))]
    assert 60 <= len(set(want)) < 125
    got = near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string"), block=block).collect()
    assert want == [r["class_id"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.gamma(1, 2, 400) * (rng.random(400) < 0.7), rng.gamma(1, 2, 400) * (rng.random(400) < 0.7)
    b = np.where(rng.random(400) < 0.6, a, b)
    k = 2048
    s = dart_minhash(np.repeat([0, 1], 400), np.concatenate([e, e]), np.concatenate([a, b]), 3, k)
    assert not s[2].any()
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_piece_encoder_is_the_library(docs):
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(default_tokenizer()), PieceEncoder(default_tokenizer())
    texts = [t or "" for _, t, *_ in rows()] + ["  two  spaces\t\n x ", "it's we'll  don't", "a　b", "123abc ...!! \r\n\r\n end ", "<|endoftext|>", "é́ ñ", "\t  b"]
    flat, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, at = enc.encode(flat, off)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(default_tokenizer()), 0, []
    for d, t in sorted(((d, t or "") for d, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = write_token_files(docs, f"file://{tmp_path}", default_tokenizer(), sequence=64, batch_rows=4)
    got = [tuple(r) for r in read_token_files(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    import pyarrow as pa

    seq = pa.ipc.open_file(pa.memory_map(next(str(p) for p in tmp_path.glob("*.seq.arrow")))).read_all()
    assert pa.types.is_fixed_size_list(seq.schema.field("ids").type) and pa.types.is_fixed_size_list(seq.schema.field("mask").type)
    assert read_token_files(write_token_files(docs.limit(0), f"file://{tmp_path}/none", default_tokenizer())).count() == 0


def test_fill_targets():
    assert fill_targets([100, 100, 100], [5, 2, 1], 450, 2) == [200, 500 / 3, 250 / 3]
    assert fill_targets([0, 10], [1, 1], 15, 2) == [0, 15]
    assert fill_targets([], [], 0, 2) == []


def test_mixing_keeps_its_promises(docs):
    got = mix_sources(docs, rows_a_bucket=7).collect()
    assert len(got) == len(rows())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((d is None, d or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in rows())
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted((s for s in sizes if s), key=str) + [None]
    assert [target[s] for s in names] == fill_targets([sizes[s] for s in names], [5, 2, 1, 5], 1.5 * sum(sizes.values()), 2)
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in names)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mix_sources(docs.repartition(3), rows_a_bucket=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(docs.limit(0)).count() == 0


def plain_mix(table, weights=(5, 2, 1)):
    """(doc_id, source, size) -> copies, row by row, from the definition: one queue a source, one sort of all copies, one cut."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    place = lambda d, t: int(hashlib.md5(f"1|{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:15], 16)
    queues = defaultdict(list)
    for d, t, s in table:
        queues[s].append((place(d, t), -(2**63) if d is None else d, size(t), d))
    names = sorted((s for s in queues if s is not None)) + [None] * (None in queues)
    sizes = [sum(x[2] for x in queues[s]) for s in names]
    targets = dict(zip(names, fill_targets(sizes, [weights[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2), strict=True))
    copies = []
    for s, n in zip(names, sizes, strict=True):
        words = 0
        for i, (_, _, k, _) in enumerate(sorted(queues[s], key=lambda x: x[:3])):
            words += k
            copies += [((words + c * n) / targets[s], k, s, i) for c in range(2) if k]
    gone, taken = 0, Counter()
    copies.sort(key=lambda x: x[0])
    for f in sorted({x[0] for x in copies}):
        same = [x for x in copies if x[0] == f]
        gone += sum(x[1] for x in same)
        if gone > 1.5 * sum(sizes):
            break
        taken.update((x[2], x[3]) for x in same)
    return sorted((str(s), str(x[3]), x[2], x[2] * taken[s, i]) for s in names for i, x in enumerate(sorted(queues[s], key=lambda x: x[:3])))


def test_mixing_is_the_definition(spark, docs):
    for bucket in (1, 7, 500):
        got = mix_sources(docs, rows_a_bucket=bucket).collect()
        assert sorted((str(r["source"]), str(r["doc_id"]), r["size"], r["taken"]) for r in got) == plain_mix([(d, t, s) for d, t, _, s, *_ in rows()])


def test_mixing_of_equal_rows_in_three_sources(spark):
    rng = random.Random(4)
    made = [(i, " ".join(words(rng, 20)), "a") for i in range(400)]
    made += [(d, t, s) for d, t, _ in made[:200] for s in ("b", None)]
    made += [(9000, " ".join(words(rng, 5)), "b")] * 2500
    got = mix_sources(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()
    assert len(got) == len(made)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    assert sorted((str(r["source"]), str(r["doc_id"]), r["size"], r["taken"]) for r in got) == plain_mix(made)


def test_language_id(spark):
    rng = random.Random(5)
    parts = {"aa": ["ka", "ko", "ta"], "bb": ["li", "lo", "mi"], "cc": ["ru", "rö", "sh"]}
    made = [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(25)), lang) for i in range(200) for lang in [rng.choice(list(parts))]]
    made += [(900, None, "aa"), (901, "12 34 .", "aa"), (902, "", None), (None, "kako", None)]
    made += [(910 + i, t, None) for i, t in enumerate(["½ ² ①", "Ⅷ", "٣ ५", "_ - ...", "½", "\u3007 ⒈"])]
    d = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify_language(d, train_language_id(d.where(~held_out()))).collect()}
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == got[i]["held_out"] for i, *_ in made if i is not None)
    tested = [got[i]["lang_pred"] == lang for i, _, lang in made[:200] if got[i]["held_out"]]
    assert np.mean(tested) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, *range(910, 916))] == ["und"] * 9 and got[None]["lang_pred"] == "aa"
    assert all(got[i]["score"] == 0 for i in range(910, 916))
    none = train_language_id(d.limit(0))
    assert {r["lang_pred"] for r in identify_language(d, none).collect()} == {"und"}


def plain_predict(model, text):
    """Word by word, from the definition of the backoff."""
    total, n = np.zeros(len(model.langs)), 0
    for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split(" "):
        if not w:
            continue
        n += 1
        if w in model.words:
            total += model.word_rows[model.words[w]]
            continue
        for size, known, rows in zip((4, 3, 2, 1), model.grams, model.gram_rows, strict=True):
            marked = f"<{w}>" if size > 1 else w
            hits = [rows[known[marked[i : i + size]]] for i in range(len(marked) - size + 1) if marked[i : i + size] in known]
            if hits:
                total += 0.5 * np.mean(hits, 0)
                break
    if not n:
        return "und", 0.0
    p = np.exp(total - total.max())
    return model.langs[int(total.argmax())], float(p.max() / p.sum())


def test_language_id_is_the_definition(spark, docs, monkeypatch):
    from lumaplan.llm import language_id

    model = train_language_id(docs.where(~held_out()))
    assert set(model.langs) == {"en", "fr"}
    texts = [t for _, t, *_ in rows()] + ["word½word ②x", "\U0001d504\U0001d505 é", "a" * 50]
    want = [plain_predict(model, t) for t in texts]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        langs, scores = model.predict(texts)
        assert langs == [x[0] for x in want] and np.allclose(scores, [x[1] for x in want])
    model.cache_size = 3
    assert model.predict(texts)[0] == langs
    got = identify_language(docs, model).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == Counter((d, plain_predict(model, t)[0]) for d, t, *_ in rows())


def test_small_languages_keep_their_words(spark):
    made = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20)), "big") for i in range(200)] + [(1000 + i, "zu zu zi zi", "small") for i in range(3)]
    model = train_language_id(spark.createDataFrame(made, "doc_id long, text string, lang string"), max_words=5)
    assert {"zu", "zi"} <= set(model.words)


def test_language_training_caps_no_words_and_shares_rows(spark):
    """Every word that occurs twice is known, n-grams are those of all words, and languages share the rows evenly."""
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    made = [(i, " ".join(name() for _ in range(30)), ["big", "small"][i % 10 == 0]) for i in range(2000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    whole = train_language_id(docs, max_docs=10**6)
    counts = Counter(w for _, t, _ in made for w in t.split())
    assert set(whole.words) == {w for w, n in counts.items() if n >= 2}
    assert set(whole.grams[0]) == {f"<{w}>"[i : i + 4] for w in counts for i in range(4)} and set(whole.grams[3]) == set("abcdefghij")
    per = {r["lang"]: r["count"] for r in _labelled(docs, 300).groupBy("lang").count().collect()}
    assert 110 <= per["big"] <= 190 and 110 <= per["small"] <= 190


def test_toxicity(spark):
    rng = random.Random(6)
    made, labels = [], []
    for i in range(300):
        w = words(rng, 60)
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["vile", "rotten"]) if i % 10 else "horrid"
        made.append((i, " ".join(w)))
        labels.append((i, 0 if i % 10 == 0 else 1, int(bad)))
    made += [(None, None), (999, ""), (5, made[5][1])]
    labels += [(None, 1, 1), (3, None, None), (5, 1, 1)]
    d, y = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_toxicity(d, train_toxicity(d, y)).collect()
    assert len(got) == len(made)
    by = {r["doc_id"]: r for r in got}
    assert np.mean([by[i]["toxic"] == (i % 5 == 0) for i in range(300)]) > 0.97
    assert np.mean([by[i]["severity"] for i in range(0, 300, 10)]) > np.mean([by[i]["severity"] for i in range(5, 300, 10)]) > 0.5
    assert not by[999]["toxic"]
    assert not any(r["toxic"] for r in score_toxicity(d, train_toxicity(d, y.limit(0))).collect())


def test_toxicity_on_held_out_texts(spark):
    """Trained on even ids with a tenth of the labels wrong, tried on odd ones; names of other columns may be anything."""
    rng = random.Random(16)
    made, labels = [], []
    for i in range(1200):
        w, bad = words(rng, rng.randrange(20, 200)), rng.random() < 0.2
        if bad:
            for _ in range(2 + len(w) // 20):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "horrid"])
        made.append((i, " ".join(w), 7, bad, 0.5))
        labels.append((i, 1, int(bad != (rng.random() < 0.1))))
    d = spark.createDataFrame(made, "doc_id long, text string, grade int, toxic boolean, said double")
    y = spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id long, quality int, toxic int")
    model = train_toxicity(d, y)
    got = d.withColumn("told", judgement(F.col("text"), model)["toxic"]).where("doc_id % 2 = 1").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "grade", "toxic", "said", "told"} and all(r["grade"] == 7 for r in got)
    hit = sum(r["told"] and r["toxic"] for r in got)
    assert hit >= 0.95 * sum(r["toxic"] for r in got) and hit >= 0.95 * sum(r["told"] for r in got)
    by_text = {r["doc_id"]: r for r in score_toxicity(d, model).collect()}
    for i, t, *_ in made[:50]:  # the score from its definition, word by word
        x = np.frombuffer(t.encode(), np.uint8)
        f, _, n = stems(x, np.array([0, len(x)]), model.bits)
        s = model.scale * sum(float(model.weights[k]) for part in f for k in part.tolist()) / np.sqrt(n[0])
        below = 1 / (1 + np.exp(-(model.cuts - s)))
        assert abs(by_text[i]["severity"] - (1 - below).sum()) < 1e-6 and by_text[i]["toxic"] == (1 - below[0] >= 0.2 and s > 0)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, 2000)
    m = fit_ordinal(np.arange(2000), x, np.ones(2000), np.clip(x, 0, 3), 2, steps=300)
    assert (np.diff(m.cuts) > 0).all() and (np.diff(m.weights) > 0).all()
    assert np.allclose(m.grade_probabilities(np.array([0.0, 3.0])).sum(1), 1)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 90))], [rng.randrange(6) for _ in range(rng.randrange(90))]
        masks = {}
        for i, v in enumerate(a):
            masks[v] = masks.get(v, 0) | 1 << i
        assert common_subsequence(masks, len(a), b) == lcs(a, b)


def test_decontaminate(spark, docs):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.randrange(15, 60)))) for i in range(30)] + [(None, "x y"), (70, None), (71, ""), (3, None)]
    made, want = [], {}
    for i in range(120):
        body = words(rng, rng.randrange(20, 500))
        if i % 4 == 0:
            w = items[i % 30][1].split()
            for _ in range(len(w) // 6):
                w[rng.randrange(len(w))] = "swapped"
            at = rng.randrange(len(body))
            body[at:at] = w
            want[i] = i % 30
        made.append((i, " ".join(body)))
    made += [(None, None), (500, ""), (0, made[0][1])]
    got = decontaminate(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows_ = got.collect()
    assert len(rows_) == len(made)
    assert {r["doc_id"]: r["item_id"] for r in rows_ if r["contaminated"]} == want
    assert decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).where(F.col("contaminated")).count() == 0
    assert decontaminate(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_recall_of_paraphrases(spark):
    """Words replaced, dropped, put in and swapped at growing rates, against brute force over all windows and items: what has 0.6
    of an item as a common subsequence near one window, and 0.34 of its rarest words, must be found."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    draw = lambda n: [vocabulary[int(3000 * rng.random() ** 2.5)] for _ in range(n)]
    items = [draw(rng.randrange(20, 70)) for _ in range(60)]
    made, planted = [], {}
    for i in range(300):
        body = draw(rng.randrange(40, 300))
        if i % 3 == 0:
            w, rate = [], 0.05 * (i % 7)
            for x in items[i % 60]:
                u = rng.random()
                w += [x] if u > rate else rng.choice([[], draw(1), [x, *draw(1)]])
            for _ in range(int(rate * 10)):
                k = rng.randrange(len(w) - 1)
                w[k], w[k + 1] = w[k + 1], w[k]
            at = rng.randrange(len(body))
            body[at:at] = w
            planted[i] = i % 60
        made.append((i, " ".join(body)))
    d, bench = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in benchmark_hits(keyed(d), bench).collect()}
    clear = {(i, k) for i, k in planted.items() if lcs(items[k], made[i][1].split()) >= 0.75 * len(items[k])}
    assert len(clear) > 60 and len(found & clear) >= 0.95 * len(clear)
    # Nothing is found that does not hold 0.6 of the item in order.
    assert all(lcs(items[k], made[i][1].split()) >= 0.6 * len(items[k]) for i, k in found)
    clean = {i for i, _ in made if i not in planted}
    assert len({i for i, _ in found} & clean) <= 0.05 * len(clean)


def test_latent_basis(spark):
    """The randomised basis against numpy's own SVD of the same matrix."""
    rng = random.Random(22)
    texts = [" ".join(words(rng, 40)) for _ in range(80)]
    at, flat = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]), np.frombuffer("".join(texts).encode(), np.uint8)
    w, off = lower_words(flat, at)
    row, f, weight = _weights(w, off, np.ones(1 << 17))
    full = np.zeros((80, 1 << 17), np.float32)
    full[row, f] = weight
    used = np.unique(f)
    exact = np.linalg.svd(full[:, used], full_matrices=False)[2][:20]
    got, basis = randomised_svd(spark.createDataFrame([(t,) for t in texts], "text string"), np.ones(1 << 17), 20)
    assert (got == used).all() and np.allclose(basis.T @ basis, np.eye(20), atol=1e-8)
    kept = lambda b: ((full[:, used] @ b) ** 2).sum()
    assert kept(basis) >= 0.97 * kept(exact.T)


def test_decontamination_of_a_passage_in_a_third_of_the_texts(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    items = [(i, " ".join(name() for _ in range(n))) for i, n in enumerate((34, 35, 36, 66, 20))]
    made = []
    for i in range(300):
        w = [name() for _ in range(200)]
        if i % 3 == 0:
            at = rng.randrange(40, 160)
            w[at:at] = items[0][1].split()
        made.append((i, " ".join(w)))
    made += [(1000, " ".join([name() for _ in range(90)] + items[3][1].split() + [name() for _ in range(90)]))]
    docs, bench = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate(docs, bench).collect() if r["contaminated"]}
    assert got == {**{i: 0 for i in range(0, 300, 3)}, 1000: 3}


def test_new_pieces_go_to_the_library_joined_and_keep_their_ids():
    import pyarrow as pa

    from lumaplan.llm.common import text_buffer
    from lumaplan.llm.token_arrow import PieceEncoder, default_tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", "  ", "\n", "\t\n", " \r", ".", "'s", "é", "日本", "x1", "abc", "Zürich", "🙂", "\x00"]) for _ in range(rng.randrange(40))) for _ in range(3000)] + [" ", "\n a", "a", ""]
    e, given = PieceEncoder(default_tokenizer()), []

    class Counted:
        def encode_batch_fast(self, batch, **more):
            given.append(len(batch))
            return library.encode_batch_fast(batch, **more)

    library, e.tokenizer = e.tokenizer, Counted()
    ids, at = e.encode(*text_buffer(pa.array(texts)))
    want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert sum(given) < len(e.known) / 2
