"""The pipeline's stages against plain versions of what each must do."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import words
from test_others import counts, jaccard

import corpus_pipeline
from lumaplan.llm.mixing import fill_targets
from lumaplan.llm.token_arrow import default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, 40))) for i in range(6)]
    docs, labels = [], []
    for i in range(240):
        w = words(rng, rng.randrange(40, 160))
        if i % 6 == 0:
            for _ in range(1 + len(w) // 12):
                w[rng.randrange(len(w))] = rng.choice(["vile", "horrid"])
        if i % 15 == 7:
            w[5:5] = items[i % 6][1].split()
        if i % 20 == 9:
            w = docs[i - 2][1].split()
            w[len(w) // 2] = "changed" if len(w) > 60 else w[len(w) // 2]
        docs.append((i, " ".join(w), "en", ["a", "b", None, "c"][i % 4 if i % 3 else 0], len(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(500, None, None, None, None), (501, "", "en", "b", 0), docs[3], docs[3], (None, "a text without an id " * 4, None, "c", 1), (4, "another text of this id", "en", "a", 1)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs, items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_stages(spark, folder, tmp_path):
    where, docs, items = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    frame = spark.read.parquet(f"{where}/documents.parquet")
    columns = frame.columns

    def step(name, frame):
        stages[name](spark, frame, where).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert name == "token_output" or out.columns == columns
        return out, rows(out)

    clean, kept = step("toxicity", frame)
    bad = lambda t: bool({"vile", "horrid"} & set((t or "").split()))
    assert kept == rows(spark.createDataFrame([d for d in docs if not bad(d[1])], SCHEMA))

    unique, single = step("near_duplicates", clean)
    texts = sorted({d[1] or "" for d in kept})
    bags, parent = [counts(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i].split() == texts[j].split() or jaccard(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    low = lambda d: -(2**63) if d is None else d
    least = {}
    for d in kept:
        r = root(texts.index(d[1] or ""))
        least[r] = min(least.get(r, 2**63), low(d[0]))
    assert sorted(least.values()) == sorted(low(d[0]) for d in single)
    assert len({root(texts.index(d[1] or "")) for d in single}) == len(single)

    safe, held = step("decontamination", unique)
    assert held == [d for d in single if not any(i[1] in (d[1] or "") for i in items)]

    mixed, taken = step("mixing", safe)
    size = lambda d: len((d[1] or "").split())
    sizes, got, times = Counter(), Counter(), Counter(taken)
    for d in held:
        sizes[d[3]] += size(d)
        got[d[3]] += size(d) * times[d]
    assert set(times) <= set(held) and max(times.values()) <= 2
    names = sorted(s for s in sizes if s) + [None] * (None in sizes)
    targets = fill_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    assert all(abs(got[s] - t) <= max(map(size, held)) for s, t in zip(names, targets, strict=True))

    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(default_tokenizer()), 0, []
    for d in sorted(taken, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*plain.encode(d[1] or "", add_special_tokens=False).ids, 0]
        want.append((d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    _, tokens = step("token_output", mixed)
    assert sorted(tokens, key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, where).collect()), key=lambda r: r[1]) == want


def test_stages_keep_columns_of_any_name(spark, folder):
    """Documents with columns named as what the stages compute: all come through with their values."""
    where, docs, _ = folder
    names = ["grade", "severity", "p_toxic", "toxic", "said", "row", "_id", "_th", "_n", "_rh", "_copy", "key_id", "key_hash", "row_hash", "nth", "copies", "copy", "from", "of", "root", "class_id", "contaminated", "item_id"]
    wide = SCHEMA + "".join(f", `{n}` string" for n in names)
    frame = spark.createDataFrame([(*d, *names) for d in docs[:40]], wide)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, where)
        assert out.columns == frame.columns, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == tuple(names) for r in got), name


def test_sql_of_the_operators(spark):
    """The operators' SQL against their queries, on the smallest tables."""
    import glob
    import os

    import duckdb

    from lumaplan.llm.queries import ORACLE_SQL, QUERIES

    where = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for f in glob.glob(f"{where}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in ORACLE_SQL.items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, where).collect()]
        # The smallest tables have 20 conversations, which make 59 nodes.
        assert len(got) > (50 if name == "op12_prefix_trie" else 100) and sorted(got) == sorted(want.fetchall()), name


def test_pipeline_on_empty_documents(spark, folder, tmp_path):
    where, _, _ = folder
    frame = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, where).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert frame.count() == 0
