"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaplan.llm.common import C1, C3, chunks, join2, keyed, mix, ragged, real_id, span_hashes, text_buffer, word_spans, written
from lumaplan.llm.components import components
from lumaplan.llm.runs import name_of

COORDINATES, ROWS = 64, 4
BANDS = COORDINATES // ROWS
SIGNED = "doc_id long, node long, th long, bands array<long>, sig binary"


def _unit(h: np.ndarray) -> np.ndarray:
    """(0, 1] from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def _times(n: int, constant: np.uint64) -> np.uint64:
    return np.uint64(n * int(constant) & (2**64 - 1))


def dart_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """k-coordinate signatures (n x k, uint64) of n weighted sets given as (owner, element, weight); 0 where a set is empty.

    Darts of an element are a Poisson process over weight x rank, fixed by the element's hash; the weight axis is cut into
    the strips [0,1), [1,2), [2,4), ... A set sees the darts in [0, weight) x [0, limit); each dart falls on one coordinate
    and the one of least rank stays. Sets with an empty coordinate throw on, with twice the limit. Two sets agree at a
    coordinate with probability sum(min)/sum(max) of their weights.
    """
    sig = np.zeros(n * k, np.uint64)
    norm = np.bincount(owner, weight, n)
    limit = (k * np.log(k) + 2 * k) / np.maximum(norm, 1e-300)
    todo = norm > 0
    while todo.any():
        at = np.flatnonzero(todo[owner])
        where, rank, dart = [], [], []
        strip, low, width = 0, 0.0, 1.0
        while len(at):
            own, w, top = owner[at], weight[at], limit[owner[at]]
            seed = mix(element[at] + _times(strip + 1, C3))
            r = np.zeros(len(at))
            live = np.arange(len(at))
            step = 0
            while len(live):
                h = mix(seed[live] + _times(step, C1))
                r[live] += -np.log(_unit(h)) / width
                live = live[r[live] <= top[live]]
                h = mix(seed[live] ^ _times(step + 1, C3))
                hit = low + width * _unit(mix(h + C1)) <= w[live]
                sel = live[hit]
                where.append(own[sel] * k + (h[hit] % np.uint64(k)).astype(np.int64))
                rank.append(r[sel])
                dart.append(h[hit] | np.uint64(1))
                step += 1
            strip, low, width = strip + 1, low + width, max(width, low + width)
            at = at[w > low]
        where, rank, dart = np.concatenate(where), np.concatenate(rank), np.concatenate(dart)
        order = np.lexsort((dart, rank, where))
        where, dart = where[order], dart[order]
        first = np.ones(len(where), bool)
        first[1:] = where[1:] != where[:-1]
        full = sig.reshape(n, k)
        full[todo] = 0
        sig[where[first]] = dart[first]
        todo &= (full == 0).any(1)
        limit[todo] *= 2
    return sig.reshape(n, k)


def shingles(flat: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index and hash of each run of `words` words (a text with fewer words has one shorter run), and a name of each
    text's whole sequence of words (0: no word), 64 bits of a BLAKE2b digest."""
    starts, ends, per = word_spans(flat, offsets)
    n = len(per)
    off = np.concatenate([[0], np.cumsum(per)])
    h = span_hashes(flat, starts, ends)
    raw = flat.tobytes()
    # bytes.split() splits where word_spans() does.
    names = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=8).digest() if k else bytes(8) for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), per.tolist(), strict=True)]
    whole = np.frombuffer(b"".join(names), "<u8").copy()
    some = per > 0
    whole[some & (whole == 0)] = 1
    runs = np.where(per >= words, per - words + 1, 0)
    name = name_of(h, words)
    owner = np.concatenate([np.repeat(np.arange(n), runs), np.flatnonzero(some & (runs == 0))])
    hashes = np.concatenate([name[ragged(off[:-1], runs)], whole[some & (runs == 0)]])
    return owner, hashes, whole


def counted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) and how often each occurs."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], hashes[heads], np.diff(np.append(heads, len(owner)))


def signed(docs: DataFrame, words: int = 5) -> DataFrame:
    """Rows of SIGNED: node is a hash of the word sequence; bands join ROWS coordinates each; sig has 16 bits a coordinate."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            flat, off = text_buffer(rb.column("text"))
            nodes, bands, sigs = [], [], []
            for lo, hi in chunks(off, 1 << 22):
                owner, h, whole = shingles(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                owner, h, count = counted(owner, h)
                s = dart_minhash(owner, h, count.astype(np.float64), hi - lo)
                b = s[:, ::ROWS]
                for j in range(1, ROWS):
                    b = join2(b, s[:, j::ROWS])
                nodes.append(whole)
                bands.append(b)
                sigs.append((mix(s) & np.uint64(0xFFFF)).astype(np.uint16))
            nodes = np.concatenate(nodes).view(np.int64) if nodes else np.zeros(0, np.int64)
            bands = np.concatenate(bands).view(np.int64) if bands else np.zeros((0, BANDS), np.int64)
            packed = [x.tobytes() for m in sigs for x in m]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(nodes), rb.column("th"), lists, pa.array(packed, pa.binary())], names=["doc_id", "node", "th", "bands", "sig"])

    return docs.select("doc_id", "th", "text").mapInArrow(sign, SIGNED)


def star_pairs(node: np.ndarray, sig: np.ndarray, least: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of a bucket that may be similar, without those that other pairs may make needless: the member nearest to the
    bucket's commonest values is the first centre and is paired with all that agree with it; each member that no centre
    reached is a centre in turn and is paired with everything that agrees with it. Also the members that are no centres:
    two of these that agree are not paired, which is right only if checked links join them (see rest_links())."""
    n = len(node)
    agree = lambda i: (sig == sig[i]).mean(1)
    mode = np.zeros(sig.shape[1], sig.dtype)
    for c in range(sig.shape[1]):
        v, k = np.unique(sig[:, c], return_counts=True)
        mode[c] = v[k.argmax()]
    order = np.lexsort((node, -(sig == mode).sum(1)))
    reached, centre = np.zeros(n, bool), np.zeros(n, bool)
    out = []
    for i in order.tolist():
        if reached[i]:
            continue
        near = np.flatnonzero(agree(i) >= least)
        reached[near] = True
        reached[i] = centre[i] = True
        out += [(int(node[i]), int(node[j])) for j in near.tolist() if j != i]
    return out, node[~centre]


def rest_links(node: np.ndarray, root: np.ndarray, sig: np.ndarray, own: np.ndarray, texts: pa.Array, band: int, least: float, threshold: float, words: int) -> list[tuple[int, int, float, int, int]]:
    """(a, b, similarity, root of a, root of b) of links between members of a bucket whose roots differ. Each two members that
    agree are compared exactly, unless links found here join them before, or a band before this one has both. Members of
    two blocks (own differs): only pairs across."""
    flat, off = text_buffer(texts)
    owner, h, count = counted(*shingles(flat, off, words)[:2])
    n = len(node)
    total, at = np.bincount(owner, count, n), np.searchsorted(owner, np.arange(n + 1))
    ids = np.unique(h, return_inverse=True)[1]
    here, label = np.zeros(len(h) and int(ids.max()) + 1, np.int64), np.unique(root, return_inverse=True)[1]
    across, out = own.min() != own.max(), []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(label[j] != label[i]) & (np.minimum(total[j], total[i]) >= threshold * np.maximum(total[j], total[i]))]
        if across:
            j = j[own[j] != own[i]]
        same = sig[j] == sig[i]
        j = j[(same.mean(1) >= least) & (same.reshape(len(j), BANDS, ROWS).all(2).argmax(1) == band)]
        if not len(j):
            continue
        mine = slice(at[i], at[i + 1])
        here[ids[mine]] = count[mine]
        sizes = at[j + 1] - at[j]
        e = ragged(at[j], sizes)
        shared = np.bincount(np.repeat(np.arange(len(j)), sizes), np.minimum(here[ids[e]], count[e]), len(j))
        here[ids[mine]] = 0
        s = shared / np.maximum(total[i] + total[j] - shared, 1)
        for k, v in zip(j[s >= threshold].tolist(), s[s >= threshold].tolist(), strict=True):
            out.append((int(node[i]), int(node[k]), v, int(root[i]), int(root[k])))
            label[label == label[k]] = label[i]
    return out


def similarity(texts_a: pa.Array, texts_b: pa.Array, words: int = 5) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of each pair of texts."""
    out = []
    both = np.concatenate([[0], np.cumsum(sum(np.diff(text_buffer(t)[1]) for t in (texts_a, texts_b)))])
    for i, j in chunks(both, 1 << 21, 256):
        sides = []
        for t in (texts_a[i:j], texts_b[i:j]):
            flat, off = text_buffer(t)
            sides.append(counted(*shingles(flat, off, words)[:2]))
        n = j - i
        total = np.bincount(sides[0][0], sides[0][2], n) + np.bincount(sides[1][0], sides[1][2], n)
        owner, h, c = (np.concatenate([sides[0][j], sides[1][j]]) for j in range(3))
        order = np.lexsort((h, owner))
        owner, h, c = owner[order], h[order], c[order]
        same = np.flatnonzero((owner[1:] == owner[:-1]) & (h[1:] == h[:-1]))
        shared = np.bincount(owner[same], np.minimum(c[same], c[same + 1]), n)
        out.append(shared / np.maximum(total - shared, 1))
    return np.concatenate(out) if out else np.zeros(0)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, block: int = 4096) -> DataFrame:
    """doc_id, th, class_id (smallest doc_id of its class), class_size, n_links (checked links of its text to other texts), root
    (tells classes apart that have one class_id because an id repeats).

    A class is a connected component of links between texts whose shingles of `words` words, with their counts, have a
    weighted Jaccard similarity of at least threshold. Texts with equal sequences of words (split at ASCII white space) are
    one class. A pair at the threshold shares a band with probability over 0.999 (16 bands of 4 coordinates).

    First the members of each bucket are checked against its centres. Members of one bucket that this leaves in different
    components meet again, with their texts, and are checked among themselves.

    Null and empty texts and texts of white space: have no words and form one class together. Null doc_id: before all
    others; class_id null where the least id is null. Repeated rows: same class. Empty table: no rows. Other columns are
    not read.
    """
    rows = keyed(docs)
    all_ = written(signed(rows, words), "signed")
    nodes = all_.groupBy("node").agg(F.min(F.struct("doc_id", "th", "bands", "sig")).alias("x"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes.select("node", "x.*", "n"), "nodes")

    members = nodes.where("node <> 0").select("node", "sig", F.posexplode("bands").alias("band", "key"))
    keys = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # Buckets over `block` members are cut into blocks, and each two blocks meet in a group of their own.
    members = members.join(keys, ["band", "key"])
    parts = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    met = members.withColumn("own", own).withColumn("other", other)
    met = met.select("node", "sig", "band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    least = threshold - 0.18

    def pairs(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
        found, rest = star_pairs(node, sig, least)
        rest = rest.tolist() if len(rest) > 1 else []
        band, key, x, y = (t.column(c)[0].as_py() for c in ("band", "key", "x", "y"))
        a, b = [min(p) for p in found] + rest, [max(p) for p in found] + [None] * len(rest)
        of = [[None] * len(found) + [v] * len(rest) for v in (band, key, x, y)]
        return pa.table([pa.array(v, k) for v, k in zip([a, b, *of], [pa.int64()] * 2 + [pa.int32(), pa.int64()] + [pa.int32()] * 2, strict=True)], names=["a", "b", "band", "key", "x", "y"])

    # Pairs to check, and (b null) the members of each bucket that are no centres.
    stars = written(met.groupBy("band", "key", "x", "y").applyInArrow(pairs, "a long, b long, band int, key long, x int, y int"), "stars")
    close = written(stars.where("b is not null").select("a", "b").distinct(), "close")

    wanted = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    wanted = wanted.join(nodes.select("node", "doc_id", "th"), "node")
    texts = rows.select("doc_id", "th", "text").join(wanted, ["doc_id", "th"]).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")
    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            s = similarity(rb.column("text_a"), rb.column("text_b"), words)
            yield pa.RecordBatch.from_arrays([rb.column("a"), rb.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    links = written(close.join(left, "a").join(right, "b").mapInArrow(check, "a long, b long, similarity double").where(F.col("similarity") >= threshold), "linked")
    roots = written(components(links, "a", "b"), "roots")

    rest = stars.where("b is null").select("band", "key", "x", "y", F.col("a").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rest.groupBy("band", "key", "x", "y").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rest = rest.join(apart.select("band", "key", "x", "y", "members"), ["band", "key", "x", "y"])
    # As above, in smaller blocks, as texts come along.
    parts = F.ceil(F.col("members") / min(block, 512)).cast("int")
    rest = rest.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rest = rest.withColumns({"v": F.least("own", "other"), "w": F.greatest("own", "other")}).drop("other", "members")
    rest = rest.join(nodes.select("node", "sig"), "node").join(texts, "node")

    def check_rest(t: pa.Table) -> pa.Table:
        node, root, own = (t.column(c).to_numpy() for c in ("node", "root", "own"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
        found = rest_links(node, root, sig, own, t.column("text"), t.column("band")[0].as_py(), least, threshold, words)
        cols = list(zip(*found, strict=True)) or [[]] * 5
        a, b = [min(p) for p in zip(cols[0], cols[1], strict=True)], [max(p) for p in zip(cols[0], cols[1], strict=True)]
        return pa.table([pa.array(v, k) for v, k in zip([a, b, *cols[2:]], [pa.int64()] * 2 + [pa.float64()] + [pa.int64()] * 2, strict=True)], names=["a", "b", "similarity", "ra", "rb"])

    more = rest.groupBy("band", "key", "x", "y", "v", "w").applyInArrow(check_rest, "a long, b long, similarity double, ra long, rb long")
    more = written(more, "more")
    if not more.isEmpty():
        links = links.unionByName(more.select("a", "b", "similarity").dropDuplicates(["a", "b"]))
        over = components(more, "ra", "rb").select(F.col("node").alias("was"), F.col("root").alias("now"))
        roots = nodes.select("node").join(roots, "node", "left").withColumn("was", F.coalesce("root", "node")).join(over, "was", "left")
        roots = written(roots.select("node", F.coalesce("now", "was").alias("root")), "roots")
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    info = nodes.select("node", "doc_id", "n").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = info.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    info = written(info.join(classes, "root").select("node", "root", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return all_.select("doc_id", "th", "node").join(info, "node").select(real_id().alias("doc_id"), "th", F.when(F.col("class_id") != F.lit(-(2**63)), F.col("class_id")).alias("class_id"), "class_size", "n_links", "root")


def op4_minhash_dart(spark, sf_dir):
    from lumaplan.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
