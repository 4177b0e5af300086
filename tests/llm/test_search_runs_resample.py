"""Periodic runs, nearest vectors and importance resampling against plain loops."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import queries, resample, runs, vectortree

from .test_native import clash, documents


def plain_runs(w):
    """Every period by itself, over the whole text."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            smaller = any(all(w[x] == w[x - d] for x in range(start + d, i)) for d in range(1, q))
            if i - start >= max(6, 4 * q) and not smaller:
                found.add((start, i - start, q))
    return sorted(found)


def plain_collapse(w, found):
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_plain_loops_however_words_arrive(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = rng.choice([1, 2, 2, 3, 5])
        w = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            block = [b"%d" % rng.randrange(letters + 1) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(w))
            w[at:at] = block * rng.randint(3, 7) + block[: rng.randint(0, len(block))]
        want = plain_runs(w)
        for chunk in (1, 5, 1 << 16):
            assert runs.find_runs(w, chunk) == want
        assert runs.collapse(w, want) == plain_collapse(w, want)


def test_runs_are_reported_while_words_arrive():
    catcher = runs.SquareCatcher()
    for i, word in enumerate(b"a b c a b c a b c a b c a x".split()):
        catcher.append([word])
        assert catcher.runs() == ([(0, min(i + 1, 13), 3)] if i >= 11 else [])


def test_runs_of_long_texts():
    rng = random.Random(5)
    block = [b"w%d" % rng.randrange(9000) for _ in range(30_000)]
    assert runs.find_runs(block * 4 + block[:7]) == [(0, 120_007, 30_000)]
    assert runs.find_runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert runs.find_runs([b"a", b"b"] * 50_000 + [b"a"] * 6) == [(0, 100_001, 2), (100_000, 6, 1)]
    assert runs.find_runs(block) == []


def test_runs_edges(spark):
    twice = "x y " * 6
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\v\f\t", "a"), (4, twice, "a"), (4, twice, "a"), (None, "a b " * 9, "a"), (5, "q", None)]
    got = sorted(runs.detect_runs(clash(documents(spark, rows))).collect(), key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert by[1] == by[2] == by[3] == [(0, [], "")] and by[5] == [(1, [], "q")]
    assert by[4] == [(12, [(0, 12, 2)], "x y")] * 2
    assert by[None] == [(9, [(0, 9, 1)], "a b")]
    assert runs.detect_runs(documents(spark, []).where("false")).count() == 0


def test_op11_equals_its_contract(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        w = [x.encode() for x in w]
        want = plain_runs(w) if n < 1500 else runs.find_runs(w)
        r = got[d.doc_id]
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(w, want)).hexdigest()
    assert planted > 5


def plain_nearest(rows, is_query, k=10):
    out = {}
    for q, v in rows:
        if is_query(q):
            apart = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, x, strict=True))), i) for i, x in rows if (i, x) != (q, v))
            out[q] = [(i, d) for d, i in apart[:k]]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vectors_edges_and_copies(spark):
    rng = np.random.default_rng(3)
    hot = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=4).astype("float32").tolist(), 0) for i in range(600)]
    bad = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 4, 0), (1003, [1.0, None, 2.0, 3.0], 0), (1004, [float("nan")] * 4, 0), (1005, [float("inf"), 0.0, 0.0, 1.0], 0), (1006, [1.0, 2.0], 0), (None, hot, 0)]
    items = clash(spark.createDataFrame([*rows, rows[5], rows[0], *bad], VECTORS)).withColumn("ids", F.lit(1)).withColumn("leaf", F.lit(1))
    want = plain_nearest([(i, v) for i, v, _ in rows], lambda i: i % 20 == 0)
    # every leaf is visited: then the result is exact, ties and copies included
    got = found(vectortree.search(items, F.col("id") % 20 == 0, target=2.0, leaf_rows=20, block=30, chunk=5))
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([d for _, d in got[q]], [d for _, d in near], rtol=1e-12, atol=0)
    few = found(vectortree.search(spark.createDataFrame(rows[:4], VECTORS), F.col("id") < 2))
    assert [len(few[i]) for i in (0, 1)] == [3, 3]
    assert vectortree.search(items.where("false"), F.col("id") > 0).count() == 0
    assert found(vectortree.search(spark.createDataFrame(rows[:1], VECTORS), F.col("id") == 0)) == {}


def test_vector_recall_is_reached(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16)) * 3
    data = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    got = found(vectortree.search(items, F.col("id") % 20 == 0))
    hits = 0
    for q, near in got.items():
        apart = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        apart[q] = np.inf
        hits += len({i for i, _ in near} & set(np.argsort(apart)[:10].tolist()))
        assert len(near) == 10
    assert len(got) == 300 and hits >= 0.93 * 3000


def test_tree_order_meets_every_leaf():
    rng = np.random.default_rng(6)
    data = rng.normal(size=(900, 5))
    tree = vectortree.grow(data, 900, branch=4, leaf_rows=15)
    at, count = np.unique(tree.place(data), return_counts=True)
    tree.rows = dict(zip(at.tolist(), count.tolist(), strict=True))
    order = list(tree.order(data[7]))
    assert sorted(order) == sorted(tree.leaves()) and order[0] == tree.place(data[7:8])[0]
    pages = tree.pages(100)
    held = collections.Counter()
    for leaf, page in pages.items():
        held[page] += tree.rows[leaf]
    assert set(pages) == set(tree.rows) and max(held.values()) <= max(100, int(count.max()))
    assert sum(tree.rows[x] for x in tree.visits(data[7], 1, 50)) >= 50


def plain_weights(docs, target, n=1, buckets=10_000):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(resample.UPPER, resample.LOWER)))
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    code = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(code(f) for _, text in docs for f in feats(text)[0])
    t = collections.Counter(code(f) for text in target for f in feats(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in docs:
        f, words = feats(text)
        out.append((i, len(f), sum(gain(code(x)) for x in f) // len(f) if f else 0, words))
    return out


@pytest.mark.parametrize("n", [1, 2])
def test_resampling_equals_plain_loops(spark, n):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "Ünter", "9", "x-y", "A.B"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), "s") for i in range(400)]
    docs += [(500, None, "s"), (501, "", "s"), (502, "\u0000--!", None)]
    docs += [(7, docs[7][1], "s"), (8, "another text " * 20, "s")]
    target = ["w1 w2 w3 É w1 w2", None, "x-y w5 A.B"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(clash(documents(spark, docs)), texts, n=n, min_words=20, percent=10).collect()
    want = []
    for i, count, weight, words in plain_weights([d[:2] for d in docs], target, n):
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, count, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    assert sorted(tuple(r)[:4] for r in got) == sorted(x[:4] for x in want)
    able = sorted((-x[3], x[0]) for x in want if x[4] >= 20)
    drawn = sorted((r["rank"], -r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [x[0] for x in drawn] == list(range(1, len(able) * 10 // 100 + 1))
    assert [x[1:] for x in drawn] == able[: len(drawn)]


def test_resampling_edges(spark):
    texts = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    empty = documents(spark, []).where("false")
    assert resample.resample(empty, texts).count() == 0
    none = resample.resample(documents(spark, [(1, "a b c", "s"), (None, "b", "s")]), texts.where("false")).collect()
    assert sorted((r.n_features, r["rank"]) for r in none) == [(1, None), (3, None)]
    same = resample.resample(documents(spark, [(5, "v " * 30, "s")] * 40), texts).collect()
    assert sorted(r["rank"] for r in same if r["rank"]) == [1, 2, 3, 4]


@pytest.mark.parametrize("k", [1, 17, 2_500, 5_000, 5_001, 0])
def test_quickselect_finds_the_key(spark, k):
    rng = random.Random(9)
    keys = [(rng.randrange(6), rng.randrange(2), rng.randrange(40), i) for i in range(5_000)]
    rows = spark.createDataFrame(keys, "_down long, _last long, _id long, _row long").repartition(7)
    assert resample.kth_key(rows, k, pivots=3, small=50) == (sorted(keys)[k - 1] if 1 <= k <= 5_000 else None)
