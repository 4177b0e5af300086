"""The uncapped lists of top sets against plain loops."""

import random
import time
from collections import Counter
from itertools import combinations

import pytest

from logloom.operators import popularity


def plain_top(baskets, size, k):
    counts = Counter(s for b in baskets for s in combinations(b, size))
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    return [(i + 1, *s, n) for i, (s, n) in enumerate(top)]


def frame(spark, baskets):
    return spark.createDataFrame([(i if i % 3 else None, b) for i, b in enumerate(baskets)], "query_id long, tables array<string>")


@pytest.mark.parametrize("size", [2, 3])
@pytest.mark.parametrize("seed", range(3))
def test_top_sets_equal_plain_loops(spark, size, seed):
    rng = random.Random(seed)
    names = [f"t{i:02d}" for i in range(30)]
    weights = [40, 30, 20] + [rng.choice([1, 3]) for _ in range(27)]
    baskets = [sorted(set(rng.choices(names, weights, k=rng.randint(2, (6, 25, 14)[seed])))) for _ in range((120, 60, 12)[seed])]
    baskets = [b for b in baskets if len(b) >= 2]
    for k, direct in ((1, 0), (5, 0), (40, 0), (40, 16)):
        got = popularity.top_combinations(frame(spark, baskets), size, k, small=4, direct=direct)
        assert [tuple(r) for r in got.orderBy("rank").collect()] == plain_top(baskets, size, k)


@pytest.mark.parametrize("size", [2, 3])
def test_sets_seen_once_come_by_name(spark, size):
    baskets = [[f"a{i:02d}" for i in range(12)], [f"b{i:02d}" for i in range(9)], ["a00", "a05", "c1", "c2", "c3", "c4", "c5", "c6"], ["x", "y"]]
    for k, direct in ((3, 0), (30, 0), (30, 16)):
        got = popularity.top_combinations(frame(spark, baskets), size, k, small=4, direct=direct)
        assert [tuple(r) for r in got.orderBy("rank").collect()] == plain_top(baskets, size, k)


def test_a_query_of_a_thousand_tables_ends(spark):
    rng = random.Random(7)
    wide = [f"w{i:04d}" for i in range(1000)]
    baskets = [wide, *[sorted({"hot", *rng.sample(wide[:60], 3)}) for _ in range(400)], sorted(["hot", *wide[:40]])]
    began = time.time()
    got = popularity.top_combinations(frame(spark, baskets), 3, 20)
    rows = [tuple(r) for r in got.orderBy("rank").collect()]
    assert time.time() - began < 120
    small = [[t for t in b if t == "hot" or t < "w0060"] for b in baskets]
    assert rows == plain_top(small, 3, 20) and rows[-1][-1] > 2
