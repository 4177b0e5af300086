"""The similarity join with the parameters of the query, at its threshold and over buckets that split."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import ngramjoin

from .test_native import documents


def pairs_at_the_limit(n, shared, seed):
    """n texts of 200 words and their near copies of Jaccard 176 / 216, `shared` words being the same in all."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        words = passage + [f"w{rng.randrange(10**9)}" for _ in range(200 - shared)]
        copy = list(words)
        for at in range(4):
            copy[shared + 6 + at * (180 - shared) // 4] = f"x{rng.randrange(10**9)}"
        rows += [(2 * i, " ".join(words), "s"), (2 * i + 1, " ".join(copy), "s")]
    return rows


def test_runs_follow_from_the_recall():
    assert [ngramjoin.runs_for(0.98, levels) for levels in (1, 2, 3, 4)] == [4, 7, 9, 11]
    assert 1 - (1 - 0.312) ** ngramjoin.runs_for() >= 0.98
    assert ngramjoin.runs_for(0.999) == math.ceil(math.log(0.001) / math.log(1 - 0.312))


@pytest.mark.parametrize("shared, bucket", [(0, ngramjoin.BUCKET), (60, 16), (60, ngramjoin.BUCKET)])
def test_recall_at_the_limit(spark, shared, bucket):
    n = 300
    rows = pairs_at_the_limit(n, shared, 11)
    grams = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t, _ in rows[:2]]
    assert 0.8 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) < 0.83
    got = ngramjoin.join_similar(documents(spark, rows).repartition(6), bucket=bucket).collect()
    found = sum(r.n_links for r in got) / 2
    assert n * 0.97 <= found <= n
    assert all(r.class_id in (r.doc_id, r.doc_id - 1) for r in got)


def test_long_and_repeated_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "s"), (1, long, "s"), (1, long + " end", "s"), (None, long, "s"), (None, "other words of a text", "s"), (3, long + "  end", "s")]
    got = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngramjoin.join_similar(documents(spark, rows), bucket=1).collect()}
    assert got == {(1, 1, 1, 3), (1, 1, 1, 2), (3, 1, 1, 2), (None, 1, 1, 3), (None, None, 0, 1)}


def test_chosen_paths_do_not_depend_on_the_pieces():
    grams = ngramjoin._mix(np.arange(10**6, 10**6 + 200_000, dtype=np.uint64))
    starts = ngramjoin._mix(np.arange(1, 4, dtype=np.uint64))
    paths, above = ngramjoin._chosen(grams, starts, 1, 0.8)
    limit = int(2**64 / (0.8 * len(grams)))
    want = set()
    for s in starts:
        tried = ngramjoin._mix(grams ^ s)
        want |= {(int(p), int(s)) for p in ngramjoin._mix(tried[tried <= np.uint64(limit)] + np.uint64(1))}
    assert set(zip(paths.tolist(), above.tolist(), strict=True)) == want


def test_deeper_paths_are_one_row_a_set_and_texts_that_stay_are_not_shuffled(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = ngramjoin.signatures(docs)
    sets = signed.groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    opened = signed.where("doc_id < 60").select("cid", F.explode("paths").alias("path"))
    below = ngramjoin._below(docs, sets, opened, ngramjoin.N, ngramjoin.THRESHOLD, ngramjoin.LEVELS).collect()
    assert len(below) == len({bytes(r.cid) for r in below}) == 60
    assert {x.levels for r in below for x in r.below} == {2, 3, 4}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngramjoin.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 140)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
