"""What is judged before texts are compared exactly."""

import collections
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from logloom.llm import common, decontam, ngramjoin


def test_exact_edits_only_where_enough_of_an_item_is_there(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, prose(35)) for k in range(12)]
    texts, near = [], []
    for k, (_, item) in enumerate(items):
        edited = list(item)
        for at in rng.sample(range(len(item)), int(0.12 * len(item))):
            edited[at] = rng.choice("xyz ")
        near.append(decontam.normal("".join(edited)))
        texts.append(f"{prose(60)} {near[-1]} {prose(60)}")
        # runs of the item, but far too few
        texts.append(f"{prose(40)} {item[20:60]} {prose(40)} {item[90:130]} {prose(40)}")
    calls = []
    exact = decontam.edits_within
    monkeypatch.setattr(decontam, "edits_within", lambda item, region: calls.append((item, region)) or exact(item, region))
    found = decontam.Items(items, 12, 0.15, 4, 12, 3)
    texts = [decontam.normal(t) for t in texts]
    got = {(n, k) for n, k, _ in found.leaks(texts, 0.15)}
    assert {(2 * k, k) for k in range(12)} <= got
    # all that is asked may hold the item, and what may not hold it is beyond the limit
    assert all(found.possible([t for _, t in items].index(item), region, int(0.15 * len(item))) for item, region in calls)
    for _ in range(300):
        k, text = rng.randrange(12), rng.choice(texts + near)
        at = rng.randrange(len(text))
        region, limit = text[at : at + rng.randint(1, 500)], int(0.15 * len(items[k][1]))
        if not found.possible(k, region, limit):
            assert exact(items[k][1], region) > limit


def test_batches_are_searched_in_pieces():
    texts = ["a" * 5, None, "", "é" * decontam.SLICE_CHARS, "b", "c" * (3 * decontam.SLICE_CHARS), "d", None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    pieces = [p.column("text").to_pylist() for p in decontam.slices(batch, "text")]
    assert [t for p in pieces for t in p] == texts and len(pieces) == 3
    assert [p.num_rows for p in decontam.slices(batch.slice(0, 0), "text")] == [0]


def test_sets_below_split_buckets_are_not_joined_one_by_one(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    shared = " ".join(rng.choices(words, k=60))
    rows = [(k, f"{shared} {' '.join(rng.choices(words, k=20))}") for k in range(60)]
    rows += [(100 + k, rows[k][1] + " end") for k in range(0, 60, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = ngramjoin.signatures(docs).where("cid IS NOT NULL").groupBy("cid").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n", "sketch", "paths")]
    )
    sets = sets.localCheckpoint()
    finals = ngramjoin._final_buckets(docs, sets, ngramjoin.N, ngramjoin.THRESHOLD, ngramjoin.LEVELS, 6, 8)
    # by loops: a path counts with those above it, all of which split
    kept = sets.collect()
    texts = {ngramjoin._digest(ngramjoin.words_of(t)): ngramjoin.words_of(t) for _, t in rows}
    grams = {r.cid: ngramjoin.Shingler()(texts[bytes(r.cid)]) for r in kept}
    here, want = {r.cid: {p: None for p in r.paths} for r in kept}, set()
    for level in range(1, ngramjoin.LEVELS + 1):
        count = collections.Counter(p for paths in here.values() for p in paths)
        last = level == ngramjoin.LEVELS
        want |= {(bytes(c), p) for c, paths in here.items() for p in paths if count[p] > 1 and (last or count[p] <= 6)}
        opened = {c: np.array([p for p in paths if count[p] > 6], np.int64).view(np.uint64) for c, paths in here.items()}
        here = {c: ngramjoin._chosen(grams[c], p, level + 1, ngramjoin.THRESHOLD)[0].astype(np.int64).tolist() for c, p in opened.items() if len(p)}
    assert {(bytes(r.cid), r.path) for r in finals.collect()} == want and len(want) > 100


def test_comparisons_that_go_over_batches_are_whole():
    def rows(sizes):
        for path, size in enumerate(sizes):
            for k in range(size):
                yield {"cid": b"%d-%d" % (path, k), "n": 9, "sketch": bytes(64), "finals": np.array([path]), "path": path, "i": 0, "j": 0, "own": 0}

    sizes = [2, 5, 1, 7, 3, 3]
    whole = pd.DataFrame(rows(sizes))
    for step in (1, 2, 3, 4, 100):
        parts = [whole.iloc[a : a + step].reset_index(drop=True) for a in range(0, len(whole), step)]
        batches = list(ngramjoin._groups(iter([whole.iloc[:0], *parts])))
        groups = [(g.path, batch["cid"].tolist()[at : at + len(g.n)]) for batch, found in batches for at, g in found]
        assert groups == [(p, [b"%d-%d" % (p, k) for k in range(size)]) for p, size in enumerate(sizes)]
        # one batch out for a batch in, not one for each comparison
        assert len(batches) <= len(parts) + 1
    assert list(ngramjoin._groups(iter([]))) == []


def test_batches_of_texts_are_bounded_by_their_bytes(spark):
    def largest(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    docs = spark.range(300).repartition(1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    with common.batches_of(spark, "1m"):
        sizes = [r.n for r in docs.mapInPandas(largest, "n long").collect()]
    assert sum(sizes) == 300 * 20_000 and max(sizes) <= 1_100_000
    assert spark.conf.get(name, None) == before
