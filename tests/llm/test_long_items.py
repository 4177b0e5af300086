"""Benchmark items of thousands of characters, and leaking rows without an id."""

import random

from logloom.llm import decontam

from .test_native import clash, documents


def test_long_items_leak_and_leave_no_crash(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(n))[:n]
    items = [(1, prose(2_289)), (2, prose(20_000)), (3, prose(1_000_000)), (4, prose(300))]
    near = list(items[0][1])
    for at in rng.sample(range(len(near)), 200):
        near[at] = "z"
    far = list(items[1][1])
    for at in rng.sample(range(len(far)), 9_000):
        far[at] = "z"
    rows = [
        (10, f"{prose(500)} {items[0][1]} {prose(500)}", "s"),
        (11, f"{prose(500)} {''.join(near)} {prose(500)}", "s"),
        (12, f"{prose(500)} {items[1][1]}", "s"),
        (13, "".join(far), "s"),
        (14, f"{prose(70)} {items[2][1]} {prose(70)}", "s"),
        (15, prose(3_000), "s"),
        (None, f"{prose(40)} {items[3][1]}", "s"),
        (None, prose(400), "s"),
    ]
    docs, benchmark = clash(documents(spark, rows)), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.find_leaks(docs, benchmark).collect()}
    assert got.keys() == {(10, 1), (11, 1), (12, 2), (14, 3), (None, 4)}
    assert got[10, 1] == got[12, 2] == got[14, 3] == got[None, 4] == 0 and 150 < got[11, 1] <= 200
    left = decontam.decontaminate(docs, benchmark)
    assert sorted((r.doc_id, len(r.text)) for r in left.collect() if r.doc_id) == [(13, 20_000), (15, 3_000)]
    assert left.where("doc_id IS NULL").count() == 1


def test_seed_lengths_in_whole_numbers():
    for size in (1, 2, 9, 40, 394, 999, 1_000, 1_690, 2_289, 20_000, 1_000_000):
        assert 1 <= decontam.seed_length(size, int(decontam.MAX_EDIT_RATE * size), decontam.GRAM) <= min(size, decontam.GRAM)
    assert decontam.seed_length(5_000, 750, 12) == decontam.seed_length(1_000, 150, 12) == 12
