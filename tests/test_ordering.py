"""Row numbers, running values and packing against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.functions.ordering import dense_position, running
from logloom.operators import packing


def test_dense_position(spark):
    rng = random.Random(3)
    keys = rng.sample(range(10**6), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    got = {r.k: r.position for r in dense_position(df, "k").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_running_over_blocks(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, 1, 2, 7])) for g, n in (("hot", 900), ("b", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(6)
    out = running(df, "i", keys=["g"], sums={"total": F.col("v")}, lasts={"seen": F.col("v")}, block=16)
    want, total, seen = {}, defaultdict(int), {}
    for g, i, v in rows:
        total[g] += v or 0
        seen[g] = v if v is not None else seen.get(g)
        want[g, i] = (total[g], seen[g])
    assert {(r.g, r.i): (r.total, r.seen) for r in out.collect()} == want


def test_running_without_keys(spark):
    df = spark.range(1, 301).withColumnRenamed("id", "i")
    out = running(df, "i", sums={"total": F.col("i")}, block=32)
    assert all(r.total == r.i * (r.i + 1) // 2 for r in out.collect())


def loop(rows, closes):
    """closes(used, count, size) -> (close before, close after)."""
    out, groups = {}, defaultdict(list)
    for g, i, s in rows:
        groups[g].append((i, s))
    for g, members in groups.items():
        batch = used = count = 0
        for i, s in sorted(members):
            if count and closes(used, count, s)[0]:
                batch, used, count = batch + 1, 0, 0
            out[g, i] = batch
            used, count = used + s, count + 1
            if closes(used, count, 0)[1]:
                batch, used, count = batch + 1, 0, 0
    return out


# A hot group, one-row and exact-fit groups, rows above the budget.
RNG = random.Random(11)
ROWS = [
    (g, i, RNG.choice([1, 2, 3, 5, 9, 20, 45 if g == "big" else 4]))
    for g, n in (("hot", 600), ("big", 200), ("one", 1), ("few", 9))
    for i in range(n)
]


@pytest.mark.parametrize("span, blocks", [(2, 2), (3, 4), (64, 512)])
@pytest.mark.parametrize("budget, n", [(20, None), (7, None), (25, 6), (10**6, 6)])
def test_pack(spark, span, blocks, budget, n):
    df = spark.createDataFrame(ROWS, "g string, i long, s long").repartition(5)
    got = packing.pack(df, "g", ["i"], F.col("s"), packing.Rule(budget, n), span, blocks)
    before = lambda used, count, s: used + s > budget
    after = lambda used, count, s: count >= n or used >= budget
    want = loop(ROWS, (lambda *a: (before(*a), False)) if n is None else (lambda *a: (False, after(*a))))
    assert {(r.g, r.i): r.batch_no for r in got.collect()} == want


def test_pack_tokens_cuts_large_rows(spark):
    df = spark.createDataFrame([("a", 1, 500), ("a", 2, 90), ("a", 3, 600)], "g string, i long, s long")
    got = packing.pack_tokens(df, 400, "g", ["i"], F.col("s"), cut=True).orderBy("i").collect()
    assert [(r.size, r.batch_no) for r in got] == [(300, 0), (90, 0), (300, 1)]


def test_pack_tokens_splits_large_rows(spark):
    text = "".join(chr(97 + i % 26) for i in range(4 * 900 + 3))
    df = spark.createDataFrame([("a", 1, text), ("a", 2, "y" * 360), ("a", 3, None)], "g string, i long, t string")
    tokens = F.coalesce(F.floor(F.length("t") / 4), F.lit(0))
    got = packing.pack_tokens(df, 400, "g", ["i"], tokens).join(df, ["g", "i"])
    got = got.withColumn("part", packing.piece_of_text("t", "piece_no", 400)).orderBy("i", "piece_no").collect()
    assert [(r.i, r.piece_no, r.size, r.batch_no) for r in got] == [(1, 0, 400, 0), (1, 1, 400, 1), (1, 2, 100, 2), (2, 0, 90, 2), (3, 0, 1, 2)]
    assert "".join(r.part for r in got if r.i == 1) == text
    even = spark.createDataFrame([("a", 1, text[:3203])], "g string, i long, t string")
    got = packing.pack_tokens(even, 400, "g", ["i"], tokens).join(even, ["g", "i"])
    parts = [r.part for r in got.withColumn("part", packing.piece_of_text("t", "piece_no", 400)).orderBy("piece_no").collect()]
    assert [len(p) for p in parts] == [1600, 1603] and "".join(parts) == text[:3203]


def test_rows_without_group_or_id_are_packed_and_written(spark, tmp_path):
    rows = [(None, 1, "a", "x" * 9), (None, 2, None, "y" * 9), ("g", 3, "a", "z" * 9), ("g", 4, None, "w" * 9), (None, 5, None, "v" * 9)]
    df = spark.createDataFrame([(g, i, q, t + "\n") for g, i, q, t in rows], "g string, n long, id string, line string")
    chunks = packing.chunk_bytes(df, 20, "g", ["id", "n"], "line", span=2)
    assert sorted((str(r.g), r.n, r.batch_no) for r in chunks.collect()) == [("None", 1, 1), ("None", 2, 0), ("None", 5, 0), ("g", 3, 0), ("g", 4, 0)]
    packing.write_chunks(df, chunks, str(tmp_path / "out"), "g", ["id", "n"], "line")
    lines = [x for p in (tmp_path / "out").rglob("part-*") for x in p.read_text().splitlines() if not p.name.endswith(".crc")]
    assert sorted(lines) == sorted(t for _, _, _, t in rows)


def test_written_chunks_keep_order_and_budget(spark, tmp_path):
    df = spark.createDataFrame([("t", i, f"{'x' * (i % 7)}\n") for i in range(50)], "g string, i long, line string")
    chunks = packing.chunk_bytes(df, 40, "g", ["i"], "line")
    packing.write_chunks(df, chunks, str(tmp_path / "out"), "g", ["i"], "line")
    folder = tmp_path / "out" / "g=t"
    files = sorted(folder.iterdir(), key=lambda p: int(p.name.removeprefix("file_name=file").removesuffix(".sql") or 1))
    texts = ["".join(f.read_text() for f in sorted(d.glob("part-*"))) for d in files]
    assert all(len(t) <= 40 for t in texts)
    assert "".join(texts) == "".join(f"{'x' * (i % 7)}\n" for i in range(50))
