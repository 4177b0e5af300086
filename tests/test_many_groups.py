"""Packing of many small groups: only groups of several intervals need exits."""

from pyspark.sql import functions as F

from logloom.operators import packing


def _plain(rows, n, limit):
    out, batch, used, taken = {}, {}, {}, {}
    for group, pos, size in sorted(rows):
        out[group, pos] = batch.setdefault(group, 0)
        used[group], taken[group] = used.get(group, 0) + size, taken.get(group, 0) + 1
        if taken[group] >= n or used[group] >= limit:
            batch[group], used[group], taken[group] = batch[group] + 1, 0, 0
    return out


def test_small_groups_have_no_exits(spark, monkeypatch):
    rows = [(f"g{i}", i * 10 + j, 1 + (i + j) % 7) for i in range(400) for j in range(1 + i % 3)]
    rows += [("hot", j, 1 + j % 5) for j in range(700)]
    seen, real = [], packing._exits

    def exits(rows, group, *rest):
        seen.append([r[0] for r in rows.select(group).distinct().collect()])
        return real(rows, group, *rest)

    monkeypatch.setattr(packing, "_exits", exits)
    monkeypatch.setattr(packing, "BUCKET_ROWS", 300, raising=False)
    df = spark.createDataFrame(rows, "name string, pos long, size long").repartition(3)
    packed = packing.pack_rows_tokens(df.withColumnRenamed("size", "_s"), 9, 20, "name", ["pos"], F.col("_s"), span=2, blocks=3)
    assert {(r.name, r.pos): r.batch_no for r in packed.collect()} == _plain(rows, 9, 20)
    assert seen == [["=hot"]]
