"""Rows per table and mode from one pass, against the two routes."""

import random

from logloom.operators import routing

TABLES = [("dex", "trades"), ("dex", "trades_v2"), ("prices", "usd"), ("nft", "sales")]


def test_one_pass_counts_as_the_routes_do(spark, tmp_path):
    rng = random.Random(11)
    names = ["dex.trades", "DEX.Trades_V2", "prices.usd", "prices.usd_old", "other.table", "nft.s"]
    rows = [(None, None), (1, ""), (2, "select 1"), (3, "select * from dex.trades"), (3, "select * from dex.trades")]
    for i in range(4, 200):
        used = rng.choices(names, k=rng.randint(1, 4))
        rows.append((rng.choice([i, None]), "select * from " + " join ".join(used) + " " * rng.randint(0, 30)))
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, "query_id long, query_sql string").write.parquet(path)
    log = spark.read.parquet(path)
    popular = spark.createDataFrame([(n, t, f"{n}.{t}") for n, t in TABLES], "namespace string, `table` string, full_name string")
    seen = spark.createDataFrame([(i,) for i in range(4, 100)], "query_id long")
    for options in ({}, {"max_len": 45}, {"seen": seen}):
        single, multi = routing.route_single(log, popular, **options), routing.route_multi(log, popular, **options)
        got = routing.route_counts(log, popular, **options)
        want = sorted(map(tuple, routing.route_summary(single, multi).collect()))
        assert sorted(map(tuple, got.collect())) == want and len(want) >= 3
        # what is counted was read once and is held; the log is not scanned again
        assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    assert routing.route_counts(log.limit(0), popular).count() == 0
