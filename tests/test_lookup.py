"""Dictionaries inside the row against the join that replaces them beyond the size bound."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import lookup
from logloom.operators import cleaning, domains


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_names_are_found_in_the_row(spark, n):
    known = {f"k{i}": i for i in range(n)}
    table = spark.createDataFrame(list(known.items()), "name string, at long")
    rows = [(i, [f"k{random.Random(i).randint(0, 600)}" for _ in range(i % 5)] + [None]) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, names array<string>")
    got = lookup.in_row(df, table, "name", "at", "found", lambda find: F.transform("names", lambda x: find(x)))
    assert got.columns == ["id", "names", "found"]
    for r in got.collect():
        assert r.found == (None if r.names is None else [known.get(x) for x in r.names])
    assert lookup.in_row(df, table, "name", "at", "found", lambda find: find(F.lit("k0")), most=-1) is None


def test_both_ways_of_classifying_agree(spark, monkeypatch):
    rng = random.Random(8)
    tables = ["dex.trades", "prices.usd", "aave.borrows", "zz.other", "uniswap_v2.pair", "zz.q"]
    log = []
    for i in range(300):
        said = " ".join(f"from {t}" if j == 0 else f"join {t} on 1=1" for j, t in enumerate(rng.choices(tables, k=rng.randint(0, 5))))
        log.append((rng.choice([i, None, 1]), f"select 1 {said}" if rng.random() < 0.95 else None, rng.choice(["nft sales", "", None]), "x"))
    log = spark.createDataFrame(log, "query_id long, query_sql string, name string, tags string")
    tax = [(0, "dex", "trades", "a", "b", "c"), (1, "prices", "usd", "d", "e", "f"), (2, "zz", "q", "g", "h", "i")]
    tax = spark.createDataFrame(tax, "pos long, namespace string, table_name string, g1 string, g2 string, g3 string")
    mapping = spark.createDataFrame([("dex", 3, "trading"), ("zz", 2, None), ("aave", 1, "lending")], "name string, count long, domain string")

    def all_rows():
        return [sorted(map(str, f(log, m).collect())) for f, m in ((domains.query_domain, tax), (domains.vote_domain, mapping))]

    here = all_rows()
    monkeypatch.setattr(domains, "in_row", lambda *_: None)
    assert all_rows() == here and len(here[0]) == len(here[1]) == 300


def test_dedupe_keeps_rows_of_missing_texts_and_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, ""]), i, rng.choice(["x", "", None, "y", "second"])) for i in range(60)]
    df = spark.createDataFrame(rows, "query_id string, pos long, query_sql string").repartition(5)
    by_id = {r[0]: r[1] for r in reversed(rows) if r[0] is not None}
    want = sorted(list(by_id.values()) + [r[1] for r in rows if r[0] is None])
    assert sorted(r.pos for r in cleaning.dedupe_by_id(df).collect()) == want
    by_text = {r[2]: r[1] for r in reversed(rows)}
    assert sorted(r.pos for r in cleaning.dedupe_by_sql(df).collect()) == sorted(by_text.values())
    assert cleaning.clean(df.withColumns({c: F.lit("n") for c in ("owner", "name", "description")}).limit(0)).count() == 0
