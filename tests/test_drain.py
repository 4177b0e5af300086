"""Calls to a model that fails, replies that last, and rounds until nothing is left."""

import collections
import os
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import replies
from logloom.plans import flows
from logloom.session import scratch_path

TOOLS = "tool_id string, g1 string, g2 string, g3 string, g4 string, g5 string, description string, scope string, returns string, viz string, inputs string"


def asked_file(tmp_path):
    """A model that notes every prompt in a file (local mode: the workers share the disk)."""
    path = str(tmp_path / "asked")

    def model(prompt):
        with open(path, "a") as f:
            f.write(repr(prompt) + "\n")
        ids = [line[1 : line.index("]")] for line in prompt.split("\n") if line.startswith("[q")]
        return f"## Found\ng1: a\ng3: tool_{sum(map(len, ids)) % 3}\nsource_query_ids: {','.join(ids)}\n"

    return model, lambda: open(path).read().splitlines() if os.path.exists(path) else []


def test_calls_are_concurrent_and_tried_again(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(24)], "batch_id long, prompt string").coalesce(1)
    tried = collections.Counter()

    def model(prompt):
        began = time.time()
        time.sleep(0.05)
        tried[prompt] += 1
        if prompt == "KNOWN p3" or prompt.endswith(("1", "5")) and tried[prompt] < 3:
            raise ValueError("no")
        return f"{prompt} {tried[prompt]} {began} {time.time()}"

    got = replies.infer_batches(prompts, model, known="KNOWN ", workers=6, retries=2, backoff=0.01).collect()
    by = {r.batch_id: r for r in got}
    assert by[3].error == "error: no" and by[3].reply_text is None
    assert all(by[i].error is None and by[i].reply_text.startswith(f"KNOWN p{i} {3 if i % 10 in (1, 5) else 1} ") for i in range(24) if i != 3)
    spans = [tuple(map(float, r.reply_text.split()[-2:])) for r in got if r.reply_text]
    together = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert 1 < together <= 6
    dealt = replies.infer_batches(prompts, str.upper, parallelism=5)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 24


def test_replies_last(spark, tmp_path):
    model, asked = asked_file(tmp_path)
    store = scratch_path(spark, "replies")
    prompts = spark.createDataFrame([(i, f"p{i % 20}") for i in range(30)] + [(30, None)], "batch_id long, prompt string")
    bad = {"p3", "p4"}

    def shaky(prompt):
        if prompt in bad:
            raise ValueError("down")
        return model(prompt)

    first = {r.batch_id: r for r in replies.infer_stored(prompts.where("batch_id < 30"), shaky, store, wave=6).collect()}
    assert {i for i, r in first.items() if r.error} == {3, 4, 23, 24} and len(asked()) == 18
    again = {r.batch_id: r for r in replies.infer_stored(prompts.where("batch_id < 30"), model, store, wave=6).collect()}
    assert not any(r.error for r in again.values()) and len(again) == 30
    assert len(asked()) == 20 and len(set(asked())) == 20  # equal prompts once, answered ones never again


def log_of(spark, n=12):
    sql = "select 1 from dex.trades t join prices.usd p on 1=1 join nft.trades n on 1=1 where k = {}"
    rows = [(f"q{i}", "n", sql.format(i)) for i in range(n)] + [(None, "n", sql.format(99)), ("q0", "n", sql.format(0))]
    rows += [(f"qs{i}", "s", f"select {i} from dex.trades") for i in range(5)]
    tables = [(i + 1, *t.split("."), t, 9 - i, "top_80") for i, t in enumerate(("dex.trades", "nft.trades", "prices.usd", "never.used"))]
    return (
        spark.createDataFrame(rows, "query_id string, name string, query_sql string"),
        spark.createDataFrame(tables, "rank long, namespace string, `table` string, full_name string, count long, tier string"),
    )


def empty_state(spark):
    return flows.Registry(
        spark.createDataFrame([], TOOLS),
        spark.createDataFrame([], "tool_id string, kind string, value string"),
        spark.createDataFrame([], "query_id string, seen_at timestamp"),
    )


IDS = {f"q{i}" for i in range(12)} | {f"qs{i}" for i in range(5)}


def test_rounds_end_when_nothing_is_left(spark, tmp_path):
    model, asked = asked_file(tmp_path)
    log, tables = log_of(spark)
    path = scratch_path(spark, "state")
    down = [True]

    def half(prompt):
        if down[0] and "[q7]" in prompt:
            raise ValueError("down")
        return model(prompt)

    end = flows.extract_drained(log, tables, empty_state(spark), half, path, rows=3, groups=None)
    seen = {r.query_id for r in end.state.ledger.collect()}
    assert end.open_tables >= 1 and "q7" not in seen and len(seen) >= len(IDS) - 3
    assert {r.full_name for r in end.tables.collect()} >= {"never.used"}
    calls = len(asked())
    down[0] = False
    end = flows.extract_drained(log, tables, empty_state(spark), half, path, rows=3, groups={"pair": [("dex", "trades"), ("prices", "usd")]})
    assert {r.query_id for r in end.state.ledger.collect()} == IDS and end.open_tables == 0
    assert {r.full_name for r in end.tables.collect()} == {"dex.trades", "nft.trades", "prices.usd", "never.used"}
    assert [r.group_name for r in end.groups.collect()] == ["pair"]
    assert len(asked()) > calls and len(asked()) == len(set(asked()))
    again = flows.extract_drained(log, tables, empty_state(spark), half, path, rows=3, groups={"pair": [("dex", "trades"), ("prices", "usd")]})
    assert again.rounds == end.rounds and len(asked()) == len(set(asked()))


def test_a_killed_round_is_repeated_without_double_entries(spark, tmp_path, monkeypatch):
    model, asked = asked_file(tmp_path)
    log, tables = log_of(spark)
    path = scratch_path(spark, "state")
    drained = flows.incremental.drained_tables

    def killed(*_args):
        raise KeyboardInterrupt

    monkeypatch.setattr(flows.incremental, "drained_tables", killed)
    with pytest.raises(KeyboardInterrupt):
        flows.extract_drained(log, tables, empty_state(spark), model, path, rows=4, groups=None)
    calls = asked()
    assert calls
    monkeypatch.setattr(flows.incremental, "drained_tables", drained)
    end = flows.extract_drained(log, tables, empty_state(spark), model, path, rows=4, groups=None)
    assert sorted(r.query_id for r in end.state.ledger.collect()) == sorted(IDS) and end.open_tables == 0
    assert asked() == calls  # every reply was there
    links = end.state.links.where("kind = 'source'").select("tool_id", "value")
    assert links.count() == links.distinct().count()


def test_composite_groups(spark, tmp_path):
    model, asked = asked_file(tmp_path)
    log, _ = log_of(spark)
    groups = {"one": [("dex", "trades"), ("nft", "trades")], "none": [("no", "where")], "done": [("prices", "usd")]}
    done = spark.createDataFrame([("done",)], "group_name string")
    state, closed = flows.composite_round(log, empty_state(spark), done, model, groups, k=5)
    assert sorted(r.group_name for r in closed.collect()) == ["done", "none", "one"]
    assert len(asked()) == 1 and "## Source queries (5)" in eval(asked()[0])
    assert state.ledger.count() == 5 and state.ledger.where(F.col("query_id").startswith("qs")).count() == 0

    def down(_prompt):
        raise ValueError("down")

    state, closed = flows.composite_round(log, empty_state(spark), done, down, groups, k=5)
    assert sorted(r.group_name for r in closed.collect()) == ["done", "none"] and state.ledger.count() == 0
