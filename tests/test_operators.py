"""Operators against brute force on small, skewed fixtures."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from logloom.operators import cleaning, domains, evaluate, incremental, labels, popularity, replies, routing, similarity
from logloom.plans import flows
from logloom.sources import files, log
from logloom.streaming import arrivals

LOG = "query_id string, pos long, name string, description string, query_sql string, owner string"


def test_clean_keeps_null_ids_and_first_rows(spark):
    rows = [
        ("a", 1, " Copy of (#1) Copy of X copy of y", "N/A", "select 1 from t.u", " Bo "),
        ("a", 0, "Untitled", " fine ", "select 22 from t", "x"),
        (None, 2, "n", "-", "select 1 from t.u", None),
        (None, 3, "n", None, "select 333333", "o"),
        ("c", 4, "n", "", "short", "o"),
        ("d", 5, "n", "", None, "o"),
        ("e", 6, "n", "", None, "o"),
    ]
    df = spark.createDataFrame(rows, LOG).repartition(3)
    out = {r.pos: r for r in cleaning.clean(df).collect()}
    assert sorted(out) == [0, 2, 3]
    assert (out[0].name, out[0].description) == (None, "fine")
    assert out[2].description is None
    audit = [(r.step, r.rows_before, r.rows_after) for r in cleaning.clean_audit(df).orderBy("step_no").collect()]
    assert audit[:3] == [("dedupe_by_id", 7, 6), ("dedupe_by_sql", 6, 5), ("drop_short_sql", 5, 3)]
    assert audit[-1] == ("total", 7, 3)
    named = cleaning.normalize_text(df).filter("pos = 1").first()
    assert (named.name, named.owner) == ("x copy of y", "bo")


def test_clean_twice_is_clean_once(spark):
    rows = [(str(i % 30), i, f"Name {i % 4}", "d", f"select {i % 11} from ns.t", "O") for i in range(200)]
    once = cleaning.clean(spark.createDataFrame(rows, LOG))
    assert sorted(map(tuple, cleaning.clean(once).collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize("size, k", [(2, 5), (3, 4), (2, 500)])
def test_top_combinations_with_wide_rows(spark, size, k):
    rng = random.Random(size * k)
    names = [f"n.t{i:02d}" for i in range(25)]
    baskets = [sorted(rng.sample(names[: rng.choice([6, 25])], rng.choice([2, 3, 5, 6]))) for _ in range(80)]
    baskets += [sorted(rng.sample(names, 15)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(baskets)), "query_id long, tables array<string>")
    counts = Counter(c for b in baskets for c in combinations(b, size))
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    got = popularity.top_combinations(df, size, k).orderBy("rank").collect()
    members = [f"table_{x}" for x in "abc"[:size]]
    assert [(tuple(r[m] for m in members), r["count"]) for r in got] == want


def test_impact_crossing_row_is_tail(spark):
    df = spark.createDataFrame([(1, "a", "b", "a.b", 81), (2, "a", "c", "a.c", 19)], files.POPULAR_SCHEMA)
    assert [r.tier for r in popularity.impact(df).orderBy("rank").collect()] == ["tail_20", "tail_20"]
    df = spark.createDataFrame([(i, "a", "b", "a.b", 10) for i in range(1, 11)], files.POPULAR_SCHEMA)
    tiers = [r.tier for r in popularity.impact(df, block=3).orderBy("rank").collect()]
    assert tiers == ["top_80"] * 8 + ["tail_20"] * 2


def test_routing_prefix_and_repeats(spark):
    queries = spark.createDataFrame(
        [
            (1, "x", 'select 1 from "DEX"."trades_v2" join dex.trades on 1=1'),
            (2, "x", "select 1 from dex.trades"),
            (3, "x", "select 1 from mydex.trades"),
            (4, "x", "select 1 from dex.trade"),
            (5, "x", None),
        ],
        "query_id long, name string, query_sql string",
    )
    popular = spark.createDataFrame([("dex", "trades", "dex.trades"), ("dex", "trades_v2", "dex.trades_v2")], "namespace string, `table` string, full_name string")
    hits = sorted(map(tuple, routing.mentions_table(queries, popular).collect()))
    assert hits == [(1, "dex.trades"), (1, "dex.trades_v2"), (2, "dex.trades")]
    single = routing.route_single(queries, popular).collect()
    assert [(r.query_id, r.full_name) for r in single] == [(2, "dex.trades")]
    seen = spark.createDataFrame([("1",)], "query_id string")
    assert routing.route_multi(queries, popular, seen=seen).count() == 0


def test_composites_keep_first_member(spark):
    sql = "select 1 from prices.usd join dex.trades on 1=1"
    queries = spark.createDataFrame([(i, "n", sql) for i in range(30)], "query_id long, name string, query_sql string")
    members = routing.composite_members(spark, {"pv": [("prices", "usd"), ("dex", "trades")]})
    rows = routing.sample_composites(queries, members, k=10).collect()
    assert len(rows) == 10 and {r.full_name for r in rows} == {"prices.usd"}


def test_mark_seen_keeps_first_time(spark):
    ledger = spark.createDataFrame([("1", "2024-01-05")], "query_id string, seen_at string")
    ids = spark.createDataFrame([(1, "2023-01-01"), (2, "2024-02-02")], "query_id long, seen_at string")
    got = {r.query_id: r.seen_at for r in incremental.mark_seen(ledger, ids).collect()}
    assert got == {"1": "2024-01-05", "2": "2024-02-02"}


def test_lookup_cascade(spark):
    tax = spark.createDataFrame(
        [
            (0, "dex", "trades", "a", "b", "swap_done"),
            (1, "dex", "pools", "c", "d", "pool_made"),
            (2, "dex", "fees", "c", "d", "pool_made"),
            (3, None, "staking_rewards_paid", "e", "f", "reward_paid"),
            (4, "x", "trades", "g", "h", "last_wins"),
        ],
        "pos long, namespace string, table_name string, g1 string, g2 string, g3 string",
    )
    names = ["dex.trades", "trades", "cat.dex.trades", "dex.other", "y.trades", "z.paid_rewards", "nothing", "infra.none"]
    tables = spark.createDataFrame([(n,) for n in names], "`table` string")
    parts = (domains.table_dictionary(tax), domains.namespace_mode(tax), domains.word_index(tax))
    got = {r.table: r.g3 for r in domains.lookup_table(tables, *parts).collect()}
    assert got == {
        "dex.trades": "swap_done",
        "trades": "last_wins",
        "cat.dex.trades": "swap_done",
        "dex.other": "pool_made",
        "y.trades": "last_wins",
        "z.paid_rewards": "reward_paid",
        "nothing": None,
        "infra.none": None,
    }


def test_admission_equals_the_loop(spark):
    rng = random.Random(17)
    for _ in range(3):
        caps = {"g2": rng.randint(3, 6), "g3": rng.randint(4, 9)}
        words = ["a", "b", "c_d", "c_e", "d_e_f", "f", "a_b", "x_y", "y_z", "q"]
        known = {"g2": {"a"}, "g3": {"b", "x_y"}}
        rows = [(i, "n", f"t{i}", rng.choice(["defi", "??"]), rng.choice(words), rng.choice(words)) for i in range(60)]

        def grams(s):
            w = s.split("_")
            return set(w) | {"_".join(p) for p in zip(w, w[1:])}

        state = {k: set(v) for k, v in known.items()}
        want = []
        for i, ns, tbl, g1, g2, g3 in rows:
            out = {"g2": g2, "g3": g3}
            for layer in ("g2", "g3"):
                label = out[layer]
                if label in state[layer]:
                    continue
                if len(state[layer]) < caps[layer]:
                    state[layer].add(label)
                    continue
                score = lambda c: len(grams(label) & grams(c)) / len(grams(label) | grams(c))  # noqa: B023, E731
                out[layer] = min(state[layer], key=lambda c: (-score(c), c))
            want.append((i, ns, tbl, g1 if g1 == "defi" else "infra_fallback", out["g2"], out["g3"]))
        df = spark.createDataFrame(rows, "pos long, namespace string, table_name string, g1 string, g2 string, g3 string")
        registry = spark.createDataFrame([(k, v) for k, vs in known.items() for v in vs], "kind string, label string")
        got = sorted(map(tuple, labels.admit_labels(df, registry, caps).collect()))
        assert got == want


@pytest.mark.parametrize("shape", ["clustered", "spread"])
def test_vector_topk_in_small_blocks(spark, shape):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 8)) * (6 if shape == "clustered" else 0)
    # a third of the items sits in one place, some are equal
    items = [centres[0 if i % 3 == 0 else i % 5] + rng.normal(size=8) for i in range(240)]
    items[7] = items[8] = items[9]
    queries = [centres[i % 5] + rng.normal(size=8) for i in range(30)]
    frame = lambda rows, name: spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} long, embedding array<double>"
    )
    got = similarity.vector_topk(frame(queries, "query_id"), frame(items, "item_id"), k=6, pivots=7, item_rows=16, query_rows=8)
    unit = lambda m: np.array(m) / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = np.round(unit(queries) @ unit(items).T, 9)
    want = {(q, r + 1): int(i) for q in range(30) for r, i in enumerate(np.lexsort((np.arange(240), -cosine[q]))[:6])}
    assert {(r.query_id, r["rank"]): r.item_id for r in got.collect()} == want


def test_markdown_tools(spark):
    md = "##  First\ng1: defi\ng3: a\ninputs:\n- key:x label:The X required:true default:null\nnote\n- key:y\n## Second\ng1: nft\n"
    rows = spark.createDataFrame([(1, md), (2, "NO_COMPOSITES"), (3, None)], "batch_id long, reply_text string")
    got = replies.parse_tools_md(rows).collect()
    assert [(r.batch_id, r.g3, r.viz) for r in got] == [(1, "a", "table")]
    assert [tuple(i) for i in got[0].inputs] == [("x", "The X", None, True, None)]


def test_json_replies(spark):
    texts = ['```json\n{"g1":"a","g3":"b"}\n```', '{"g1":"a"} and more', "no", "", None, '{"g1":']
    rows = spark.createDataFrame(list(enumerate(texts)), "batch_id long, reply_text string")
    tools, errors = replies.split_parse_errors(rows)
    assert [r.batch_id for r in tools.collect()] == [0]
    assert sorted(r.batch_id for r in errors.collect()) == [1, 2, 3, 4, 5]


def test_failed_call_is_a_row(spark):
    prompts = spark.createDataFrame([(1, "good"), (2, "bad")], "batch_id long, prompt string")

    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("busy")
        return prompt.upper()

    got = {r.batch_id: (r.reply_text, r.error) for r in replies.infer_batches(prompts, model).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "error: busy")}


def test_all_known_ids_are_in_a_prompt(spark):
    tools = spark.range(20_000).selectExpr("'a' AS g1", "concat('t', id) AS g3")
    members = spark.createDataFrame([(1, 1, 5, "n", "select 1")], "batch_id long, position int, query_id long, name string, query_sql string")
    assert replies.build_prompts(members, tools).first().prompt.count("a.t") == 20_000


def test_accuracy_of_nothing(spark):
    empty = spark.createDataFrame([], "query_id long, g1 string, g2 string, g3 string, g4 string, g5 string")
    assert [r.accuracy for r in evaluate.label_accuracy(empty, empty).collect()] == [None] * 3


def test_all_text(spark):
    df = spark.createDataFrame([(1, True, "nan", "a\tb"), (None, False, "", "None ")], "a int, b boolean, c string, d string")
    got = [tuple(r) for r in log.to_all_text(df).collect()]
    assert got == [("1", "True", None, "a b"), (None, "False", None, "None ")]


def test_flows_from_files(spark, tmp_path):
    """Read, clean, report, export, match: the whole way on a log in two files."""
    sql = ["select a, b from dex.trades t join prices.usd p on t.x = p.x where n = {}", "select * from dex.trades where n = {}"]
    rows = [
        (None if i % 50 == 0 else f"q{i % 90}", f"Name {i}", "about", "[]", sql[i % 2].format(i % 40), "Bo", i % 3)
        for i in range(200)
    ]
    schema = "query_id string, name string, description string, tags string, query_sql string, owner string, version int"
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    spark.createDataFrame(rows[:20], schema).coalesce(1).write.mode("append").parquet(path)
    raw = log.read_log(spark, path)
    assert raw.select("pos").distinct().count() == 220
    for name in log.LOG_COLUMNS:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    assert cleaning.dedupe_by_id(raw).filter("query_id is null").count() == 5
    cleaned, impact = flows.popularity_report(raw)
    assert cleaned.count() == 40  # one per text
    tables = {r.full_name: r.tier for r in impact.collect()}
    assert set(tables) == {"dex.trades", "prices.usd"}
    forced = impact.withColumn("tier", F.lit("top_80"))
    report = flows.export_by_table(cleaned, forced, str(tmp_path / "out"), chunk_mb=0.003).collect()
    assert {r.mode for r in report} == {"single", "multi"} and max(r.n_bytes for r in report) <= 3145
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "single").rglob("part-*")))
    assert text.count("INSERT INTO") == 20
    gold = cleaned.limit(3).select("query_id", F.lit("gold_tool").alias("g3"), F.lit("a|b").alias("g4"), F.lit("series").alias("g5"))
    matches = flows.match_log(flows.build_toolbox(cleaned, gold))
    assert matches.count() == cleaned.count()
    done = flows.export_by_table(raw, forced, str(tmp_path / "twice"), chunk_mb=0.003)
    written = "".join(p.read_text() for p in sorted((tmp_path / "twice").rglob("part-*")))
    assert written.count("INSERT INTO") == sum(r.n_rows for r in done.collect()) == 330
    tax = spark.createDataFrame([(0, "dex", "trades", "a", "b", "c")], "pos long, namespace string, table_name string, g1 string, g2 string, g3 string")
    assert domains.query_domain(raw, tax).count() == domains.classify_rules(raw, tax).count() == 220
    empty = spark.createDataFrame([], "name string, count long, domain string")
    assert domains.vote_domain(raw, empty).count() == 220


def test_round_sends_each_query_once(spark):
    sql = "select 1 from dex.trades t join prices.usd p on 1=1 join nft.trades n on 1=1 where k = {}"
    queries = spark.createDataFrame([(f"q{i}", "n", sql.format(i) + " " * 2000) for i in range(6)], "query_id string, name string, query_sql string")
    tables = spark.createDataFrame(
        [(i + 1, *n.split("."), n, 9 - i, "top_80") for i, n in enumerate(("dex.trades", "nft.trades", "prices.usd"))],
        "rank long, namespace string, `table` string, full_name string, count long, tier string",
    )
    ledger = spark.createDataFrame([], "query_id string, seen_at timestamp")
    links = spark.createDataFrame([], "tool_id string, kind string, value string")
    tools = spark.createDataFrame([], "tool_id string, g1 string, g2 string, g3 string, g4 string, g5 string, description string, scope string, returns string, viz string, inputs string")

    def model(prompt):
        ids = [line[1 : line.index("]")] for line in prompt.split("\n") if line.startswith("[q")]
        return f"## Found\ng1: a\ng3: tool_{len(ids)}\nsource_query_ids: {','.join(ids)}\n"

    state = flows.extract_round(queries, tables, flows.Registry(tools, links, ledger), model)
    assert sorted(r.query_id for r in state.ledger.collect()) == [f"q{i}" for i in range(6)]
    assert [r.g3 for r in state.tools.collect()] == ["tool_6"]  # one prompt with all six


def test_yaml_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    text = "version: 2\n\nsources:\n  - name: dex\n    # note\n    tables:\n      - name: trades\n        columns:\n          - name: c\n      - name: fees\n    meta: x\n      - name: lost\n  - name: nft\n    tables:\n      - name: mints\n"
    (tmp_path / "deep" / "a.yml").write_text(text)
    (tmp_path / "b.yaml").write_text("  - name: one\n    tables:\n      - name: t")
    (tmp_path / "c.txt").write_text(text)
    rows = files.scan_source_yaml(files.read_yaml_lines(spark, str(tmp_path)))
    got = [tuple(r) for r in files.source_tables(rows).collect()]
    assert got == [("dex", "fees"), ("dex", "trades"), ("nft", "mints"), ("one", "t")]
    assert files.source_tables(rows, "table", unique=False).count() == 4


def test_stream_passes_each_id_once(spark, tmp_path):
    source, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    schema = "query_id long, pos long, name string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        arrivals.stream_new_queries(stream, ledger, state).awaitTermination()

    arrive([(1, 5, "late"), (1, 2, "first"), (2, 1, "b")])
    arrive([(2, 9, "again"), (3, 8, "c"), (1, 0, "too late")])
    got = sorted(tuple(r) for r in arrivals.read_ledger(spark, ledger).select("query_id", "pos", "name").collect())
    assert got == [("1", 2, "first"), ("2", 1, "b"), ("3", 8, "c")]


def test_page_numbers_ids_only(spark):
    df = spark.createDataFrame([(i, None if i % 5 else "n", None if i % 7 == 0 else f"q{i}") for i in range(100)], "query_id long, name string, query_sql string")
    want = [i for i in range(100) if i % 7][20:30]
    assert [r.query_id for r in log.page(df.repartition(5), 20, 10).collect()] == want


def test_page_counts_rows_without_id_and_repeated_rows(spark):
    from logloom.sources import log

    rows = [(None, "a", "s1"), (None, "b", "s2"), (1, "c", "s"), (1, "c", "s"), (1, None, "t"), (2, "d", None)]
    df = spark.createDataFrame(rows, "query_id long, name string, query_sql string")
    whole = [tuple(r) for r in log.page(df, 0, 10).collect()]
    assert sorted(whole, key=str) == sorted([(i, n or "", q) for i, n, q in rows if q], key=str)
    assert [tuple(r) for k in range(5) for r in log.page(df, k, 1).collect()] == whole
