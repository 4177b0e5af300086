"""Matching rows to tools, and labels to labels, against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import similarity, toolbox, toolindex

TOOLS = "tool_ord long, g3 string, g4 string, g5 string, domain string, text string"
ASKED = "query_id long, features string, domain string, g5 string"


def terms(text):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def plain_match(asked, tools, idf):
    def vector(text):
        v = {t: (1 + math.log(n)) * idf[t] for t, n in terms(text).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [(ord_, domain, g5, vector(text)) for ord_, _, _, g5, domain, text in sorted(tools)]
    out = []
    for query_id, text, domain, g5 in asked:
        q = vector(text)
        best = (0.0, min(t[0] for t in tools))
        for ord_, d, g, v in vectors:
            score = sum(x * v.get(t, 0.0) for t, x in q.items())
            score *= (1.5 if d is not None and d == domain else 1.0) * (1.3 if g is not None and g == g5 else 1.0)
            if round(score, 9) > best[0]:
                best = (round(score, 9), ord_)
        out.append((query_id, f"g{best[1]}", round(best[0], 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"index_bytes": 4_000}, {"vocabulary_bytes": 0}])
def test_match_equals_plain_loops(spark, limits):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["swap", "pool"]
    some = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n)))
    pick = lambda *x: rng.choice([*x, None])
    tools = [(i * 3, f"g{i * 3}", "a", pick("lookup", "series"), pick("dex", "nft"), some(8)) for i in range(90)]
    tools += [(1000, "g1000", "a", "series", "dex", tools[4][5]), (1001, "g1001", "a", None, None, "")]
    asked = [(i, some(12), pick("dex", "nft", "mev"), pick("lookup", "series")) for i in range(150)]
    asked += [(3, some(9), "dex", "series"), (None, "w1 w2 w3", None, None), (7, None, "dex", None), (8, "zz yy", "dex", None), (9, "w1 " * 5_000, "nft", "series")]
    box = spark.createDataFrame(tools, TOOLS)
    fit = box.select("text").union(spark.createDataFrame([(some(9),) for _ in range(20)], "text string")).withColumn("doc_id", F.monotonically_increasing_id())
    vocabulary = toolbox.fit_vocabulary(fit)
    queries = spark.createDataFrame(asked, ASKED).withColumn("score", F.lit("x")).repartition(3)
    got = toolbox.match_toolbox(queries, box, vocabulary, **limits)
    assert got.columns == ["query_id", "g1", "g2", "g3", "g4", "g5", "domain", "score"]
    rows = sorted(((r.query_id, r.g3, round(r.score, 6)) for r in got.collect()), key=str)
    assert rows == plain_match(asked, tools, {r.term: r.idf for r in vocabulary.collect()})
    if not limits:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan.split("MapInArrow")[1] and "hashpartitioning" not in plan


@pytest.mark.parametrize("limits", [{"vocabulary_bytes": 16 * 40}, {"vocabulary_bytes": 0, "index_bytes": 4_000}])
def test_match_with_a_vocabulary_beyond_the_limit(spark, limits):
    """Only numbers of the rare terms are shuffled: rows are neither weighted by a window nor joined by text."""
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randint(0, n)))
    tools = [(i, f"g{i}", "a", "lookup", rng.choice(["dex", None]), some(6)) for i in range(40)]
    asked = [(i, some(20), "dex", rng.choice(["lookup", None])) for i in range(200)] + [(None, None, None, None), (3, "zz", "dex", None)]
    box = spark.createDataFrame(tools, TOOLS)
    queries = spark.createDataFrame(asked, ASKED).repartition(3)
    fit = box.select("text").union(queries.select("features")).withColumn("doc_id", F.monotonically_increasing_id())
    vocabulary = toolbox.fit_vocabulary(fit.where("text <> 'zz'"))
    got = toolbox.match_toolbox(queries, box, vocabulary, **limits)
    rows = sorted(((r.query_id, r.g3, round(r.score, 6)) for r in got.collect()), key=str)
    assert rows == plain_match(asked, tools, {r.term: r.idf for r in vocabulary.collect()})
    if "index_bytes" not in limits:
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_parts_that_follow_the_text(spark, monkeypatch):
    """A task's texts are bounded, so its terms are."""
    monkeypatch.setattr(toolbox, "TEXT_BYTES", 1 << 12)
    docs = spark.createDataFrame([(i, f"word{i} " * 200) for i in range(100)], "doc_id long, text string")
    counts = toolbox.term_counts(docs)
    assert counts.rdd.getNumPartitions() >= 30
    assert sorted((r.doc_id, r.term, r.tf) for r in counts.collect()) == sorted(x for i in range(100) for x in [(i, f"word{i}", 200), (i, f"word{i} word{i}", 199)])


def test_match_without_tools_or_rows(spark):
    box = spark.createDataFrame([(1, "a", "b", "c", "d", "w1 w2")], TOOLS)
    vocabulary = toolbox.fit_vocabulary(box.withColumnRenamed("tool_ord", "doc_id"))
    asked = spark.createDataFrame([(1, "w1", "d", "c")], ASKED)
    assert toolbox.match_toolbox(asked, box.where("false"), vocabulary).count() == 0
    assert toolbox.match_toolbox(asked.where("false"), box, vocabulary).count() == 0
    assert [r.score for r in toolbox.match_toolbox(asked, box, vocabulary.where("false")).collect()] == [0.0]


def test_index_bounds_skip_blocks_and_lose_nothing():
    rng = np.random.default_rng(2)
    tools, terms_ = 700, 300
    tool = np.repeat(np.arange(tools), 6)
    term = rng.integers(0, terms_, len(tool))
    tool, term = np.unique(np.stack([tool, term]), axis=1)
    weight = rng.random(len(tool)) ** 6
    domain, shape = [str(i % 5) for i in range(tools)], [str(i % 3) for i in range(tools)]
    index = toolindex.ToolIndex.build(domain, shape, tool, term, weight)
    dense = np.zeros((tools, terms_))
    dense[tool, term] = weight
    n = 60
    row = np.repeat(np.arange(n), 5)
    q_term = rng.integers(0, terms_ + 50, len(row))
    row, q_term = np.unique(np.stack([row, q_term]), axis=1)
    q_weight = rng.random(len(row))
    asked_d, asked_s = [str(i % 6) for i in range(n)], [None] * n
    seen = []
    inner = index._scores
    index._scores = lambda n, row, cell, *a: seen.append(int(a[1].sum())) or inner(n, row, cell, *a)
    best, score = index.search(n, row, q_term, q_weight, asked_d, asked_s)
    q = np.zeros((n, terms_))
    inside = q_term < terms_
    q[row[inside], q_term[inside]] = q_weight[inside]
    full = q @ dense.T
    for i in range(n):
        full[i, [d == asked_d[i] for d in domain]] *= 1.5
    want = toolindex.round9(full)
    assert (want.argmax(axis=1) == best).all() and np.allclose(want.max(axis=1), score)
    known, at = toolindex.find(index.terms, q_term)
    assert sum(seen) < 0.8 * (index.cell_of[at[known] + 1] - index.cell_of[at[known]]).sum()


def grams(label):
    words = label.split("_")
    return set(words) | {f"{a}_{b}" for a, b in zip(words, words[1:])}


def plain_nearest(asked, known):
    sets = [(n, grams(n)) for n in sorted(known)]
    out = []
    for label in asked:
        own, best, score = grams(label), min(known), 0.0
        for name, other in sets:
            s = len(own & other) / len(own | other)
            if s > score:
                best, score = name, s
        out.append((label, best, round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"rare": 1}, {"rare": 0}, {"rare": 5, "index_bytes": 40_000}])
def test_nearest_label_equals_plain_loops(spark, options):
    rng = random.Random(6)
    words = ["of", "system", "the", *(f"w{i}" for i in range(25))]
    weights = [40, 40, 20] + [1] * 25
    make = lambda: "_".join(rng.choices(words, weights, k=rng.randint(1, 6)))
    known = {make() for _ in range(500)} | {"of_system", "zz_of_system", "", "_", "a__b"}
    asked = {make() for _ in range(300)} | {"nothing", "", "other_thing", "of", "the_of_system_q"}
    frame = lambda names, c: spark.createDataFrame([(n,) for n in [*names, None]], f"{c} string")
    got = similarity.nearest_label(frame(asked, "label"), frame(known, "label"), **options)
    assert sorted((r.label, r.nearest, r.score) for r in got.collect()) == plain_nearest(asked, known)
    none = similarity.nearest_label(frame(["a"], "label"), frame([], "label"), "none").collect()
    assert [tuple(r) for r in none] == [("a", "none", 0.0)]


def test_nearest_label_looks_at_few_pairs():
    """A word that all labels share is not walked through."""
    known = [f"w{i}_v{i % 977}_of_system" for i in range(20_000)]
    index = similarity.LabelIndex.build(known, similarity.RARE_LABELS)
    looked = []
    inner = index._shared
    index._shared = lambda labels, rare: looked.append(len(labels)) or inner(labels, rare)
    for i in range(0, 20_000, 200):
        name, score = index.nearest(f"w{i}_x_of_system")
        assert name == f"w{i}_v{i % 977}_of_system" and 0 < score < 1
        assert index.nearest("q_of_system")[0] == min(known)
    assert sum(looked) < 100 * 100 and index.n_rare > 20_000


def test_vocabulary_query_writes_nothing(spark, tmp_path):
    """The vocabulary of the documents is read once there, so it is not held."""
    from logloom.plans.catalog import QUERIES, load_all

    if not QUERIES:
        load_all()
    spark.createDataFrame([(1, "w1 w2"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["fit_vocabulary"](spark, str(tmp_path))
    assert "LogicalRDD" not in got._jdf.queryExecution().logical().toString()
    assert {r.term for r in got.collect()} == {"w1", "w2", "w3", "w1 w2", "w1 w3"}
