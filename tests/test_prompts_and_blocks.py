"""What goes to the tasks: known ids once, a wave's own prompts, and slices of a matrix product."""

import tracemalloc

import numpy as np

from logloom.operators import replies, similarity
from logloom.plans import catalog


def test_known_ids_are_not_written_in_every_prompt(spark, tmp_path, monkeypatch):
    orders = ["id AS o_orderkey", "id * 7 % 40 AS o_custkey", "'1-URGENT' AS o_orderpriority"]
    spark.range(60).selectExpr(*orders).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).selectExpr("cast(id AS int) AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    suppliers = ["id AS s_suppkey", "concat('S', id) AS s_name", "cast(id % 5 AS int) AS s_nationkey"]
    spark.range(9).selectExpr(*suppliers).write.parquet(f"{tmp_path}/supplier.parquet")
    seen, real = [], replies.infer_batches

    def infer(prompts, fn, *rest, **named):
        seen.append((prompts.where("prompt LIKE '%Existing tool IDs%'").count(), named.get("known", "")))
        return real(prompts, fn, *rest, **named)

    monkeypatch.setattr(replies, "infer_batches", infer)
    catalog.load_all()
    catalog.QUERIES["infer_batches"](spark, str(tmp_path))
    [(inside, known)] = seen
    assert inside == 0 and known.startswith("## Existing tool IDs") and known.endswith("\n\n")


def test_memory_of_the_best_items_does_not_follow_the_queries():
    rng = np.random.default_rng(1)
    asked, items = rng.normal(size=(9000, 4)), rng.normal(size=(4096, 4))
    tracemalloc.start()
    best, score = similarity._best(asked, items, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # the whole product has 295 MB
    for i in (0, 1023, 1024, 8999):
        cosine = np.round(items @ asked[i], 9)
        want = np.lexsort((np.arange(len(items)), -cosine))[:5]
        assert best[i].tolist() == want.tolist() and np.allclose(score[i], cosine[want], atol=2e-9)


def test_each_wave_reads_its_own_prompts(spark, tmp_path, monkeypatch):
    prompts = spark.createDataFrame([(f"b{i}", f"text {i}") for i in range(40)] + [("n", None)], "batch_id string, prompt string")
    files, real = [], replies.infer_batches

    def infer(own, fn, **named):
        files.append(set(own.inputFiles()))
        return real(own, fn, **named)

    monkeypatch.setattr(replies, "infer_batches", infer)
    told = replies.infer_stored(prompts, lambda p: p.upper(), str(tmp_path / "store"), wave=10)
    got = {r.batch_id: r.reply_text for r in told.collect()}
    assert got.pop("n") is None and got == {f"b{i}": f"TEXT {i}" for i in range(40)}
    assert len(files) == 5 and all(files) and sum(map(len, files)) == len(set().union(*files))
