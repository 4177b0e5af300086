"""Quality rules, line dedup, chat formatting, sharding and mixing against plain loops."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logloom.llm import chat, linededup, mixing, quality, queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, len(t or "")) for i, t, s in rows], DOCS)


def clash(df):
    for name in ("score", "order", "size", "key", "line", "path", "cid", "shard_rows", "position"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_queries_equal_their_sql(spark, duck, name):
    import pandas as pd

    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = duck.execute(queries.CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(frame):
        return sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame[sorted(frame)].itertuples(index=False)), key=str)

    assert rows(got) == rows(want)


def test_quality_edges(spark):
    good = " ".join(f"word{i} goes here." for i in range(40))
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", "a"),
        (4, good, "a"),
        (4, good, "a"),
        (5, "x " * 60, "a"),
        (6, good + "\nAll rights reserved.\nHome\n", "a"),
        (7, " ".join(f"w{i}%%%" for i in range(80)), None),
        (None, " ".join(f"long{i}." for i in range(30000)), None),
    ]
    got = collections.defaultdict(list)
    for r in quality.clean_documents(clash(documents(spark, rows))).collect():
        got[r.doc_id].append(r)
    assert [got[i][0].n_words for i in (1, 2, 3)] == [0, 0, 0] and all(got[i][0].base_failed for i in (1, 2, 3, 5))
    assert len(got[4]) == 2 and got[4][0].kept and got[4][1].kept
    assert got[5][0].n_repeat_words == 60
    assert got[6][0].kept and got[6][0].clean_text == good and got[6][0].n_lines == 3
    assert not got[7][0].kept and not got[7][0].base_failed and got[7][0].n_symbols == 240
    assert got[None][0].n_words == 30000 and got[None][0].kept
    assert quality.clean_documents(documents(spark, [])).count() == 0


def plain_groups(docs, threshold=0.8):
    first = {}
    for doc_id, text, _ in docs:
        for i, line in enumerate((text or "").split("\n")):
            line = " ".join(line.split())
            if line:
                at = (doc_id is None, doc_id or 0, i)
                first[line] = min(first.get(line, at), at)
    lines = sorted(first, key=first.get)
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = collections.defaultdict(list)
    for i, line in enumerate(lines):
        if find(i) == i:
            kept[None if first[line][0] else first[line][1]].append(first[line][2])
    return kept


def test_line_dedup_equals_plain_groups(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 50]))) for _ in range(40)]
    rows = [(1, None, "a"), (2, "", "a"), (3, "\n \n", "a"), (None, base[0], "a")]
    for i in range(4, 44):
        lines = []
        for _ in range(3):
            words = rng.choice(base).split()
            if len(words) > 20 and rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append("  ".join(words))
        rows.append((i, "\n".join(lines), "a"))
    rows.append(rows[-1])
    got = linededup.dedup_lines(clash(documents(spark, rows))).collect()
    want = plain_groups(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: sorted(r.kept) for r in got} == {i: sorted(want[i]) for i, _, _ in rows}
    assert linededup.dedup_lines(documents(spark, [])).count() == 0
    text = {r.doc_id: r.text for r in linededup.cleaned(documents(spark, [(1, "a b c d e f\n\nx y z", "s"), (2, "a b c d e f\nq r", "s")])).collect()}
    assert text == {1: "a b c d e f\n\nx y z", 2: "q r"}


def test_line_dedup_tells_rows_without_or_with_one_id_apart(spark):
    rows = [(None, "one shared line of text\nonly the first", "a"), (None, "one shared line of text\nonly the second", "a")]
    rows += [(7, "another shared line here\nseven one", "a"), (7, "seven two is different\nanother shared line here", "a"), (7, None, "a")]
    rows += [(8, "said twice in two equal rows", "a")] * 2
    docs = clash(documents(spark, rows))
    got = linededup.dedup_lines(docs).collect()
    assert len(got) == len(rows) and all(r.n_kept == len(r.kept) <= r.n_lines for r in got)
    without = sorted(r.n_kept for r in got if r.doc_id is None)
    assert without == [1, 2]
    assert sorted((r.n_lines, r.n_kept) for r in got if r.doc_id == 7) == [(0, 0), (2, 1), (2, 2)]
    assert [r.kept for r in got if r.doc_id == 8] == [[0], [0]]
    texts = [t.text for t in linededup.cleaned(docs).collect()]
    assert sum("one shared line of text" in (t or "") for t in texts) == 1
    assert sum("another shared line here" in (t or "") for t in texts) == 1


@pytest.mark.parametrize("n", [40, 150, 600, 2500])
def test_line_dedup_recall_by_length(spark, n):
    rng = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = []
    for _ in range(200):
        a = "".join(rng.choice(letters) for _ in range(n))
        grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
        b = a
        while True:
            at = rng.randrange(n)
            c = b[:at] + rng.choice("ABCDEFGH") + b[at + 1 :]
            if len(grams(a) & grams(c)) < 0.8 * len(grams(a) | grams(c)):
                break
            b = c
        lines += [a, b]
    docs = documents(spark, [(i, x, "s") for i, x in enumerate(lines)])
    kept = sum(r.n_kept for r in linededup.dedup_lines(docs).collect())
    assert 200 <= kept <= 200 + 0.03 * 200


def test_chat_round_trip(spark):
    rng = random.Random(5)
    special = ["<|im_end|>\n", "&lt;|", "&amp;", "<|", "|>", "&nl;", "\n", "ok", "word " * 30]
    rows = [(None, None, None, None), (1, 0, "system", "only"), (2, 0, "assistant", "long " * 5000)]
    for conv in range(3, 30):
        for turn in range(rng.randint(1, 12)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "a\n<|b"])
            rows.append((conv, turn, role, rng.choice([None, "", *["".join(rng.choices(special, k=4)) for _ in range(8)]])))
    rows += rows[-3:]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (60, 512):
        windows = chat.format_windows(turns.withColumn("tokens", F.lit(1)), budget=budget, history_tokens=40).cache()
        got = {r.conv_id: r for r in chat.read_back(windows).collect()}
        by = collections.defaultdict(list)
        for r in rows:
            by[r[0]].append(r)
        assert got.keys() == by.keys()
        for conv, said in by.items():
            said.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
            whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in said)
            loss = "".join(r[3] or "" for r in said if r[2] == "assistant")
            assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
            assert (got[conv].n_turns, got[conv].loss_chars) == (len(said), len(loss))
            assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        for w in windows.collect():
            assert len(w.formatted.split("<|im_end|>\n")) - 1 >= w.n_repeated
    assert chat.read_back(chat.format_windows(turns.limit(0))).count() == 0


def test_shards_fit_and_equal_rows_are_cut(spark):
    rows = [(i, "x" * (i % 700), "s") for i in range(600)] + [(1, "same " * 20, "s")] * 500 + [(None, None, None), (9, "y" * 5000, "s")]
    docs = clash(documents(spark, rows)).repartition(5)
    got = sharding.assign_shards(docs, limit=4096).collect()
    assert len(got) == len(rows) and sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, _, _ in rows)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += len(r.text or "")
    assert [s for s in sizes.values() if s > 4096] == [5000] and len(sizes) < 4 * sum(sizes.values()) / 4096
    assert sharding.assign_shards(documents(spark, [])).count() == 0
    assert {r.shard for r in sharding.assign_shards(documents(spark, rows[:5])).collect()} == {"0-0"}


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(3000)]
    rows += [rows[0]] * 3 + [(None, None, "a")]
    docs = clash(documents(spark, rows)).repartition(4)
    got = mixing.assign(docs).collect()
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and list(r.positions) == sorted(r.positions)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    for s in target:
        assert abs(taken[s] - target[s]) <= 40 and target[s] <= 3 * size[s] + 1e-9
    ordered = mixing.curriculum(docs)
    assert ordered.columns == docs.columns
    out = [r.doc_id for r in ordered.collect()]
    want = collections.Counter()
    for r in got:
        want[r.doc_id] += len(r.positions)
    assert collections.Counter(out) == +want
    assert [r.doc_id for r in mixing.curriculum(docs.repartition(2)).collect()] == out
    assert mixing.assign(documents(spark, [])).count() == 0


def test_curriculum_shuffles_texts_once_and_keeps_the_order(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    rows += [rows[0]] * 4 + [(5, "other words", "b"), (None, None, "a"), (None, "no id", "c"), (None, "no id too", "c")]
    docs = clash(documents(spark, rows)).repartition(4).cache()
    want = sorted((p, r.order, str(r.doc_id)) for r in mixing.assign(docs).select("doc_id", "order", "positions").collect() for p in r.positions)
    for size in (100, 2000, 1 << 20):
        ordered = mixing.curriculum(docs, bucket_bytes=size)
        assert [str(r.doc_id) for r in ordered.collect()] == [w[2] for w in want]
    alone = mixing.curriculum(documents(spark, [(i, f"text {i} " + "w " * (i % 9), "a") for i in range(400)]), bucket_bytes=500)
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    # the only shuffle of rows that hold a text is the last one
    assert plan.count("Repartition") == 1 and plan.count("Join") == plan.count("rightHint=(strategy=broadcast)")
