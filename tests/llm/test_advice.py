"""Cases of the second review, each against brute force."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from logloom.llm import decontam, linededup, ngramjoin, toxicity

from .test_models import plain_edits
from .test_native import clash, documents


def plain_kept(lines):
    """Numbers of the lines that stay of a document of different lines."""
    sets = [{x[j : j + 5] for j in range(len(x) - 4)} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted({find(x) for x in range(len(lines))})


@pytest.mark.parametrize("block", [linededup.BLOCK, 5])
def test_a_hub_joins_hundreds_of_variants(spark, block):
    rng = random.Random(3)
    hub = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(90)).replace("  ", "ab").strip().ljust(90, "x")
    lines = {hub}
    while len(lines) < 300:
        at = rng.randrange(2, 88)
        lines.add(hub[:at] + rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + hub[at + 1 :])
    lines = sorted(lines, key=lambda x: (x == hub, x))
    docs = clash(documents(spark, [(1, "\n".join(lines), "s")]))
    firsts = linededup.distinct_lines(docs).cache()
    roots = linededup.components(linededup.similar(docs, firsts, block=block))
    left = firsts.join(roots, F.col("key") == F.col("node"), "left").select(F.coalesce("root", "key")).distinct().count()
    assert left == len(plain_kept(lines)) == 1


def test_leaks_without_spaces_short_and_quoted(spark):
    rng = random.Random(12)
    han = [chr(0x4E00 + i) for i in range(800)]
    run = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, run(60, han)) for i in range(4)] + [(i, run(80, "abcdefgh(){};=_")) for i in range(4, 8)]
    items += [(i, f"{run(6, 'abcdefgh')} {run(5, 'ijklmnop')} {run(8, 'abcdefgh')}") for i in range(8, 14)] + [(14, "tiny item"), (15, "xyz")]
    rows = []
    for i, (k, item) in enumerate(items * 4):
        text = list(item)
        for _ in range(rng.randint(0, int(decontam.MAX_EDIT_RATE * len(item)))):
            text[rng.randrange(len(text))] = rng.choice("abcdefgh")
        filler = han if k < 4 else "qrstuvw"
        rows.append((i, f"{run(150, filler)}{rng.choice(['(', '“', ''])}{''.join(text)}{run(150, filler)}", "s"))
    rows.append((900, run(300, han) + items[0][1] + run(300, han), "s"))
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t, _ in rows:
        for k, item in items:
            edits = plain_edits(decontam.normal(item), decontam.normal(t))
            if edits <= int(decontam.MAX_EDIT_RATE * len(item)):
                want.add((i, k, edits))
    assert got <= want and (900, 0, 0) in got
    assert len(got) >= 0.97 * len(want) and len(want) >= len(rows)


def test_rare_toxic_words_are_terms(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"word{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(30)]
        if i % 5 == 0:
            words += [f"rude{chr(97 + i // 5 % 15)}"] * 3
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = documents(spark, rows)
    index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    used = [i for i in range(0, 600, 5) if zlib.crc32(str(i).encode()) % 3 != 1]
    often = collections.Counter(i // 5 % 15 for i in used)
    known = {j for j in range(15) if often[j] >= 4}
    assert len(known) >= 8 and min(often[j] for j in known) <= 6
    assert all(f"rude{chr(97 + j)}" in index.vocabulary for j in known)
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, index).collect()}
    rude = [i for i in range(0, 600, 5) if i // 5 % 15 in known]
    assert sum(found[i] for i in rude) >= 0.95 * len(rude) and sum(found[i] for i in range(600) if i % 5) <= 5


def test_rows_without_or_with_repeated_ids(spark):
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    one, two, clean = prose(), prose(), prose()
    rows = [(None, one, "s"), (None, f"{one} more", "s"), (None, two, "s"), (7, clean, "s"), (7, f"{clean} again", "s"), (7, f" {clean}", "s"), (None, None, "s")]
    kept = [(r.doc_id, r.text) for r in ngramjoin.keep_one(clash(documents(spark, rows))).collect()]
    assert len(kept) == 4 and len([t for i, t in kept if i is None]) == 3 and (None, two) in kept and (None, None) in kept
    joined = ngramjoin.join_similar(documents(spark, rows))
    assert sorted(r.n_links for r in joined.collect()) == [0, 0, 1, 1, 1, 1, 1]
    leaks = [(7, clean, "s"), (7, f"{two} {one}", "s"), (8, clean, "s")]
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    left = decontam.decontaminate(clash(documents(spark, leaks)), items)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(7, clean), (8, clean)]
