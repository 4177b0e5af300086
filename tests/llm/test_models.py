"""WARC, n-gram join, extraction, decontamination, toxicity and the pipeline against plain loops."""

import collections
import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import components, decontam, html, ngramjoin, toxicity, warc

from .test_native import clash, documents

PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "u", big), (3, "u\r\nx", big), (3, "v", big), (9, None, big), (None, "n", big), (1, "a", None), (2, "a", ""), (4, "s", "short"), (6, "s", "short"), (7, "l", "z" * 3_000_000)]
    pages = clash(spark.createDataFrame(rows, PAGES))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = collections.Counter()
    for page_id, _, text in rows:
        data = (text or "").encode()
        again = text == big and page_id != 3
        want[page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_rejects_damage():
    record = warc.encode_record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    archive = warc.encode_archive([record] * 20)
    assert struct.unpack_from("<I", archive)[0] == warc.DICT_MAGIC
    assert list(warc.decode_archive(archive)) == [record] * 20
    packed = zstandard.ZstdCompressor().compress(b"x" * 200)  # a dictionary may itself be compressed
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"x" * 200)).compress(record)
    assert list(warc.decode_archive(struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + frame)) == [record]
    for bad in (archive[:-3], archive[:6], archive + b"garbage!!"):
        with pytest.raises(warc.ArchiveError):
            list(warc.decode_archive(bad))
    for bad in (record[:-1], record.replace(b"Content-Length: ", b"Content-Length: 1", 1), record.replace(b"hello", b"hallo"), record.replace(b"WARC/1.1", b"XARC/1.1"), record.replace(b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(warc.ArchiveError):
            warc.decode_record(bad)


def similar_corpus(rng, n=120):
    vocabulary = [f"w{i}" for i in range(500)]
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if base and kind < 0.3:
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))]
            base.append(words)
        rows.append((i, " ".join(words), "s"))
    return rows


def plain_join(rows):
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[" ".join((t or "").split())].append(i)
    keys = [k for k in texts if k]
    sets = [{tuple(k.split()[j : j + 5]) for j in range(max(1, len(k.split()) - 4))} for k in keys]
    links, root = collections.Counter(), list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for a, k in enumerate(keys):
        classes[find(a)] += texts[k]
    return {i: (min(classes[find(a)]), links[a], len(texts[k])) for a, k in enumerate(keys) for i in texts[k]}


@pytest.mark.parametrize("bucket,block", [(256, 512), (2, 3)])
def test_join_equals_plain_join(spark, bucket, block):
    rows = similar_corpus(random.Random(4))
    rows += [(1000 + i, rows[0][1], "s") for i in range(40)] + [(2000, None, "s"), (2001, " \n", "s")]
    docs = clash(documents(spark, rows)).repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngramjoin.join_similar(docs, bucket=bucket, block=block, runs=16).collect()}
    want = plain_join(rows) | {2000: (2000, 0, 1), 2001: (2001, 0, 1)}
    assert got == want
    if bucket > 2:
        again = clash(documents(spark, [*rows, rows[0], (None, None, None)]))
        kept = [r.doc_id for r in ngramjoin.keep_one(again, runs=16).collect()]
        assert sorted(kept, key=str) == sorted([*{c for c, _, _ in want.values()}, None], key=str)
        assert ngramjoin.join_similar(documents(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 200)] + [(5, 5), (None, 3), (1, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 200)}


def test_extraction(spark):
    prose = [f"This is sentence number {i} of the page. It goes on for a while, as they do." for i in range(30)]
    rows = []
    for i in range(20):
        body = "".join(f"<p>{p}" for p in prose[i : i + 4])
        rows.append((i, "u", f"<title>t</title><nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>{prose[0]}</div><article><h1>Head &amp; line</h1>{body}<!-- x --></article><footer>&copy; {prose[3]}</footer>"))
    rows += [(90, None, None), (91, "u", ""), (92, "u", "<script>a<b"), (93, "u", "<<>< <!-- open " + "<p" * 50), rows[0]]
    pages = clash(spark.createDataFrame(rows, PAGES))
    got = collections.defaultdict(list)
    for r in html.extract(pages, train_pages=300).collect():
        got[r.page_id].append(r)
    for i in range(20):
        text = " ".join(["Head & line", *prose[i : i + 4]])
        assert all(r.text == text and r.n_chars == len(text) for r in got[i])
    assert len(got[0]) == 2 and [got[i][0].text for i in (90, 91, 92)] == ["", "", ""]
    assert html.extract(pages.limit(0)).count() == 0


def test_extraction_on_held_out_pages():
    pieces = [" ".join(random.Random(i).choices("alpha beta gamma delta. epsilon zeta, eta theta.".split(), k=60)) for i in range(40)]
    field = html.train_field(pieces)
    maker, wrong, total = html.Maker(pieces, 1234), 0, 0
    for _ in range(200):
        chain = html.blocks(maker.page())
        total += len(chain)
        wrong += sum(b.truth not in (-1, y) for b, y in zip(chain, field.label(chain), strict=True))
    assert wrong < 0.04 * total


def plain_edits(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(25)) for i in range(12)] + [(3, None), (4, ""), (50, "tiny item")]
    items.append(items[0])
    rows = [(None, items[1][1], "s"), (1, None, "s"), (2, "", "s"), (3, prose(4000) + items[2][1].upper(), "s"), (4, "a tiny item here", "s")]
    for i in range(10, 60):
        text = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = rng.choice("abcdefgh ")
        rows.append((i, f"{prose(30)} {''.join(text)} {prose(30)}" if i % 2 else prose(80), "s"))
    rows.append(rows[-1])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = clash(documents(spark, rows))
    got = collections.Counter((r.doc_id, r.item_id, r.edits) for r in decontam.find_leaks(docs, benchmark, block_items=5).collect())
    want, leaking = collections.Counter(), set()
    for i, t, _ in rows:
        for k, item in {(k, decontam.normal(x)) for k, x in items if x}:
            text = decontam.normal(t)
            edits = 0 if item in text else plain_edits(item, text) if len(text) < 2000 else 99
            if edits <= int(decontam.MAX_EDIT_RATE * len(item)):
                want[i, k, edits] += 1
                leaking.add(t)
    assert got == want and (3, 2, 0) in got and items[1][1] in leaking
    clean = decontam.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(((i, t) for i, t, _ in rows if t not in leaking), key=str)
    assert decontam.find_leaks(docs, benchmark.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), benchmark).count() == 0


def labelled(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        words = [f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(40)]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(["Grob!", "uebel", "mies,", "fies"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(random.Random(6))
    docs = clash(documents(spark, [*rows, (None, None, None), (-1, "", "s"), rows[0]]))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), labels[0]], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, marks)
    got = collections.defaultdict(list)
    for r in toxicity.score(docs, index).collect():
        got[r.doc_id].append(r)
    assert len(got[0]) == 2 and got[0][0].score == got[0][1].score and got[None][0].score == got[-1][0].score
    right = sum(got[i][0].predicted == y for i, _, y in labels)
    assert right >= 0.98 * len(labels) and all(0 <= r.score <= 1 for x in got.values() for r in x)
    kept = toxicity.reject(docs, index)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for x in got.values() for r in x)
    for text in ("grob mies worda", "uebel", "wordab wordcd fies fies"):  # pruned search equals the full one
        columns, weights = toxicity._unit(toxicity.Known(index.vocabulary).counts(text), index.idf)
        dense = [0.0] * len(index.idf)
        for c, w in zip(columns, weights, strict=True):
            dense[c] = w
        full = []
        for r in range(len(index.toxic)):
            part = slice(index.starts[r], index.starts[r + 1])
            full.append((-sum(dense[c] * w for c, w in zip(index.columns[part], index.weights[part], strict=True)), r))
        want = [(r, -s) for s, r in sorted((round(s, 12), r) for s, r in full if s < 0)[:15]]
        found = index.search(columns, weights, 15)
        assert [round(float(s), 9) for s in found[1]] == [round(s, 9) for _, s in want]
    one = toxicity.fit(docs, marks.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, one).collect()} == {0}
    assert toxicity.score(docs.limit(0), index).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = labelled(rng, 400)
    items = [(i, " ".join(f"item{i}x{j}" for j in range(20))) for i in range(3)]
    rows += [(500 + i, rows[i][1], "t") for i in range(20)]
    rows += [(600 + i, rows[390 - i][1] + " " + items[i % 3][1], "t") for i in range(6)]
    rows += [(700, None, None), (701, "", "t")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        columns = docs.columns
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
        seen.append(collections.Counter(r.doc_id for r in docs.collect()))
    toxic = {i for i, t, _ in rows if t and any(w in t.lower() for w in ("grob", "uebel", "mies", "fies"))}
    assert len(set(seen[0]) & toxic) <= 0.02 * len(toxic) and len(set(seen[0]) - toxic) >= 0.98 * (len(rows) - len(toxic))
    classes = plain_join([r for r in rows if r[0] in seen[0]])
    assert set(seen[1]) == {c for c, _, _ in classes.values()} | {700, 701}
    assert set(seen[2]) == {i for i in seen[1] if not 600 <= i < 606}
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 3 and seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(seen[4].values())
