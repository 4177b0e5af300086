"""Similarity join of documents by the Jaccard similarity of their word n-grams.

Chosen-path join.  In every run a set chooses each of its n-grams with probability
1 / (threshold * size), by a hash all sets share, so sets that are similar choose a common n-gram
more often than not.  Sets with the same choice form a bucket; a bucket above `bucket` sets
splits again on n-grams chosen below that path.  Small buckets are compared by brute force.
A pair at the threshold chooses a common n-gram of a path with probability 0.63, and so shares a
bucket in a run with 0.63, 0.47, 0.38 and 0.31 after none to three splits; the number of runs
follows from the target recall after the most splits there can be (`runs_for`), so that pairs of
smaller buckets, or above the threshold, are met more surely than that.  Paths below a bucket
are made only for the sets of buckets that split.

Large groups of near copies are not told apart by any n-gram.  Such a bucket, still too large at
the last level, is compared block by block, each pair of blocks in a task of its own choice, so nothing
is dropped.  Pairs never leave their task: a task counts links and hands on the edges of a
spanning forest.  A pair that meets in several buckets counts in the smallest one only.

Defined cases: equal texts (up to white space) are one set, whatever their number; a text
of fewer than n words is one n-gram of all its words; a null text, or one without a word,
is linked with nothing and is a class of its own row's id; repeated ids are rows of their own; a class is
named by its smallest doc_id, nulls last; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import SPACES, stored
from .components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.98
LEVELS = 4
BUCKET = 256
BLOCK = 512
SKETCH = 32
#: A pair at the threshold agrees in 26 of 32 sketch values on average; fewer than 17 occur once in 10,000.
MIN_AGREE = 17
SEED = 77

SIGNATURE = "doc_id long, h long, cid binary, n int, sketch binary, paths array<long>"
DIGEST = 16


def runs_for(recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs in which a pair at the threshold is met with probability `recall`, when its buckets split at all levels."""
    met = 1.0
    for _ in range(levels):
        met = 1 - math.exp(-met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()[:DIGEST]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """The distinct n-gram hashes of texts; word hashes are remembered up to a bound."""

    REMEMBERED = 100_000

    def __init__(self, n: int = N):
        self.n = n
        self.known = _WordHashes()
        self.odd = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if len(h) < self.n:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64) if len(h) else h
        last = len(h) - self.n + 1
        grams = np.zeros(last, np.uint64)
        for k in range(self.n):
            grams += h[k : k + last] * self.odd[k]
        return np.unique(_mix(grams))


def words_of(text: str | None) -> list[bytes]:
    """Runs without space, tab, newline, \\v, \\f or \\r, as bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _sketch(grams: np.ndarray) -> bytes:
    odd = _mix(np.arange(SEED, SEED + SKETCH, dtype=np.uint64)) | np.uint64(1)
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for a in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[a : a + 4096, None] * odd).min(axis=0))
    return (_mix(least) >> np.uint64(48)).astype(np.uint16).tobytes()


def _chosen(grams: np.ndarray, paths: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The paths of `level` that a set chooses below `paths`, each once, and the path above each."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(grams)))))
    found, above = [], []
    for a in range(0, len(grams), 1 << 16):
        tried = _mix(grams[a : a + (1 << 16), None] ^ paths[None, :])
        gram, path = np.nonzero(tried <= limit)
        found.append(_mix(tried[gram, path] + np.uint64(level)))
        above.append(paths[path])
    # a set is in a bucket once
    out, at = np.unique(np.concatenate(found), return_index=True)
    return out, np.concatenate(above)[at]


def signatures(
    docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, runs: int | None = None, levels: int = LEVELS
) -> DataFrame:
    """(doc_id, text) -> hash of the text, id of the word sequence, number of n-grams, sketch and chosen paths."""
    starts = _mix(np.arange(runs or runs_for(levels=levels), dtype=np.uint64) + np.uint64(1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for batch in batches:
            rows = []
            for doc_id, text, h in zip(batch["doc_id"], batch["text"], batch["h"], strict=True):
                words = words_of(text)
                doc = None if pd.isna(doc_id) else int(doc_id)
                if not words:
                    rows.append((doc, h, None, 0, None, None))
                    continue
                grams = shingle(words)
                paths, _ = _chosen(grams, starts, 1, threshold)
                rows.append((doc, h, _digest(words), len(grams), _sketch(grams), paths.astype(np.int64)))
            out = pd.DataFrame(rows, columns=["doc_id", "h", "cid", "n", "sketch", "paths"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInPandas(run, SIGNATURE)


def _texts_by_id(docs: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """`rows` (doc_id, cid and `names`) with every text of the id: the right one has the digest."""
    # texts without an id are told apart by their own digest, else all would meet all
    digest = F.unhex(F.substring(F.sha2(F.btrim(F.regexp_replace("text", SPACES, " ")), 256), 1, 2 * DIGEST))
    none = F.lit(b"")
    named = small_side(
        rows.select(
            "cid", *names, F.col("doc_id").alias("_d"), F.when(F.col("doc_id").isNull(), F.col("cid")).otherwise(none).alias("_c")
        )
    )
    own = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), digest).otherwise(none).alias("c"))
    return own.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("c") == F.col("_c"))).select("cid", *names, "text")


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, cid) with the text of each."""

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [_digest(words_of(t)) == c for c, t in zip(batch["cid"], batch["text"], strict=True)]
            yield batch[same].drop_duplicates("cid")

    return _texts_by_id(docs, rows, []).mapInPandas(right, "cid binary, text string")


def _below(docs: DataFrame, sets: DataFrame, open_sets: DataFrame, n: int, threshold: float, levels: int) -> DataFrame:
    """(cid, below): the paths of the deeper levels of (cid, above), the sets in buckets that split; one row a set.

    A set makes 1 / threshold paths on average below each of its own, whatever the size of its bucket.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for batch in batches:
            done, rows = set(), []
            for cid, above, text in zip(batch["cid"], batch["above"], batch["text"], strict=True):
                words = words_of(text)
                if cid in done or _digest(words) != cid:
                    continue
                done.add(cid)
                grams, paths = shingle(words), np.array(above, np.int64).view(np.uint64)
                made: tuple[list, list, list] = ([], [], [])
                for level in range(2, levels + 1):
                    paths, parents = _chosen(grams, paths, level, threshold)
                    if not len(paths):
                        break
                    for column, part in zip(made, (np.full(len(paths), level), parents.astype(np.int64), paths.astype(np.int64)), strict=True):
                        column.append(part)
                if made[0]:
                    rows.append((cid, *(np.concatenate(column) for column in made)))
            if rows:
                yield pd.DataFrame(rows, columns=["cid", "levels", "parents", "paths"])

    opened = open_sets.groupBy("cid").agg(F.collect_set("path").alias("above")).join(sets.select("cid", "doc_id"), "cid")
    # the rows of one id and text come in several pieces
    made = _texts_by_id(docs, opened, ["above"]).mapInPandas(run, "cid binary, levels array<int>, parents array<long>, paths array<long>")
    return made.dropDuplicates(["cid"]).select("cid", F.arrays_zip("levels", "parents", "paths").alias("below"))


def _final_buckets(docs: DataFrame, sets: DataFrame, n: int, threshold: float, levels: int, bucket: int, block: int) -> DataFrame:
    """(cid, path, blocks): the buckets in which sets are compared, with two sets or more.

    Level by level: count the sets of each open path; buckets that are small enough, or at
    the last level, are final, the larger ones open their children.
    """
    here = sets.select("cid", F.lit(0).cast("long").alias("parent"), F.explode("paths").alias("path"))
    finals: list[DataFrame] = []
    deeper: DataFrame | None = None
    split: DataFrame | None = None
    for level in range(1, levels + 1):
        # a path has one parent: what is below a bucket that did not split goes by paths, not by their sets
        crowds = here.groupBy("path", "parent").count().where("count > 1")
        if split is not None:
            crowds = crowds.join(split.withColumnRenamed("path", "parent"), "parent", "left_semi")
        counts = stored(crowds.select("path", "count"), "counts")
        small = counts if level == levels else counts.where(F.col("count") <= bucket)
        met = here.join(small, "path").select("cid", "path", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
        finals.append(met)
        split = counts.where(F.col("count") > bucket).select("path")
        if level == levels or split.isEmpty():
            break
        if deeper is None:
            deeper = stored(_below(docs, sets, here.join(split, "path", "left_semi"), n, threshold, levels), "deeper")
        here = deeper.select("cid", F.explode(F.filter("below", lambda x: x["levels"] == level + 1)).alias("x"))
        here = here.select("cid", F.col("x.parents").alias("parent"), F.col("x.paths").alias("path"))
    out = finals[0]
    for more in finals[1:]:
        out = out.unionByName(more)
    return stored(out, "finals")


def _placed(sets: DataFrame, finals: DataFrame) -> DataFrame:
    """A row for each set and comparison (path, i, j) that it takes part in; a bucket of several
    blocks has a comparison for each pair of blocks."""
    each = finals.groupBy("cid").agg(
        F.array_sort(F.collect_set("path")).alias("finals"), F.collect_set(F.struct("path", "blocks")).alias("at")
    )
    rows = sets.select("cid", "n", "sketch").join(each, "cid").withColumn("at", F.explode("at"))
    own = F.pmod(F.xxhash64("cid"), F.col("at.blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)))
    return rows.select(
        "cid",
        "n",
        "sketch",
        "finals",
        F.col("at.path").alias("path"),
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own",
    )


class Group(NamedTuple):
    """The rows of a comparison, as parts of the arrays of a batch."""

    path: int
    i: int
    j: int
    n: np.ndarray
    own: np.ndarray
    sketch: np.ndarray
    finals: np.ndarray

    def take(self, rows: np.ndarray) -> Group:
        return self._replace(n=self.n[rows], own=self.own[rows], sketch=self.sketch[rows], finals=self.finals[rows])


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, Group]]]]:
    """Batches of a partition that is sorted by comparisons, with the comparisons that are whole in each
    and their first rows."""
    rest: pd.DataFrame | None = None
    for batch in chain(batches, [None]):
        last = batch is None
        if last or not len(batch):
            if not last or rest is None:
                continue
            batch, rest = rest, None
        elif rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        path, i, j, n, own = (batch[c].to_numpy(np.int64) for c in ("path", "i", "j", "n", "own"))
        new = (path[1:] != path[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), *([len(batch)] if last else [])]
        whole = bounds[-1]
        if not last:
            rest = batch.iloc[whole:]
        if not whole:
            continue
        sketch = np.frombuffer(b"".join(batch["sketch"].iloc[:whole]), np.uint16).reshape(whole, SKETCH)
        finals = batch["finals"].to_numpy()
        yield (
            batch,
            [
                (a, Group(int(path[a]), int(i[a]), int(j[a]), n[a:b], own[a:b], sketch[a:b], finals[a:b]))
                for a, b in zip(bounds, bounds[1:], strict=False)
            ],
        )


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many values the sketches of each pair agree."""
    if len(left) * len(right) <= 4096:
        return (left[:, None, :] == right[None, :, :]).sum(axis=2)
    agree = np.zeros((len(left), len(right)), np.uint8)
    for k in range(SKETCH):
        agree += left[:, k][:, None] == right[:, k][None, :]
    return agree


def _candidates(group: Group, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) that the sketches do not rule out and that count in this bucket."""
    m, n, own, same = len(group.n), group.n, group.own, group.i == group.j
    left = np.arange(m) if same else np.flatnonzero(own == group.i)
    right = left if same else np.flatnonzero(own == group.j)
    a, b = np.nonzero(_agreement(group.sketch[left], group.sketch[right]) >= MIN_AGREE)
    a, b = left[a], right[b]
    ok = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
    if same:
        ok &= a < b
    a, b = a[ok], b[ok]
    if not len(a):
        return a, b
    if len(a) <= 16:
        sets = {x: set(group.finals[x].tolist()) for x in {*a.tolist(), *b.tolist()}}
        ok = np.array([min(sets[x] & sets[y]) == group.path for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        return a[ok], b[ok]
    width = max(map(len, group.finals))
    finals = np.full((m, width), np.iinfo(np.int64).max)
    for row, f in enumerate(group.finals):
        finals[row, : len(f)] = f
    first = np.empty(len(a), np.int64)
    for c in range(0, len(a), 65536):
        part = slice(c, c + 65536)
        fa, fb = finals[a[part]], finals[b[part]]
        common = np.full(len(fa), np.iinfo(np.int64).max)
        for k in range(width):
            shared = (fb == fa[:, k : k + 1]).any(axis=1)
            common = np.where(shared, np.minimum(common, fa[:, k]), common)
        first[part] = common
    ok = first == group.path
    return a[ok], b[ok]


def _shared(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs."""
    used, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) <= 4 * len(used):
        return np.array([len(np.intersect1d(grams[x], grams[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
    row = np.repeat(np.arange(len(used)), [len(grams[u]) for u in used])
    token, column, count = np.unique(np.concatenate([grams[u] for u in used]), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    new = np.cumsum(count > 1) - 1
    row, column = row[keep], new[column[keep]]
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        lo, hi = np.searchsorted(column, [c, c + 8192])
        part = np.zeros((len(used), 8192), np.float32)
        part[row[lo:hi], column[lo:hi] - c] = 1
        total += part @ part.T
    return total[inverse[: len(a)], inverse[len(a) :]].astype(np.int64)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number of each row's component."""
    root = np.arange(size)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _by_comparison(rows: DataFrame) -> DataFrame:
    return rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")


def links(docs: DataFrame, sets: DataFrame, placed: DataFrame, *, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, root, links) parts: links of a set in one comparison, and the set it hangs on there."""
    row = "cid binary, n int, sketch binary, finals array<long>, path long, i int, j int, own int"

    def active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, groups in _groups(batches):
            pairs = ((at, *_candidates(group, threshold)) for at, group in groups)
            kept = [at + np.unique(np.concatenate([a, b])) for at, a, b in pairs if len(a)]
            if kept:
                yield batch.iloc[np.concatenate(kept)]

    found = stored(_by_comparison(placed).mapInPandas(active, row), "active")
    # texts are fetched only for sets that have a candidate; a text may come from several rows
    one = sets.select("cid", "doc_id").join(found.select("cid").distinct(), "cid", "left_semi")
    texts = _with_text(docs, one)
    whole = found.join(texts, "cid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for batch, groups in _groups(batches):
            cids, texts = batch["cid"].to_numpy(), batch["text"].to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at, group in groups:
                own = at + np.sort(np.unique(cids[at : at + len(group.n)], return_index=True)[1])
                group = group.take(own - at)
                a, b = _candidates(group, threshold)
                if not len(a):
                    continue
                grams = [shingle(words_of(t)) for t in texts[own]]
                size = np.array([len(g) for g in grams])
                both = _shared(grams, a, b)
                ok = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[ok], b[ok]
                counted = np.bincount(np.concatenate([a, b]), minlength=len(own))
                met = np.flatnonzero(counted)
                out.append((cids[own[met]], cids[own[_roots(len(own), a, b)[met]]], counted[met]))
            if out:
                cid, root, linked = (np.concatenate(column) for column in zip(*out, strict=True))
                yield pd.DataFrame({"cid": cid, "root": root, "links": linked})

    return _by_comparison(whole).mapInPandas(compare, "cid binary, root binary, links long")


def _joined(
    docs: DataFrame,
    *,
    n: int = N,
    threshold: float = THRESHOLD,
    runs: int | None = None,
    levels: int = LEVELS,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """What `join_similar` returns, with the hash of each row's text and the class's own name for it (null: no words)."""
    signed = stored(signatures(docs, n=n, threshold=threshold, runs=runs, levels=levels), "signatures")
    texts = signed.where("cid IS NOT NULL")
    sets = texts.groupBy("cid").agg(
        F.min("doc_id").alias("doc_id"),
        F.count("*").alias("n_copies"),
        F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
        F.first("paths").alias("paths"),
    )
    sets = stored(sets, "sets")
    placed = _placed(sets, _final_buckets(docs, sets, n, threshold, levels, bucket, block))
    parts = stored(links(docs, sets, placed, n=n, threshold=threshold), "links")
    counted = parts.groupBy("cid").agg(F.sum("links").alias("n_links"))
    roots = components(parts.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = sets.select("cid", "doc_id", "n_copies").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "cid")), "named")
    classes = stored(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "classes")
    facts = named.join(classes, "root").join(counted, "cid", "left")
    facts = stored(facts.select("cid", "root", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "facts")
    return signed.select("doc_id", "h", "cid").join(facts, "cid", "left").select(
        "doc_id",
        "h",
        "root",
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def join_similar(
    docs: DataFrame,
    *,
    n: int = N,
    threshold: float = THRESHOLD,
    runs: int | None = None,
    levels: int = LEVELS,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, text) -> doc_id, class_id, n_links, n_copies, one row per input row.

    `n_links` counts the different texts of similarity `threshold` or more, `n_copies` the
    rows with the same text, the row itself included.
    """
    joined = _joined(docs, n=n, threshold=threshold, runs=runs, levels=levels, bucket=bucket, block=block)
    return joined.select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that with the smallest id (nulls last; of several texts of that id the one
    of the smallest hash); a repeated row is kept once, and one without words stays."""
    # the table may be read again in other pieces, so rows are named by their id and the hash of their text
    rows = _joined(docs, **options).where("root IS NOT NULL").groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    rows = stored(rows, "rows")
    named = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    firsts = stored(rows.groupBy("root").agg(F.min(named).alias("first")), "firsts")
    ids = rows.join(firsts, "root").withColumn("own", named == F.col("first"))
    # the rows that go are the fewer ones, and texts stay where they are: the side that is broadcast has ids and hashes alone
    gone = small_side(ids.where("NOT own").select(F.col("doc_id").alias("__gone_id"), F.col("h").alias("__gone_h")))
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (F.xxhash64("text") == F.col("__gone_h")), "left_anti")
    if rows.where("n > 1").isEmpty():
        return kept
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.where(worded).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(F.coalesce(~worded, F.lit(True))))
