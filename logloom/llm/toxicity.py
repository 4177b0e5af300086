"""Toxicity by nearest labelled examples.

The examples are a bounded sample of labelled documents.  Their vectors are TF-IDF over the
terms that set the classes apart in the sample; document frequencies are counted over all
documents.  A text gets its nearest examples by exact cosine: examples stand in blocks, an
inverted index holds for each term the largest weight in each block, and only blocks whose
bound reaches the k-th best cosine are computed.  Votes weighted by nearness are calibrated
on the examples, each left out in turn.

Bounds (parameters): `per_class` examples of each class, `n_terms` terms.  The index has at
most 2 * per_class rows and n_terms * blocks bounds, whatever the size of the corpus, so it
may go to every task.

Defined cases: a null or empty text, or one without any known term, has the zero vector and
gets the calibrated rate of such examples; rows with equal texts get equal scores; a label
row that repeats an id counts once (toxic if any says so); a null label or id is not
an example; labels of one class only, or none, give every text the smoothed base rate; other
columns, lang and source are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash60, stored

PER_CLASS = 2048
N_TERMS = 1024
MIN_DF = 3
#: A term takes part from this likelihood ratio on: chance gives more to one in a thousand.
MIN_G2 = 10.83
BLOCK = 64
NEIGHBOURS = 15
THRESHOLD = 0.7
#: A word, or one character of a script that is written without spaces.
TERM = re.compile(r"[฀-໿぀-ヿ㐀-鿿]|[^\W\d_]+")
PREFIX = 5


def terms(text: str | None) -> list[str]:
    """The terms of a text: its lower-case words and the beginnings of longer ones."""
    found = TERM.findall((text or "").lower())
    return found + [w[:PREFIX] + "*" for w in found if len(w) > PREFIX]


class Known:
    """Counts the known terms of texts; remembers what a run without white space stands for,
    up to a bound, so that most are looked up once."""

    REMEMBERED = 200_000

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.words: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        words = self.words
        for word, n in Counter((text or "").split()).items():
            ids = words.get(word)
            if ids is None:
                ids = tuple(self.vocabulary[t] for t in terms(word) if t in self.vocabulary)
                if len(words) >= self.REMEMBERED:
                    words.clear()
                words[word] = ids
            for i in ids:
                out[i] = out.get(i, 0) + n
        return out


@dataclass
class Index:
    """Examples as rows (CSR), and the largest weight of each term in each block of rows."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    toxic: np.ndarray
    doc_ids: np.ndarray
    bounds: np.ndarray
    prior: float
    curve: tuple[np.ndarray, np.ndarray]
    zero_score: float

    def search(self, columns: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of positive cosine (row numbers, cosines), exact; ties by row.
        `without`: a row left out."""
        reach = weights @ self.bounds[columns]
        order = np.argsort(-reach, kind="stable")
        order = order[reach[order] > 0]
        dense = np.zeros(len(self.idf))
        dense[columns] = weights
        rows, scores = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 2
        while at < len(order):
            if len(scores) >= k and reach[order[at]] < scores[k - 1] - 1e-9:
                break
            blocks = order[at : at + step]
            if len(scores) >= k:
                blocks = blocks[reach[blocks] >= scores[k - 1] - 1e-9]
            more = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            more = more[more < len(self.toxic)]
            more = more[more != without]
            rows = np.concatenate([rows, more])
            scores = np.concatenate([scores, self._cosines(more, dense)])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            at, step = at + step, step * 2
        near = scores > 0
        return rows[near], scores[near]

    def _cosines(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        lengths = self.starts[rows + 1] - self.starts[rows]
        total = int(lengths.sum())
        if not total:
            return np.zeros(len(rows))
        offsets = np.cumsum(lengths) - lengths
        flat = np.arange(total) - np.repeat(offsets, lengths) + np.repeat(self.starts[rows], lengths)
        parts = dense[self.columns[flat]] * self.weights[flat]
        sums = np.concatenate([[0.0], np.cumsum(parts)])
        return sums[offsets + lengths] - sums[offsets]

    def vote(self, columns: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        rows, scores = self.search(columns, weights, k, without)
        nearness = 1.0 / (1.05 - np.minimum(scores, 1.0))
        share = (float(nearness @ self.toxic[rows]) + self.prior) / (float(nearness.sum()) + 1.0)
        return share, rows, scores

    def calibrated(self, share: float) -> float:
        return float(np.interp(share, *self.curve)) if len(self.curve[0]) else self.prior


def _unit(counted: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns = np.fromiter(sorted(counted), np.int64, len(counted))
    weights = np.array([1 + math.log(counted[c]) for c in columns.tolist()]) * idf[columns]
    norm = math.sqrt(float(weights @ weights))
    return columns, weights / norm if norm else weights


def _rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means of y that never fall with x (pooled adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _examples(docs: DataFrame, labels: DataFrame, held_out_mod: int | None, per_class: int) -> DataFrame:
    """At most `per_class` labelled texts of each class, the smallest by a hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if held_out_mod is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != held_out_mod)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == c).orderBy(hash60(F.col("doc_id")), "doc_id").limit(per_class) for c in (0, 1)]
    sample = stored(picked[0].unionByName(picked[1]), "sample")
    # the sample has 2 * per_class rows at most
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return stored(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "examples")


def _vocabulary(examples: DataFrame, totals: dict[int, int], n_terms: int) -> list[str]:
    """The terms whose presence depends most on the class (likelihood ratio),
    as far as chance does not explain it."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(t, toxic) for text, toxic in zip(batch["text"], batch["toxic"], strict=True) for t in sorted(set(terms(text)))]
            yield pd.DataFrame(found, columns=["term", "toxic"])

    counted = examples.select("text", "toxic").mapInPandas(distinct, "term string, toxic int")
    counted = counted.groupBy("term").agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    n, t = float(sum(totals.values())), float(totals.get(1, 0))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    a, b = F.col("t"), F.col("n") - F.col("t")
    c, d = F.lit(t) - a, F.lit(n - t) - b
    rate = F.lit(t / n)
    g2 = 2 * (
        part(a, F.col("n") * rate)
        + part(b, F.col("n") * (1 - rate))
        + part(c, (F.lit(n) - F.col("n")) * rate)
        + part(d, (F.lit(n) - F.col("n")) * (1 - rate))
    )
    top = counted.where(F.col("n") >= MIN_DF).withColumn("g2", F.round(g2, 6))
    top = top.where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "term").limit(n_terms)
    return [r["term"] for r in top.collect()]


def _document_counts(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(len(shared.value) + 1, np.int64)
        known = Known(shared.value)
        for batch in batches:
            for text in batch["text"]:
                seen[list(known.counts(text))] += 1
                seen[-1] += 1
        yield pd.DataFrame({"term": np.arange(len(seen)), "n": seen})

    sums = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for row in sums.collect():  # one row per term of the bounded vocabulary
        out[row["term"]] = row["n"]
    return out[:-1], int(out[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    held_out_mod: int | None = 1,
    per_class: int = PER_CLASS,
    n_terms: int = N_TERMS,
    k: int = NEIGHBOURS,
) -> Index:
    """Build the index.  Labels of rows whose crc32(doc_id) mod 3 is `held_out_mod` are not used."""
    examples = _examples(docs, labels, held_out_mod, per_class)
    totals = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if held_out_mod is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != held_out_mod)
    rates = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = (rates.get(1, 0) + 1) / (rates.get(0, 0) + rates.get(1, 0) + 2)
    words = _vocabulary(examples, totals, n_terms) if len(totals) == 2 else []
    vocabulary = {w: i for i, w in enumerate(words)}
    seen, n_docs = _document_counts(docs, vocabulary) if words else (np.zeros(0), 0)
    idf = np.log((1 + n_docs) / (1 + seen)) + 1
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, idf))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_terms, weights = Known(shared.value[0]), shared.value[1]
        for batch in batches:
            made = [_unit(known_terms.counts(x), weights) for x in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "c": [m[0] for m in made], "w": [m[1] for m in made]}
            )

    rows = examples.mapInPandas(vectors, "doc_id long, toxic int, c array<long>, w array<double>").collect() if words else []
    # rows of a block share their strongest term, so that bounds are tight
    rows.sort(key=lambda r: (r["c"][int(np.argmax(r["w"]))] if r["c"] else -1, r["doc_id"]))
    starts = np.concatenate([[0], np.cumsum([len(r["c"]) for r in rows])]).astype(np.int64)
    columns = np.array([c for r in rows for c in r["c"]], np.int64)
    weights = np.array([w for r in rows for w in r["w"]], np.float64)
    toxic = np.array([r["toxic"] for r in rows], np.float64)
    bounds = np.zeros((len(words), len(rows) // BLOCK + 1))
    owner = np.repeat(np.arange(len(rows)), np.diff(starts)) // BLOCK
    np.maximum.at(bounds, (columns, owner), weights)
    index = Index(
        vocabulary, idf, starts, columns, weights, toxic, np.array([r["doc_id"] for r in rows]), bounds, prior, (np.empty(0), np.empty(0)), prior
    )
    if not rows:
        return index
    # classes count as often as in all labels, not as in the sample
    per = np.where(toxic > 0, rates.get(1, 0) / max(1, totals.get(1, 0)), rates.get(0, 0) / max(1, totals.get(0, 0)))
    empty = np.diff(starts) == 0
    if empty.any():
        index.zero_score = (float(per[empty] @ toxic[empty]) + prior) / (float(per[empty].sum()) + 1)
    full = np.flatnonzero(~empty)
    if len(full):
        shares = np.array([index.vote(columns[starts[i] : starts[i + 1]], weights[starts[i] : starts[i + 1]], k, i)[0] for i in full])
        index.curve = _rising(shares, toxic[full], per[full])
    return index


def _scorer(index: Index, k: int):
    """A column function of the text: score and evidence."""
    ix = index  # goes to the tasks with the function; Spark broadcasts large ones

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known(ix.vocabulary)
        for texts in batches:
            scores, evidence = [], []
            for text in texts:
                columns, weights = _unit(known.counts(text), ix.idf)
                if not len(columns):
                    scores.append(ix.zero_score)
                    evidence.append([])
                    continue
                share, rows, cosines = ix.vote(columns, weights, k)
                scores.append(ix.calibrated(share))
                evidence.append(
                    [
                        {"doc_id": int(ix.doc_ids[r]), "toxic": int(ix.toxic[r]), "cosine": float(c)}
                        for r, c in zip(rows[:3], cosines[:3], strict=True)
                    ]
                )
            yield pd.DataFrame({"score": scores, "evidence": evidence})

    return F.pandas_udf(run, "score double, evidence array<struct<doc_id: long, toxic: int, cosine: double>>")


def score(docs: DataFrame, index: Index, *, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, score, predicted and evidence (nearest examples: id, toxic, cosine)."""
    scored = docs.select("doc_id", _scorer(index, k)("text").alias("s"))
    predicted = (F.col("s.score") >= threshold).cast("int")
    return scored.select("doc_id", F.col("s.score").alias("score"), predicted.alias("predicted"), F.col("s.evidence").alias("evidence"))


def reject(docs: DataFrame, index: Index, *, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return docs.where(_scorer(index, k)("text")["score"] < threshold)
