"""Importance resampling towards a target distribution.

A text's features are its runs of 1 to `n` words; each falls in one of `buckets` by its CRC-32.
Features are counted over all documents and over all target texts, a bucket's gain is the
smoothed log ratio of the two, and a document's weight is the floored mean of its features'
gains.  Gumbel noise from a hash of the id turns the draw without replacement into a
selection of the highest scores.

The gains are one array of `buckets` numbers, the only thing that goes to every task;
documents are scored in place and their texts are never shuffled.  The cut is found by
distributed quickselect over the narrow scores: a round draws random pivot keys, one
aggregation counts the rows before, at and after each of them exactly, and the rows between
the two pivots around the wanted place are the next round's table.  Keys are composite
(score, id, row number), so they are unique and ties fall as stated.  Only the winners are
sorted and ranked.

Defined cases: a null or empty text has no features and weight 0; a document without id
hashes as the seed and an empty id and comes after all others among equal scores; rows that repeat an
id take part one by one, equal ones in the order of their row numbers; an empty target or an empty
table gives smoothed gains or no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import dense_position
from .common import let, stored

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
PIVOTS = 15
#: An interval of at most so many keys is read in order instead of being divided again.
SMALL = 2_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that is no letter or digit of ASCII and no character beyond it.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ("_down", "_last", "_id", "_row")


def feature_words(text: Column) -> Column:
    """Words in lower case (A-Z only): runs of ASCII letters and digits and of what is beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART), "")


def features(text: Column, n: int = 1) -> Column:
    """All runs of 1 to `n` consecutive words, joined by one space."""
    if n == 1:
        return feature_words(text)

    def of(words: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
        found = F.when(F.size(words) >= k, F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " ")))
        return F.coalesce(found, F.array().cast("array<string>"))

    def runs(words: Column) -> Column:
        return F.concat(*[of(words, k) for k in range(1, n + 1)])

    return let(feature_words(text), runs)


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket over all rows of `text`; at most `buckets` rows come back."""
    each = texts.select(F.explode(features(F.col("text"), n)).alias("f"))
    return {r[0]: r[1] for r in each.groupBy(bucket(F.col("f"), buckets)).count().collect()}


def gain_array(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> Column:
    """The gain of each bucket in thousandths, as one constant array."""
    counts = {}
    for side, texts in (("s", docs), ("t", target)):
        each = bucket_counts(texts, n, buckets)
        counts[side] = ([each.get(i, 0) for i in range(buckets)], sum(each.values()))
    (s, all_s), (t, all_t) = counts["s"], counts["t"]
    gains = [
        math.floor(1000.0 * math.log(float(t[i] + 1) * float(all_s + buckets) / (float(s[i] + 1) * float(all_t + buckets))))
        for i in range(buckets)
    ]
    # one text that the optimizer folds into one array, not `buckets` expressions
    return F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")


def floor_div(a: Column, b: Column) -> Column:
    """Whole division that goes down, without a detour by doubles."""
    return F.when(b != 0, ((a - F.pmod(a, b)) / b).cast("long"))


def score_documents(docs: DataFrame, gains: Column, n: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of each row."""

    def measured(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0).cast("long"), lambda acc, f: acc + F.get(gains, bucket(f, buckets)))
        return F.struct(F.size(found).cast("long").alias("n_features"), total.alias("total"))

    rows = docs.select("doc_id", let(features(F.col("text"), n), measured).alias("m"))
    count, total = F.col("m.n_features"), F.col("m.total")
    rows = rows.select("doc_id", count.alias("n_features"), F.coalesce(floor_div(total, count), F.lit(0).cast("long")).alias("weight"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + gumbel)


def _key(*values: int) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(name) for name, v in zip(KEY, values, strict=True)])


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, small: int = SMALL) -> tuple[int, ...] | None:
    """The k-th smallest of the unique composite keys in the columns `KEY` (1 the smallest).

    A round costs one aggregation over what is left, which shrinks about `pivots` times; at
    most `pivots` keys, counts or (in the last round) `small` keys reach the driver.
    """
    names, left, place, n = list(KEY), rows.select(*KEY), k, rows.count()
    if not 1 <= k <= n:
        return None
    while n > small:
        salt = uuid.uuid4().int & 0x7FFFFFFF
        drawn = left.orderBy(F.xxhash64(*names, F.lit(salt)), *names).limit(pivots)
        keys = sorted(tuple(r) for r in drawn.collect())
        key = F.struct(*names)
        counts = left.agg(
            *[F.count(F.when(key < _key(*p), 1)).alias(f"b{i}") for i, p in enumerate(keys)],
            *[F.count(F.when(key == _key(*p), 1)).alias(f"e{i}") for i, p in enumerate(keys)],
        ).first()
        low, high, before = None, None, 0
        for i, p in enumerate(keys):
            if counts[f"b{i}"] >= place:
                high, n = p, counts[f"b{i}"]
                break
            if counts[f"b{i}"] + counts[f"e{i}"] >= place:
                return p
            low, before = p, counts[f"b{i}"] + counts[f"e{i}"]
        inside = F.lit(True)
        if low is not None:
            inside &= key > _key(*low)
        if high is not None:
            inside &= key < _key(*high)
        left, place, n = stored(left.where(inside), "interval"), place - before, n - before
    return tuple(left.orderBy(*names).offset(place - 1).first())


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    n: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: float = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs` (doc_id, text); rank is
    null where the row is not drawn.  Of the rows with `min_words` words or more, the share `percent`
    (rounded down) is drawn: the highest scores, ties to the smaller id."""
    gains = gain_array(docs, target, n, buckets)
    scored = score_documents(docs, gains, n, buckets, seed)
    # the features of `min_words` words; every word more adds some
    least = sum(max(0, min_words - k + 1) for k in range(1, n + 1))
    key = [
        (-F.col("score")).alias("_down"),
        F.col("doc_id").isNull().cast("long").alias("_last"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    ]
    scored = stored(scored.select("*", *key, (F.col("n_features") >= least).alias("_able")), "scored")
    able = scored.where("_able")
    cut = kth_key(able, math.floor(percent * able.count() / 100))
    names = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    won = F.col("_able") & (F.struct(*KEY) <= _key(*cut))
    winners = dense_position(scored.where(won), *KEY, name="rank").select(*names, F.col("rank").cast("long"))
    return winners.unionByName(scored.where(~won).select(*names, F.lit(None).cast("long").alias("rank")))
