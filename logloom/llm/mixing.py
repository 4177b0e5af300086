"""Mixing sources to target weights along a time-varying curriculum.

Every source has a demand (its target) and a schedule: a weight that changes in a
straight line over the training time 0..1.  The integral of the schedule is the
cumulative demand in words.  The documents of a source, in a fixed random order and
epoch after epoch, fill that demand; a document stands where the cumulative demand
reaches the middle of its words.  Inverting the integral there gives its position.

Defined cases: a null text has size 0; a null source is a source of its own, the last;
documents of size 0 are never taken; equal rows are told apart by nothing and so share
their places in any order; an empty table gives an empty result; columns of the input
other than those named are ignored by `assign` and kept by `curriculum`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .common import HASH_BITS, hash60, stored, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Change of a source's weight over the training, by its place in `WEIGHTS`: the schedule
#: is 1 - slope at the start and 1 + slope at the end, as a multiple of its mean.
SLOPES = (0.5, 0.0, -0.5)
SLICE_ROWS = 1 << 10
#: Text of a bucket of the training time, about (a partition of the curriculum), and the most of them.
BUCKET_BYTES = 8 << 20
MAX_BUCKETS = 1 << 12


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with place, weight and target.

    The targets share the sum of all sizes by weight.  A target above `max_epochs` times
    its source's size stops there and the excess is shared anew.  The fixed point of that
    is one water level: target = min(cap, level * weight).  Sources sorted by cap / weight
    fill up in this order, so the level follows from one running sum.  One row per
    source: the ordered windows are over that small table alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    placed = sizes.withColumn("place", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).withColumn(
        "weight", F.get(table, F.col("place"))
    )
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    filled = (
        placed.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("below", F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_weight", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce("below", F.lit(0))) / F.col("open_weight"))
        # the first source that the level does not fill has the right one; later ones count too much as full
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("level", F.max("fits").over(every))
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return filled.select("source", "place", "weight", "source_size", target.alias("target"))


def _position(demand: Column, target: Column, slope: Column) -> Column:
    """The time at which target * (t + slope * (t*t - t)) reaches `demand`."""
    share = demand / target
    straight = 1.0 - slope
    root = F.sqrt(straight * straight + 4.0 * slope * share)
    return F.least(F.lit(1.0), 2.0 * share / (straight + root))


def _slope(slopes: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(float(s)) for s in slopes]), F.col("place"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("order"), *more
    )


def _placed(sized: DataFrame, slopes: Sequence[float], weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Add source_size, target and positions (one for each epoch that takes the row).

    A hot source is cut in slices of the random order.  Only sums of slices pass the
    ordered window of a source, and rows meet their own slice only.
    """
    rows = sized.count()
    bits = max(0, math.ceil(math.log2(max(1, rows) / SLICE_ROWS)))
    sized = sized.withColumn("slice", F.shiftright("order", HASH_BITS - bits) if bits else F.lit(0).cast("long"))
    slices = stored(sized.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    goals = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    g = goals.withColumnRenamed("source", "g_source")
    starts = stored(
        starts.join(g, F.col("source").eqNullSafe(F.col("g_source"))).select(
            F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "start", "place", "source_size", "target"
        ),
        "starts",
    )
    same = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))
    inside = (
        Window.partitionBy("source", "slice")
        .orderBy("order", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, same)
    middle = F.col("start") + F.col("inside") + F.col("size") / 2.0
    epochs = F.array(*[F.lit(k) for k in range(max_epochs)])
    demands = F.filter(
        F.transform(epochs, lambda k: middle + k * F.col("source_size")),
        lambda d: (F.col("size") > 0) & (d < F.col("target")),
    )
    return placed.withColumn("demands", demands).withColumn(
        "positions", F.transform("demands", lambda d: _position(d, F.col("target"), _slope(slopes)))
    )


def assign(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(doc_id, source, text) -> doc_id, source, size, source_size, target, positions, taken.

    `positions` has the training time of each repeat; `taken` the words of all repeats.
    The last document of a source is taken if its middle lies within the demand, so the
    words taken differ from the target by half a document at most.  One shuffle of narrow
    rows; texts are read once and never shuffled.
    """
    sized = stored(_sized(docs), "sizes")
    return _placed(sized, slopes, weights, max_epochs).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "positions",
        (F.col("size") * F.size("positions")).alias("taken"),
        "order",
    )


def _dealt(docs: DataFrame, weights: Sequence[int], slopes: Sequence[float], max_epochs: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The rows of the mix with their bucket of the training time, before any shuffle, and the number of buckets.

    Positions rise with the random order of a source.  So a cell, the rows that one slice of this order sends to one
    bucket in one epoch, is an interval of it, and a text that looks up the cells of its slice knows where it goes.
    Texts whose order occurs again (equal rows, as a rule) cannot be told from each other by it: they meet the drawn rows.
    """
    sized = stored(_sized(docs, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "sizes")
    total = sized.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    buckets = min(MAX_BUCKETS, max(1, math.ceil(total / bucket_bytes)))
    shift = HASH_BITS - math.ceil(math.log2(buckets))
    placed = _placed(sized, slopes, weights, max_epochs)
    drawn = placed.select(
        "doc_id",
        "source",
        "order",
        "size",
        "target",
        _slope(slopes).alias("slope"),
        F.posexplode(F.arrays_zip("demands", "positions")).alias("epoch", "met"),
    )
    bucket = F.least(F.lit(buckets - 1), F.floor(F.col("met.positions") * buckets)).cast("int")
    before = F.col("met.demands") - F.col("size") / 2.0
    drawn = drawn.select("doc_id", "source", "order", "size", "target", "slope", "epoch", bucket.alias("bucket"), before.alias("before"))
    drawn = stored(drawn.withColumn("part", F.shiftright("order", shift)), "drawn")
    cells = drawn.groupBy("source", "part", "epoch", "bucket").agg(
        F.min("order").alias("lo"), F.max("order").alias("hi"), F.min("before").alias("before"), F.first("target").alias("target"), F.first("slope").alias("slope")
    )
    cells = stored(cells, "cells")
    facts = ["epoch", "bucket", "before", "target", "slope"]
    listed = small_side(
        cells.groupBy(F.col("source").alias("__mix_source"), F.col("part").alias("__mix_part")).agg(
            F.collect_list(F.struct("lo", "hi", *facts)).alias("__mix_cells")
        )
    )
    named = [F.col(f"__mix_cell.{f}").alias(f"__mix_{f}") for f in facts]
    # a text without a word is never taken, wherever its order lies
    held = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("__mix_order", hash60(F.col("doc_id"), F.col("text")))
    repeated = stored(sized.groupBy("order").count().where("count > 1").select(F.col("order").alias("__mix_again")), "repeated")
    several = not repeated.isEmpty()
    if several:
        repeated = small_side(repeated)
        again = held.join(repeated, F.col("__mix_order") == F.col("__mix_again"), "left_semi")
        held = held.join(repeated, F.col("__mix_order") == F.col("__mix_again"), "left_anti")
    here = F.col("source").eqNullSafe(F.col("__mix_source")) & (F.shiftright("__mix_order", shift) == F.col("__mix_part"))
    mine = F.filter("__mix_cells", lambda c: F.col("__mix_order").between(c["lo"], c["hi"]))
    out = held.join(listed, here).withColumn("__mix_cell", F.explode(mine))
    size = F.size(words(F.col("text"))).cast("long").alias("__mix_size")
    out = out.select(*docs.columns, "__mix_order", "__mix_source", "__mix_part", size, *named)
    if several:
        # of equal rows one brings the text; as many come out as were drawn
        keys = ["source", "part", "epoch", "bucket"]
        hot = drawn.drop("before", "target", "slope").join(repeated, F.col("order") == F.col("__mix_again"), "left_semi")
        k = cells.select(*[F.col(c).alias(f"k_{c}") for c in keys], "before", "target", "slope")
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in keys])
        hot = hot.join(k, same).select(
            F.col("doc_id").alias("__mix_id"), F.col("order").alias("__mix_key"), *[F.col(c).alias(f"__mix_{c}") for c in ("source", "part", "size", *facts)]
        )
        again = again.dropDuplicates(["doc_id", "__mix_order"])
        again = again.join(hot, F.col("__mix_id").eqNullSafe(F.col("doc_id")) & (F.col("__mix_key") == F.col("__mix_order")))
        out = out.unionByName(again.drop("__mix_id", "__mix_key"))
    return out, buckets


def curriculum(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    max_epochs: int = MAX_EPOCHS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The documents in training order: one row per repeat, in partitions of consecutive positions, each sorted by them.

    Texts are shuffled once, straight to their bucket of the training time.  There the demand before each row of a cell is the
    cell's own and the sizes of its rows up to it, as in `assign`.  Rows are told apart by id and 60-bit hash of id and text, so
    repeated ids with different texts keep apart; equal rows come out as often as the mix takes them.
    """
    dealt, buckets = _dealt(docs, weights, slopes, max_epochs, bucket_bytes)
    inside = (
        Window.partitionBy("__mix_bucket", "__mix_source", "__mix_part", "__mix_epoch")
        .orderBy("__mix_order", F.col("doc_id").asc_nulls_last(), "__mix_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    met = dealt.repartitionById(buckets, "__mix_bucket")
    demand = F.col("__mix_before") + F.coalesce(F.sum("__mix_size").over(inside), F.lit(0)) + F.col("__mix_size") / 2.0
    met = met.withColumn("__mix_position", _position(demand, F.col("__mix_target"), F.col("__mix_slope")))
    return met.sortWithinPartitions("__mix_position", "__mix_order").select(*docs.columns)
