"""Sharding by extendible hashing.

The directory is indexed by leading bits of a 60-bit hash.  It starts with one bucket;
only a bucket above the byte limit splits on its next bit, until every shard fits.

Defined cases: a null text has 0 bytes; rows are hashed by id and text, so repeated ids
spread; rows that are equal throughout cannot be split by any bit: if they outgrow a
shard together, they are cut in pieces by a running sum; a row above the limit is a shard
of its own; an empty table has no shard; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import dense_position, running
from .common import HASH_BITS, hash60, stored

LIMIT_BYTES = 1 << 20
STEP_BITS = 8
CELL_BITS = 12
BROADCAST_LEAVES = 1 << 16


def _prefix(bits: Column, depth: Column | int) -> Column:
    """The leading `depth` bits."""
    shift = F.lit(HASH_BITS) - depth if isinstance(depth, Column) else F.lit(HASH_BITS - depth)
    return F.call_function("shiftright", bits, shift.cast("int"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__bits", hash60(F.col("doc_id"), F.col("text"))).withColumn(
        "__bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    )


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(_bits, _bytes) -> the leaves: depth, prefix, shard_bytes, shard_rows.

    Each round adds up the rows of the oversized buckets by `STEP_BITS` more bits, in one
    aggregation with map-side combine, and reads off all the splits in between.  A bucket
    that fits is never looked at again.
    """
    spark = rows.sparkSession
    weighed = stored(rows.groupBy("__bits").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n"), F.max("__bytes").alias("m")), "weighed")
    leaves: list[DataFrame] = []
    open_rows, depth = weighed, 0
    whole = weighed.agg(F.sum("b").alias("b"), F.sum("n").alias("n")).first()
    if whole["n"] is None:
        return spark.createDataFrame([], "depth int, prefix long, shard_bytes long, shard_rows long")
    if whole["b"] <= limit:
        return spark.createDataFrame([(0, 0, whole["b"], whole["n"])], "depth int, prefix long, shard_bytes long, shard_rows long")
    while True:
        deepest = min(HASH_BITS, depth + STEP_BITS)
        fine = open_rows.groupBy(_prefix(F.col("__bits"), deepest).alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fine = stored(fine, "fine")
        levels = F.array(*[F.struct(F.lit(d).alias("depth"), F.call_function("shiftright", F.col("p"), F.lit(deepest - d)).alias("prefix")) for d in range(depth, deepest + 1)])
        sums = (
            fine.select("p", "b", "n", F.explode(levels).alias("at"))
            .groupBy("at.depth", "at.prefix")
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        )
        sums = stored(sums, "sums")
        above = sums.where(F.col("shard_bytes") > limit).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        )
        last = deepest == HASH_BITS
        fits = (F.col("shard_bytes") <= limit) | (F.lit(last) & (F.col("depth") == deepest))
        leaves.append(sums.where(fits).join(above, ["depth", "prefix"], "left_semi"))
        too_large = sums.where((F.col("depth") == deepest) & (F.col("shard_bytes") > limit))
        if last or too_large.isEmpty():
            break
        at = _prefix(F.col("__bits"), deepest)
        open_rows = stored(open_rows.join(too_large.select(F.col("prefix").alias("_p")), at == F.col("_p"), "left_semi"), "open")
        depth = deepest
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    return stored(found.select(F.col("depth").cast("int"), "prefix", "shard_bytes", "shard_rows"), "leaves")


def _cells(leaves: DataFrame) -> DataFrame:
    """The directory by its first `CELL_BITS` bits: a cell lists the leaves below it, or
    the one above; a row looks up one cell and tests that short list."""
    shallow = leaves.where(F.col("depth") <= CELL_BITS).withColumn(
        "span", F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(CELL_BITS) - F.col("depth")).cast("int"))
    )
    shallow = shallow.select("depth", "prefix", "shard_bytes", F.explode(F.sequence(F.col("prefix") * F.col("span"), (F.col("prefix") + 1) * F.col("span") - 1)).alias("__cell"))
    deep = leaves.where(F.col("depth") > CELL_BITS).select(
        "depth", "prefix", "shard_bytes", F.call_function("shiftright", F.col("prefix"), (F.col("depth") - CELL_BITS).cast("int")).alias("__cell")
    )
    return shallow.unionByName(deep).groupBy("__cell").agg(F.collect_list(F.struct("depth", "prefix", "shard_bytes")).alias("__leaves"))


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Add `shard` (depth-prefix, and -piece where equal rows were cut), `shard_depth` and
    `shard_bytes` (of the bucket) to (doc_id, text, ...).

    The rows are not shuffled: the directory has a row for each of its cells at most, is
    counted, and is broadcast up to `BROADCAST_LEAVES` leaves; beyond, Spark joins by
    shuffle on the evenly spread cell number.
    """
    sized = _sized(docs)
    leaves = directory(sized.select("__bits", "__bytes"), limit)
    cells = stored(_cells(leaves), "cells")
    small = leaves.count() <= BROADCAST_LEAVES
    cell = _prefix(F.col("__bits"), CELL_BITS)
    met = sized.join(F.broadcast(cells) if small else cells, cell == F.col("__cell"))
    leaf = F.get(F.filter("__leaves", lambda x: _prefix(F.col("__bits"), x["depth"]) == x["prefix"]), F.lit(0))
    met = met.withColumn("__leaf", leaf)
    stuck = leaves.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1))
    name = F.concat_ws("-", F.col("__leaf.depth"), F.col("__leaf.prefix"))
    out = [F.col("__leaf.depth").alias("shard_depth"), F.col("__leaf.shard_bytes").alias("shard_bytes")]
    if stuck.isEmpty():
        return met.select(*[F.col(c) for c in docs.columns], name.alias("shard"), *out)
    many = (F.col("__leaf.depth") == HASH_BITS) & (F.col("__leaf.shard_bytes") > limit)
    rest = met.where(~many).select(*[F.col(c) for c in docs.columns], name.alias("shard"), *out)
    cut = dense_position(met.where(many).drop("__leaves", "__cell"), "__bits", name="__at")
    cut = running(cut, "__at", keys=["__bits"], sums={"__upto": F.col("__bytes")})
    # rows of one hash have one size, so this many fit in a piece
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("__bytes"))))
    piece = F.floor((F.col("__upto") / F.greatest(F.lit(1), F.col("__bytes")) - 1) / each).cast("long")
    pieces = cut.select(*[F.col(c) for c in docs.columns], F.concat_ws("-", name, piece).alias("shard"), *out)
    return rest.unionByName(pieces)
