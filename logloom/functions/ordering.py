"""Row numbers and running values over a whole table without a single-task window.

A window with no partition moves the table to one task.  Here the table is cut
in slices, each slice is numbered or summed by itself, and only one row per
slice goes through the single ordered pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import held

BLOCK = 1 << 16
_LOW_BITS = (1 << 33) - 1


def dense_position(df: DataFrame, *order: Column | str, name: str = "position", start: int = 1) -> DataFrame:
    """Number the rows 1, 2, 3 … in `order` (which should be unique).

    One range shuffle.  `monotonically_increasing_id` gives (partition, row in
    partition); the sorted rows are held in the checkpoint folder, so both reads
    below see the same partitions.  The offsets table has one row per partition
    of the sort and is broadcast for that reason.
    """
    rows = held(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    rows = rows.withColumn("_slice", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_slice")
        .count()
        .select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        rows.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_offset") + F.col("_row") + F.lit(start))
        .drop("_mid", "_slice", "_row", "_offset")
    )


def running(
    df: DataFrame,
    position: str,
    *,
    keys: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Running sums and last-seen values up to and including each row.

    `position` must be dense (see `dense_position`), which makes
    ``position div block`` a slice of at most `block` rows whatever the keys
    are.  The ordered pass over slices sees one row per slice.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    keys = list(keys)
    # Materialise the inputs first, so both branches use the same columns.
    rows = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)))
    for name, value in {**sums, **lasts}.items():
        rows = rows.withColumn(f"_in_{name}", value)

    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = rows
    for name in sums:
        out = out.withColumn(f"_at_{name}", F.sum(f"_in_{name}").over(inside))
    for name in lasts:
        out = out.withColumn(f"_at_{name}", F.last(f"_in_{name}", ignorenulls=True).over(inside))

    per_block = rows.groupBy(*keys, "_block").agg(
        *[F.sum(f"_in_{n}").alias(f"_blk_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(position))).alias(f"_blk_{n}")
            for n in lasts
        ],
    )
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy()
    earlier = earlier.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *keys,
        "_block",
        *[F.sum(f"_blk_{n}").over(earlier).alias(f"_from_{n}") for n in sums],
        *[F.last(f"_blk_{n}", ignorenulls=True).over(earlier).alias(f"_from_{n}") for n in lasts],
    )
    out = out.join(carry, [*keys, "_block"], "left")
    for name in sums:
        out = out.withColumn(
            name, F.coalesce(F.col(f"_from_{name}"), F.lit(0)) + F.coalesce(F.col(f"_at_{name}"), F.lit(0))
        )
    for name in lasts:
        out = out.withColumn(name, F.coalesce(F.col(f"_at_{name}"), F.col(f"_from_{name}")))
    helper = [f"{p}_{n}" for n in {**sums, **lasts} for p in ("_in", "_at", "_from")]
    return out.drop("_block", *helper)
