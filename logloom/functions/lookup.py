"""Looking names up inside a row, where a row holds a list of them.

A join would explode the list and gather the rows again.  A dictionary whose size has been
measured is instead one value that every task holds: an array of slots by the hash of the
name, with the names of a slot next to each other.  A look-up reads one slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import held, measured_bytes

#: Above this the dictionary stays a table, and the caller joins.
LOOKUP_BYTES = 16 << 20

Find = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_row(
    rows: DataFrame, known: DataFrame, key: str, value: str, name: str, body: Callable[[Find], Column], most: int = LOOKUP_BYTES
) -> DataFrame | None:
    """`rows` with a column `name`: what `body` makes of ``find(x)``, the value of a name x or NULL.

    `known` has each key once, none NULL.  None if it takes more than `most` bytes.
    """
    known = held(known.select(F.col(key).alias("k"), F.col(value).alias("v")))
    if measured_bytes(known) > most:
        return None
    n = max(1, known.count())
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    filled = known.groupBy(slot(F.col("k")).alias("slot")).agg(F.collect_list(F.struct("k", "v")).alias("names"))
    every = known.sparkSession.range(n).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    by_slot = F.array_sort(F.collect_list(F.struct("slot", "names")))
    table = every.agg(F.transform(by_slot, lambda s: s["names"]).alias("slots")).scalar()

    def found(slots: Column) -> Column:
        return body(lambda x: F.get(F.filter(F.get(slots, slot(x)), lambda e: e["k"] == x), F.lit(0))["v"])

    # a column first, since no subquery may stand in a function with a lambda; used once, it is never copied to the rows
    return rows.withColumn("_slots", table).withColumn(name, let(F.col("_slots"), found)).drop("_slots")
