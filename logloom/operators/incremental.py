"""Restart-safe state: which ids are done, what is left, fixed batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import dense_position


def _text(name: str) -> Column:
    # one key type on both sides: a number and its text are the same id
    return F.col(name).cast("string")


def seen_ids(ledger: DataFrame, links: DataFrame) -> DataFrame:
    """Ids in the ledger or among the registry's source queries.

    `links` is the long form of the registry's id lists: (tool_id, kind, value).
    """
    from_registry = links.filter(F.col("kind") == "source").select(_text("value").alias("query_id"))
    return ledger.select(_text("query_id").alias("query_id")).union(from_registry).distinct()


def remaining(df: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Rows whose key is not in the ledger."""
    done = ledger.select(*[_text(k).alias(f"_done_{k}") for k in keys])
    same = [_text(k) == F.col(f"_done_{k}") for k in keys]
    return df.join(done, same, "left_anti")


def mark_seen(ledger: DataFrame, ids: DataFrame, key: str = "query_id") -> DataFrame:
    """The ledger with new keys added; a key that is there keeps its seen_at."""
    both = ledger.select(_text(key).alias(key), "seen_at", F.lit(0).alias("_new")).unionByName(
        ids.select(_text(key).alias(key), "seen_at", F.lit(1).alias("_new"))
    )
    return both.groupBy(key).agg(F.min(F.struct("_new", "seen_at")).getField("seen_at").alias("seen_at"))


def drained_tables(popular: DataFrame, routed: DataFrame, seen: DataFrame, seen_tables: DataFrame) -> DataFrame:
    """Tables not yet marked done whose routed queries have all been seen."""
    left = remaining(routed, seen).groupBy("full_name").agg(F.count(F.lit(1)).alias("n"))
    pending = popular.select("full_name").join(seen_tables.select("full_name"), "full_name", "left_anti")
    return pending.join(left, "full_name", "left_anti")


def progress(df: DataFrame, ledger: DataFrame, key: str = "query_id") -> DataFrame:
    """total / done / remaining, in one row; done counts ledger entries."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rest = remaining(df, ledger, [key]).agg(F.count(F.lit(1))).scalar()
    return ledger.agg(F.countDistinct(_text(key)).alias("done")).select(
        total.alias("total"), "done", rest.alias("remaining")
    )


def fixed_batches(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """batch_no = (position - 1) div n over the whole table, batches from 0."""
    rows = dense_position(df, *(order or ("query_id",)), name="position")
    return rows.withColumn("batch_no", F.floor((F.col("position") - 1) / n))
