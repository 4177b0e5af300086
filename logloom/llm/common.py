"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SPACES = r"[\x20\x09-\x0D]+"
HASH_BITS = 60


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared checkpoint folder and read it from there.

    Used where a result is read more than once, or where a long lineage is cut: the
    rows are then the same for every reader, also after an executor is lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """What is run inside hands its rows to Python in batches of at most `size`, whatever the number of rows.

    A batch of a fixed number of texts is as large as they are; a Python worker holds it twice or more.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words of a text: runs without space, tab, newline, \\v, \\f or \\r. Null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body` (higher-order functions
    would evaluate it again for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash60(*parts: Column) -> Column:
    """A 60-bit number from the MD5 of the parts, which SQL engines agree on."""
    joined = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")
