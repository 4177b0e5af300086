"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("logloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # small shuffles carry texts that are dear to parse: keep them on all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this application.

    A cluster names it in ``spark.checkpoint.dir``.  A machine-local folder is
    only accepted in local mode, where driver and executors share one disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="logloom-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table written by one run."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it from there.

    Used where a result is read more than once and must be the same each time
    (partition numbers of a sort), also after an executor is lost.  What is held already is
    not written again.
    """
    if getattr(df, "_is_held", False):
        return df
    scratch_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    kept._is_held = True
    return kept


def written(df: DataFrame, name: str) -> DataFrame:
    """Like `held`, for large rows: packed columns in files, of which a reader takes those it needs."""
    if getattr(df, "_is_held", False):
        return df
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._is_held = True
    return kept


BROADCAST_BYTES = 128 << 20


def measured_bytes(df: DataFrame) -> int:
    """What the rows of `df` take in a broadcast, about: texts and nested values by their bytes, others by 16."""
    sizes = [F.lit(32 + 16 * len(df.columns))]
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(F.col(f"`{name}`")))
        elif kind.startswith(("struct", "array", "map")):
            sizes.append(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))))
    total = sum(F.coalesce(x.cast("long"), F.lit(0)) for x in sizes)
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A dictionary for one side of a join, held and measured: broadcast up to `most`
    bytes, otherwise a shuffle join, which adaptive execution splits where skewed."""
    kept = held(df)
    return F.broadcast(kept) if measured_bytes(kept) <= most else kept
