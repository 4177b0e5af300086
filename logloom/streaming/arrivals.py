"""New queries of an arriving log: only the first sight of an id passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_new_queries(
    stream: DataFrame, ledger_path: str, checkpoint: str, order: str = "pos", known: str | None = None
) -> StreamingQuery:
    """Append to the ledger every row whose query_id was never seen; of equal ids in
    one micro-batch the first by `order` passes (ties: by the other columns).  Rows without an id all pass.
    Returns the started query.

    What was seen is keyed state of the stream, so a micro-batch costs what it holds, whatever the size of the
    ledger.  `known` is a ledger written elsewhere (Parquet with query_id): it is read as a second
    source, each file once, and its ids count as seen.  Equal ids are reduced within the tasks before the shuffle.

    Files are written per micro-batch (``batch_id=…``) and replaced when the batch is run
    again after a failure, with the state of the batch before, so an id never passes twice.
    """
    names = stream.columns
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    # values travel as text, so that whole numbers with nulls stay exact; `_order` is compared
    rows = stream.withColumns({"_order": F.col(order), "_known": F.lit(False)})
    texts = [F.col(n).cast("string").alias(n) for n in names]
    rows = rows.select("_order", "_known", *texts)
    named = rows.filter(F.col("query_id").isNotNull())
    if known is not None:
        ids = stream.sparkSession.readStream.schema("query_id string").parquet(known).filter("query_id IS NOT NULL")
        empty = [F.lit(None).cast("string").alias(n) for n in names if n != "query_id"]
        ids = ids.select(F.lit(None).cast(kinds[order]).alias("_order"), F.lit(True).alias("_known"), "query_id", *empty)
        named = named.unionByName(ids)
    by = ["_order", *names]

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        """One row per id: a known one, else the first."""
        ordered = rows.sort_values(by, na_position="first").sort_values("_known", ascending=False, kind="stable")
        return ordered.drop_duplicates("query_id")

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield first(rows)

    def unseen(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for rows in parts:
            best = first(rows if best is None else pd.concat([best, rows]))
        if not state.exists:
            state.update((True,))
            if best is not None and not best["_known"].iloc[0]:
                yield best[names]

    out = ", ".join(f"`{n}` string" for n in names)
    passed = named.mapInPandas(reduced, named.schema).groupBy("query_id")
    passed = passed.applyInPandasWithState(unseen, out, "seen boolean", "append", GroupStateTimeout.NoTimeout)
    passed = passed.unionByName(rows.filter(F.col("query_id").isNull()).select(*names))
    passed = passed.select(*[F.col(n) if n == "query_id" else F.col(n).cast(kinds[n]).alias(n) for n in names])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ledger_path}/batch_id={batch_id}")

    return (
        passed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")
