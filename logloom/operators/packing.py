"""Greedy packing of an ordered table into budgeted batches, exactly and in parallel.

Where a batch ends depends on where it began, so packing looks sequential.  But
the start of the next batch is a function of the start of this one, and that
function needs only a running total.  So:

1. Every group is cut into intervals of its running total (or row number), each
   a few budgets long.  A batch reaches at most one interval further.
2. Per interval, for each row that could be the first batch start in it, find
   the first batch start after the interval (`_exits`).  This does not need to
   know which of them is the real one, so all intervals run at once.
   Groups of one interval begin at their first row and need no exits.
3. The exits are composed, first inside blocks of intervals (`_block_exits`, in
   parallel), then over blocks: a few rows per block of many thousand log rows.
   That tells the real first start of each block, then of each interval.
4. Per interval, number the batches from the real start.

The unit of work is an interval, whatever the size of its group: one group may
hold most of the table.  Where groups are small and many, a task numbers a bucket of
intervals at once.  Only ids and sizes move, never the texts.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext as sx
from ..functions.ordering import dense_position, running
from ..functions.text import col
from ..session import held, scratch_path

BUCKET_ROWS = 1 << 16  # rows that are numbered at once, about; one interval may have more
WAVE_FILES = 20_000  # files that one job writes or lists, about
_EXIT = "{g}, _block long, _interval long, _entry long, _to long, _x long, _batches long"


@dataclass(frozen=True)
class Rule:
    """When a batch ends.  `rows` closes after that many rows; `budget` closes
    before the row that would exceed it, or after the one that reaches it."""

    budget: int
    rows: int | None = None  # None: close before overflow

    def next_starts(self, before: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Index of the next batch start for a batch that starts at each row."""
        at = np.arange(len(before))
        upto = before + size
        if self.rows is None:
            end = np.searchsorted(upto, before + self.budget, side="right")
        else:
            end = np.searchsorted(upto, before + self.budget, side="left") + 1
            end = np.minimum(end, at + self.rows)
        return np.minimum(np.maximum(end, at + 1), len(before))


def _jump_out(nxt: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow `nxt` from every own row until it leaves the own rows (pointer doubling)."""
    to, steps = nxt[:own].copy(), np.ones(own, dtype=np.int64)
    while True:
        inside = to < own
        if not inside.any():
            return to, steps
        hop = to[inside]
        steps[inside] += steps[hop]
        to[inside] = to[hop]


def _numbered(df: DataFrame, group: str, order: list[str], size: Column, rule: Rule, span: int) -> DataFrame:
    """(group, order…, _n, _size, _before, _x, _interval): rows numbered by (group, order)."""
    rows = dense_position(df.select(group, *order, size.cast("long").alias("_size")), group, *order, name="_n")
    rows = running(rows, "_n", keys=[group], sums={"_upto": F.col("_size")})
    rows = rows.withColumn("_before", F.col("_upto") - F.col("_size")).drop("_upto")
    if rule.rows is None:
        reach, x = rule.budget, F.col("_before")
    else:
        first = rows.groupBy(group).agg(F.min("_n").alias("_first"))
        rows = rows.join(first, group)
        reach, x = rule.rows, F.col("_n") - F.col("_first")
    rows = rows.withColumn("_x", x).withColumn("_interval", F.floor(F.col("_x") / (reach * span)))
    return rows.select(group, *order, "_n", "_size", "_before", "_x", "_interval")


def _exits(rows: DataFrame, group: str, schema: str, rule: Rule, span: int, blocks: int) -> DataFrame:
    reach = rule.rows or rule.budget
    width = reach * span
    # rows within reach of an interval's start are also the look-ahead of the one before
    near = (F.col("_x") - F.col("_interval") * width <= reach) & (F.col("_interval") > 0)
    copies = F.when(near, F.array("_interval", F.col("_interval") - 1)).otherwise(F.array("_interval"))
    seen = rows.select(
        group, "_n", "_size", "_before", "_x", F.col("_interval").alias("_home"), F.explode(copies).alias("_interval")
    )

    def per_interval(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        interval = key[1]
        n, x, size = (pdf[c].to_numpy() for c in ("_n", "_x", "_size"))
        own = int((pdf["_home"] == interval).sum())
        entries = np.flatnonzero((x[:own] - interval * width <= reach) | (np.arange(own) == 0))
        nxt = rule.next_starts(pdf["_before"].to_numpy(), size)
        to, steps = _jump_out(nxt, own)
        last = x[-1] + (1 if rule.rows else size[-1])
        return pd.DataFrame(
            {
                group: key[0],
                "_block": interval // blocks,
                "_interval": interval,
                "_entry": n[entries],
                "_to": np.append(n, n[-1] + 1)[to[entries]],
                "_x": np.append(x, last)[to[entries]],
                "_batches": steps[entries],
            }
        )

    return seen.groupBy(group, "_interval").applyInPandas(per_interval, schema)


def _reachable(exits: DataFrame, group: str) -> DataFrame:
    """Only entries that some exit leads to, and each group's first row.

    Chains from different rows of an interval soon run into each other, so of
    the many rows that could be a first start only a few are ever reached.
    """
    targets = exits.select(group, F.col("_to").alias("_entry")).union(
        exits.groupBy(group).agg(F.min("_entry").alias("_entry"))
    )
    return held(exits.join(targets.distinct(), [group, "_entry"], "left_semi").select(*exits.columns))


def _block_exits(exits: DataFrame, group: str, schema: str, width: int, blocks: int) -> DataFrame:
    """Exits of whole blocks, for the rows of the first interval present in a block:
    rows skipped over by one oversize row leave no rows in between, so a block
    can only be entered there."""

    def per_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, tuple[int, int, int]] = {}
        for entry, to, x, k in sorted(
            pdf[["_entry", "_to", "_x", "_batches"]].itertuples(index=False, name=None), reverse=True
        ):
            onward = known.get(to) if x // width // blocks == key[1] else None
            known[entry] = (onward[0], onward[1], onward[2] + k) if onward else (to, x, k)
        first = pdf["_interval"].min()
        doors = pdf.loc[pdf["_interval"] == first, "_entry"]
        out = [(e, *known[e]) for e in doors]
        frame = pd.DataFrame(out, columns=["_entry", "_to", "_x", "_batches"])
        return frame.assign(**{group: key[0], "_block": key[1], "_interval": first})

    return exits.groupBy(group, "_block").applyInPandas(per_block, schema)


def _walk(pdf: pd.DataFrame, start: int, batch: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """(row of pdf, entry, first batch number) along the chain from `start`, and
    the start and batch number it leaves with."""
    entry, to, k = (pdf[c].to_numpy() for c in ("_entry", "_to", "_batches"))
    at = {e: i for i, e in enumerate(entry)}
    path = []
    while start in at:
        i = at[start]
        path.append((i, start, batch))
        start, batch = to[i], batch + k[i]
    return path, start, batch


def _real_entries(exits: DataFrame, group: str, group_type: str, schema: str, width: int, blocks: int) -> DataFrame:
    """(group, _interval, _entry, _batch): the real first start of each interval.

    Behind the last start of a group there may be one more interval whose rows
    all belong to the open batch; it gets an entry behind its rows.
    """
    block_schema = f"{group} {group_type}, _block long, _start long, _batch long"
    entry_schema = f"{group} {group_type}, _interval long, _entry long, _batch long"

    def over_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path, start, batch = _walk(pdf, pdf["_entry"].min(), 0)
        block = pdf["_block"].to_numpy()
        rows = [(key[0], block[i], e, b) for i, e, b in path]
        rows.append((key[0], rows[-1][1] + 1, start, batch))
        return pd.DataFrame(rows, columns=[group, "_block", "_start", "_batch"])

    def in_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path, start, batch = _walk(pdf, pdf["_start"].iloc[0], pdf["_batch"].iloc[0])
        interval = pdf["_interval"].to_numpy()
        rows = [(key[0], interval[i], e, b) for i, e, b in path]
        after = rows[-1][1] + 1 if rows else interval.min()
        if after // blocks == key[1]:
            rows.append((key[0], after, start, batch))
        return pd.DataFrame(rows, columns=[group, "_interval", "_entry", "_batch"])

    doors = _block_exits(exits, group, schema, width, blocks)
    starts = doors.groupBy(group).applyInPandas(over_blocks, block_schema)
    return exits.join(starts, [group, "_block"]).groupBy(group, "_block").applyInPandas(in_block, entry_schema)


def pack(
    df: DataFrame,
    group: str,
    order: list[str],
    size: Column,
    rule: Rule,
    span: int = 64,
    blocks: int = 512,
) -> DataFrame:
    """(group, order…, size, batch_no from 0).  `size` must be at least 1.

    An interval is `span` budgets long; `blocks` intervals form a block.  Rows without a
    group are a group of their own.
    """
    # joins and running sums need a key that is never null
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    return _pack(df.withColumn("_g", key), "_g", [group, *order], size, rule, span, blocks).drop("_g")


def _pack(df: DataFrame, group: str, order: list[str], size: Column, rule: Rule, span: int, blocks: int) -> DataFrame:
    if rule.rows is None:
        size = F.greatest(size, F.lit(1))
    rows = held(_numbered(df, group, order, size, rule, span))  # ids and sizes, read twice
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = _EXIT.format(g=f"{group} {kinds[group]}")
    width = (rule.rows or rule.budget) * span
    long = rows.where("_interval > 0").select(group).distinct()
    exits = _reachable(held(_exits(rows.join(long, group, "left_semi"), group, schema, rule, span, blocks)), group)
    entries = _real_entries(exits, group, kinds[group], schema, width, blocks)
    out_schema = ", ".join(
        [f"{c} {kinds[c]}" for c in (group, *order)] + ["size long", "batch_no long"]
    )

    def batches(n: np.ndarray, before: np.ndarray, size: np.ndarray, entry: int, batch: int) -> np.ndarray:
        """Batch numbers of one interval."""
        starts = np.zeros(len(n), dtype=np.int64)
        nxt = rule.next_starts(before, size)
        i = int(np.searchsorted(n, entry))
        while i < len(n):
            starts[i] = 1
            i = nxt[i]
        # rows ahead of the first start belong to the batch that began earlier
        return batch - 1 + np.cumsum(starts)

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n", ignore_index=True)
        # row numbers are dense over the whole table, so the rows of an interval follow each other
        new = (pdf[group] != pdf[group].shift()) | (pdf["_interval"] != pdf["_interval"].shift())
        cuts = np.append(np.flatnonzero(new), len(pdf))
        n, before, size, entry, batch = (pdf[c].to_numpy() for c in ("_n", "_before", "_size", "_entry", "_batch"))
        found = [batches(n[i:j], before[i:j], size[i:j], entry[i], batch[i]) for i, j in zip(cuts, cuts[1:])]
        return pdf.assign(size=size, batch_no=np.concatenate(found))[[group, *order, "size", "batch_no"]]

    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    return (
        rows.join(entries, [group, "_interval"], "left")
        .fillna(0, ["_entry", "_batch"])  # the first interval of a group of one
        .withColumn("_bucket", F.pmod(F.xxhash64(group, "_interval"), F.lit(buckets)))
        .groupBy("_bucket")
        .applyInPandas(number, out_schema)
    )


def pack_tokens(
    df: DataFrame, budget: int, group: str, order: list[str], tokens: Column, cut: bool = False, **how: int
) -> DataFrame:
    """Close a batch before the row that would exceed the budget.

    A row above the budget on its own is split: `piece_no` 0, 1, … are rows of their own, each
    with a budget at most, and `piece_of_text` gives their texts.  With `cut` there is one
    row instead, of budget - 100 tokens, and the rest is left out.
    """
    if cut:
        return pack(df, group, order, F.when(tokens > budget, F.lit(budget - 100)).otherwise(tokens), Rule(budget), **how)
    sized = df.select(group, *order, F.greatest(tokens, F.lit(1)).cast("long").alias("_tokens"))
    last = F.floor((F.col("_tokens") - 1) / budget).cast("int")
    pieces = sized.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    size = F.least(F.lit(budget), F.col("_tokens") - F.col("piece_no") * budget)
    return pack(pieces, group, [*order, "piece_no"], size, Rule(budget), **how)


def piece_of_text(text: Column | str, piece_no: Column | str, budget: int, chars: int = 4) -> Column:
    """The text of a piece where a text has its length div `chars` tokens: `budget` tokens, and in
    the last piece all that is left."""
    start = (col(piece_no) * budget * chars).cast("int")
    left = F.char_length(col(text)) - start
    size = F.when(left < (budget + 1) * chars, left).otherwise(F.lit(budget * chars))
    return F.substring(col(text), start + 1, size)


def cut_to_budget(text: Column | str, tokens: Column, budget: int, chars: int = 4) -> Column:
    """The text that goes with a cut row: budget - 100 tokens of `chars` characters."""
    text = col(text)
    return F.when(tokens > budget, F.substring(text, 1, (budget - 100) * chars)).otherwise(text)


def pack_rows_tokens(
    df: DataFrame, n: int, limit: int, group: str, order: list[str], tokens: Column | None = None, **how: int
) -> DataFrame:
    """Add the row, then close the batch at n rows or `limit` tokens; nothing is cut."""
    tokens = sx.est_tokens("query_id", "name", "query_sql") if tokens is None else tokens
    return pack(df, group, order, tokens, Rule(limit, n), **how)


def chunk_bytes(df: DataFrame, limit: int, group: str, order: list[str], text: str, **how: int) -> DataFrame:
    """Close a file before the text that would exceed `limit` UTF-8 bytes; a
    larger text has a file of its own.  Files are file.sql, file2.sql, …"""
    how.setdefault("span", 16)  # byte budgets are large: shorter intervals
    packed = pack(df, group, order, F.octet_length(text), Rule(limit), **how)
    number = F.when(F.col("batch_no") == 0, "").otherwise((F.col("batch_no") + 1).cast("string"))
    return packed.withColumn("file_name", F.concat(F.lit("file"), number, F.lit(".sql")))


def _of_wave(group: str, waves: int) -> Column:
    """The wave of a chunk: chunks of one folder share it (a group without a name has the folder of none)."""
    return F.pmod(F.xxhash64(F.nullif(F.col(group).cast("string"), F.lit("")), "file_name"), F.lit(waves)).cast("int")


def _n_waves(chunks: DataFrame, group: str, files: int) -> int:
    return max(1, math.ceil(chunks.select(group, "file_name").distinct().count() / files))


def write_chunks(
    texts: DataFrame, chunks: DataFrame, path: str, group: str, order: list[str], text: str, files: int = WAVE_FILES
) -> None:
    """Write each chunk's texts below path/<group>/<file_name>/.

    `order` must tell the rows of a group apart.  Texts end with a line break, which the text format puts behind every row.
    Those of one chunk meet in one task and keep their order; a chunk is bounded
    by its byte limit.  The driver notes a line for each file of a job, so about `files` chunks are written by one: beyond that,
    texts are placed by wave first, and each wave reads its own.
    """
    names = [group, *order]
    places = chunks.select(*[F.col(c).alias(f"_{c}") for c in names], "file_name")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    rows = texts.join(places, same).select(*dict.fromkeys([group, "file_name", *order, text]))

    def write(own: DataFrame, mode: str) -> None:
        (
            own.repartition(group, "file_name")
            .sortWithinPartitions(group, "file_name", *order)
            .select(group, "file_name", F.regexp_replace(text, r"\n\z", "").alias("value"))
            .write.partitionBy(group, "file_name")
            .mode(mode)
            .text(path)
        )

    waves = _n_waves(chunks, group, files)
    if waves == 1:
        return write(rows, "overwrite")
    placed = rows.withColumn("_wave", _of_wave(group, waves))
    waiting = scratch_path(texts.sparkSession, "waves")
    placed.write.partitionBy("_wave").parquet(waiting)
    for i in range(waves):
        own = texts.sparkSession.read.schema(placed.schema).parquet(waiting).where(F.col("_wave") == i)
        write(own, "append" if i else "overwrite")


def written_sizes(chunks: DataFrame, path: str, group: str, files: int = WAVE_FILES) -> DataFrame:
    """(group, file_name, n_bytes) of every file that `write_chunks` wrote below `path`, the group as text.

    A listing stands in the driver, so about `files` folders are listed at a time, and what was found is written.
    """
    spark, waves = chunks.sparkSession, _n_waves(chunks, group, files)
    folders = held(chunks.select(F.col(group).cast("string").alias("_g"), "file_name", _of_wave(group, waves).alias("_wave")).distinct())
    out = f"`{group}` string, file_name string, n_bytes bigint"
    found = scratch_path(spark, "sizes")
    spark.createDataFrame([], out).write.parquet(found)
    for i in range(waves):
        own = {f"{path}/{_folder(group, r[0])}/{_folder('file_name', r[1])}" for r in folders.where(F.col("_wave") == i).collect()}
        if not own:
            continue
        with _listing(spark):
            back = (
                spark.read.format("binaryFile")
                .schema(f"path string, modificationTime timestamp, length bigint, content binary, `{group}` string, file_name string")
                .option("basePath", path)
                .load(sorted(own))
            )
        back.select(group, "file_name", F.col("length").alias("n_bytes")).write.mode("append").parquet(found)
        del back
        gc.collect()  # the JVM keeps a listing as long as Python has not dropped its table
    return spark.read.schema(out).parquet(found)


def _folder(column: str, value: str | None) -> str:
    """The folder that a writer gives to a value of a column it partitions by."""
    if not value:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks of many, not by one task each, and what was listed is not kept by the session."""
    now = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism),
        "spark.sql.hive.manageFilesourcePartitions": "false",  # else up to 250 MB of listings stay in the driver
    }
    before = {name: spark.conf.get(name) for name in now}
    try:
        for name, value in now.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
