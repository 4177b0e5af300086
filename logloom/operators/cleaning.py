"""Cleaning and deduplication of a query log.

"First" rows are first by a position column, which tells the rows apart.  Which rows stay is
decided over positions, ids and text hashes of fixed width, in hash aggregations with
map-side combine: an id or a text that fills a third of the log is one row per input
partition before the shuffle.  The log then meets the positions that stay, held and
measured: a broadcast, or one shuffle join; no row is sorted or aggregated with its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import small_side

# Texts that say nothing (fixed values).
EMPTY_DESCRIPTIONS = ["", "null", "none", "test", "n/a", "-"]
GARBAGE_NAMES = ["new query", "untitled", "query", "test", "unnamed query"]
# One run of copy marks; a name keeps later runs.
COPY_RUN = r"(?is)^(.*?)(?:Copy of\s*(?:\(#\d+\))?\s*)+"


#: Start of the second hash of a text: both together are 128 bits.
SECOND_HASH = "second"


def _id_key(pos: str) -> Column:
    # NULL ids are never equal, so each NULL row is a group of its own
    return F.struct(col("query_id").alias("id"), F.when(col("query_id").isNull(), col(pos)).alias("own"))


def _too_short(n: int) -> Column:
    text = F.trim("query_sql")  # blanks only, like the SQL function
    return col("query_sql").isNull() | (text == "") | (F.length(text) < n)


def _facts(df: DataFrame, pos: str, n: int) -> DataFrame:
    """(_pos, _id, _h1, _h2, _short) of each row; missing texts have a hash of their own."""
    sql = F.struct(col("query_sql"))
    return df.select(
        col(pos).alias("_pos"),
        _id_key(pos).alias("_id"),
        F.xxhash64(sql).alias("_h1"),
        F.xxhash64(F.lit(SECOND_HASH), sql, F.length("query_sql")).alias("_h2"),
        _too_short(n).alias("_short"),
    )


def _first_ids(facts: DataFrame) -> DataFrame:
    rest = [F.min_by(c, "_pos").alias(c) for c in ("_h1", "_h2", "_short")]
    return facts.groupBy("_id").agg(*rest, F.min("_pos").alias("_first")).withColumnRenamed("_first", "_pos")


def _first_texts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("_h1", "_h2").agg(F.min("_pos").alias("_pos"))


def _staying(df: DataFrame, facts: DataFrame, pos: str) -> DataFrame:
    kept = small_side(facts.select(F.col("_pos").alias("_kept")))
    return df.join(kept, col(pos) == F.col("_kept"), "left_semi")


def dedupe_by_id(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Keep the first row of each query_id; rows without id all stay."""
    return _staying(df, _first_ids(_facts(df, pos, 0)), pos)


def dedupe_by_sql(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Keep the first row of each SQL text; missing texts are one group."""
    return _staying(df, _first_texts(_facts(df, pos, 0)), pos)


def drop_short_sql(df: DataFrame, n: int = 10) -> DataFrame:
    return df.filter(~_too_short(n))


def normalize_text(df: DataFrame) -> DataFrame:
    about = F.trim("description")
    return df.withColumns(
        {
            "owner": F.lower(F.trim("owner")),
            "name": F.lower(F.trim(F.regexp_replace("name", COPY_RUN, "$1"))),
            "description": F.when(~F.lower(about).isin(EMPTY_DESCRIPTIONS), about),
        }
    )


def null_garbage_names(df: DataFrame) -> DataFrame:
    garbage = F.coalesce(F.lower(F.trim("name")).isin(GARBAGE_NAMES), F.lit(False))
    return df.withColumn("name", F.when(~garbage, col("name")))


def clean(df: DataFrame, pos: str = "pos", n: int = 10) -> DataFrame:
    """All steps.  Rows with equal SQL are short together, so the length test
    runs before the text dedupe, which then has no missing texts; the closing purge of
    blank SQL is part of that test."""
    first = _first_ids(_facts(df, pos, n)).filter(~F.col("_short"))
    return null_garbage_names(normalize_text(_staying(df, _first_texts(first), pos)))


CLEAN_STEPS = [
    "dedupe_by_id",
    "dedupe_by_sql",
    "drop_short_sql",
    "normalize_text",
    "null_garbage_names",
    "final_purge",
]


def clean_audit(df: DataFrame, pos: str = "pos", n: int = 10) -> DataFrame:
    """Per step: rows before, after, dropped; and a total.

    One chain of aggregations over (id, text hash, short flag) gives all the
    counts, instead of running the cleaning once per step.
    """
    facts = F.struct(F.md5("query_sql").alias("h"), _too_short(n).alias("short"))
    per_id = df.groupBy(_id_key(pos).alias("k")).agg(
        F.count(F.lit(1)).alias("c"), F.min_by(facts, pos).alias("m")
    )
    per_text = per_id.groupBy(F.col("m.h")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"), F.first("m.short").alias("short")
    )
    n0 = F.coalesce(F.sum("c"), F.lit(0))
    n1 = F.coalesce(F.sum("k"), F.lit(0))
    totals = per_text.agg(
        n0.alias("n0"), n1.alias("n1"), F.count(F.lit(1)).alias("n2"), F.count_if(~F.col("short")).alias("n3")
    )
    marks = ["n0", "n1", "n2", "n3", "n3", "n3", "n3"]
    rows = [
        F.struct(
            F.lit(i + 1).alias("step_no"),
            F.lit(step).alias("step"),
            F.col(marks[i]).alias("rows_before"),
            F.col(marks[i + 1]).alias("rows_after"),
        )
        for i, step in enumerate(CLEAN_STEPS)
    ]
    total = F.struct(
        F.lit(len(rows) + 1).alias("step_no"),
        F.lit("total").alias("step"),
        F.col("n0").alias("rows_before"),
        F.col("n3").alias("rows_after"),
    )
    return totals.select(F.inline(F.array(*rows, total))).withColumn(
        "dropped", F.col("rows_before") - F.col("rows_after")
    )
