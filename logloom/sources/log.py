"""Reading a query log and bringing it to all-text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import dense_position

LOG_COLUMNS = [
    "query_id", "name", "description", "tags", "version", "parameters",
    "query_engine", "query_sql", "is_private", "is_archived", "is_unsaved", "owner",
]

# Texts that stand for "no value" when they fill a whole cell (fixed values).
NO_VALUE = ["None", "nan", "<NA>"]


def scan_log(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One parquet file or a folder of them; only `columns` are read."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def _as_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BooleanType):
        text = F.initcap(c.cast("string"))
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    text = F.when(text.isin(NO_VALUE), "").otherwise(F.translate(text, "\t", " "))
    return F.nullif(text, F.lit("")).alias(field.name)


def to_all_text(df: DataFrame) -> DataFrame:
    """Every column as text; empty cells and no-value words become NULL, tabs blanks."""
    return df.select(*[_as_text(f) for f in df.schema.fields])


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The log as all text with `pos`, the physical position of a row: its file and
    its row number there.  It is the same in every run, also after a lost task."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(*[_as_text(f) for f in df.schema.fields], at.alias("pos"))


def load_report(df: DataFrame) -> DataFrame:
    """Rows per input file, and a row with file NULL for the total.

    `df` comes straight from a file scan; only the file name is read from it.
    """
    return (
        df.select(F.col("_metadata.file_name").alias("file"))
        .rollup("file")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of (query_id, name, query_sql) over queries that have SQL.

    Rows are numbered, so rows without id (first) and repeated ids count each.  Only ids and
    a hash of the row are sorted, however deep the page; the page itself holds at most
    `limit` of them, which bounds the broadcast.
    """
    rows = df.filter(F.col("query_sql").isNotNull())
    rows = rows.select("query_id", F.coalesce("name", F.lit("")).alias("name"), "query_sql")
    rows = rows.withColumn("_h", F.md5(F.to_json(F.struct("name", "query_sql"))))
    places = dense_position(rows.select("query_id", "_h"), "query_id", "_h", name="_n", start=0)
    wanted = places.filter((F.col("_n") >= offset) & (F.col("_n") < offset + limit))
    wanted = wanted.groupBy(F.col("query_id").alias("_id"), F.col("_h").alias("_k")).agg(F.count("*").cast("int").alias("_times"))
    same = F.col("query_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k"))
    met = rows.join(F.broadcast(wanted) if limit <= 100_000 else wanted, same)
    # equal rows: one brings the text, and it comes out as often as the page has it
    once = met.groupBy("query_id", "_h").agg(*[F.first(c).alias(c) for c in ("name", "query_sql", "_times")])
    again = once.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return again.orderBy("query_id", "_h").select("query_id", "name", "query_sql")
