"""File sources and sinks: popular-table CSV, label TSV, source YAML, text renderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import running
from ..functions.text import blank, col, strip
from .log import LOG_COLUMNS

POPULAR_SCHEMA = "rank long, namespace string, `table` string, full_name string, `count` long"
IMPACT_SCHEMA = (
    "rank long, namespace string, `table` string, full_name string, appearances long, "
    "appearance_share_pct double, cumulative_pct double, tier string"
)
LABEL_SCHEMA = "query_id string, label string"
CHAIN_SCHEMA = "query_id string, chains string, label string"
TAXONOMY_SCHEMA = "namespace string, table_name string, g1 string, g2 string, g3 string"


def read_popular(spark: SparkSession, path: str, schema: str = POPULAR_SCHEMA) -> DataFrame:
    """CSV with a header; the schema is given, so nothing is inferred.

    An empty cell is an empty text here (a table without namespace), not NULL.
    """
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True, emptyValue="", nullValue="\u0000")


def read_labels(spark: SparkSession, path: str, schema: str = LABEL_SCHEMA, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """parquet, csv (with header) or tsv (no header, for appending)."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).csv(path, header=True, escape='"', emptyValue="")
    elif fmt == "tsv":
        df.write.mode(mode).csv(path, sep="\t", header=False)
    else:
        raise ValueError(f"unknown format {fmt!r}")


# --- rows as INSERT statements ---------------------------------------------

# Cells written as NULL, after trimming (fixed values).
NULL_WORDS = ["", "None", "nan", "NULL"]


def _literal(name: str) -> Column:
    text = col(name).cast("string")
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(text.isNull() | strip(text).isin(NULL_WORDS), F.lit("NULL")).otherwise(quoted)


def render_inserts(
    df: DataFrame, cols: Sequence[str] = LOG_COLUMNS, target: str = "Query", name: str = "statement"
) -> DataFrame:
    """`df` with one INSERT statement per row in column `name`."""
    names = ", ".join(f'"{c}"' for c in cols)
    values = F.concat_ws(", ", *[_literal(c) for c in cols])
    head = f'INSERT INTO "{target}" ({names}) VALUES ('
    return df.withColumn(name, F.concat(F.lit(head), values, F.lit(");\n")))


def render_blocks(df: DataFrame, body: str = "body") -> DataFrame:
    """One text block per query: heading, body, a rule of 50 dashes."""
    head = F.concat(F.lit("--- Query ID: "), col("query_id").cast("string"), F.lit(" ---\n"))
    block = F.concat(head, F.coalesce(col(body), F.lit("")), F.lit("\n" + "-" * 50 + "\n\n"))
    return df.select("query_id", block.alias("block"))


# --- source YAML ------------------------------------------------------------


def read_yaml_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of every YAML file below `path`."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{yml,yaml}")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r\n|\r|\n").alias("lines"))
    )
    return files.select("file", F.posexplode("lines").alias("line_no", "line"))


def scan_source_yaml(lines: DataFrame) -> DataFrame:
    """(file, line_no, line), line_no dense per file -> (file, line_no, source, table).

    A line's meaning depends only on the last source heading and on whether a
    ``tables:`` block is open, so both are last-seen values over the lines.
    """
    text = strip("line")
    read = lines.filter(~(blank("line") | F.startswith(text, F.lit("#"))))
    indent = F.length("line") - F.length(F.ltrim("line"))
    item = F.startswith(text, F.lit("- name:"))
    value = strip(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1))
    heading = (indent == 2) & item
    opens = (indent == 4) & (text == "tables:")
    closes = (indent <= 4) & (text != "tables:")
    marked = read.select(
        "file",
        "line_no",
        F.when(heading, value).alias("_source"),
        F.when(opens, True).when(closes, False).alias("_open"),
        F.when((indent == 6) & item, value).alias("_table"),
    )
    seen = running(
        marked, "line_no", keys=["file"], lasts={"source": F.col("_source"), "_in": F.col("_open")}
    )
    return seen.filter(F.col("_in") & F.col("_table").isNotNull()).select(
        "file", "line_no", F.coalesce("source", F.lit("")).alias("source"), F.col("_table").alias("table")
    )


SOURCE_FORMATS = {
    "table": [("table", "table_name")],
    "source_table": [("source", "namespace"), ("table", "table_name")],
    "file_source_table": [("file", "file_path"), ("source", "namespace"), ("table", "table_name")],
}


def source_tables(rows: DataFrame, fmt: str = "source_table", unique: bool = True) -> DataFrame:
    """Project scan_source_yaml rows; sorted and distinct, or in file order."""
    pairs = SOURCE_FORMATS[fmt]
    out = [F.col(a).alias(b) for a, b in pairs]
    if unique:
        return rows.select(*out).distinct().orderBy(*[b for _, b in pairs])
    return rows.orderBy("file", "line_no").select(*out)


# --- small reference tables -------------------------------------------------


def seed_dimension(current: DataFrame, seed: DataFrame, key: str = "domain_id") -> DataFrame:
    """Insert or update by key: seed values win, other columns and rows stay."""
    cur, new = current.alias("cur"), seed.alias("new")
    joined = cur.join(new, F.col(f"cur.{key}") == F.col(f"new.{key}"), "full_outer")
    out = [
        F.coalesce(F.col(f"new.{c}"), F.col(f"cur.{c}")).alias(c) if c in seed.columns else F.col(f"cur.{c}")
        for c in current.columns
    ]
    return joined.select(*out)
