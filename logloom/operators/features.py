"""Feature columns of a query log, one operator per feature."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as sx
from ..functions.text import blank, col


def tables_qualified(df: DataFrame) -> DataFrame:
    return df.withColumn("tables", sx.qualified_tables("query_sql"))


def tables_ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("tables", sx.ordered_tables("query_sql"))


def tables_simple(df: DataFrame) -> DataFrame:
    return df.withColumn("tables", sx.simple_tables("query_sql"))


def table_count(df: DataFrame) -> DataFrame:
    return df.withColumn("table_count", sx.distinct_ref_count("query_sql"))


def split_name(df: DataFrame, name: str = "full_name") -> DataFrame:
    return df.withColumns(
        {"namespace": sx.namespace_of(name), "table": sx.table_of(name), "prefix": sx.prefix_of(name)}
    )


def statement_features(df: DataFrame) -> DataFrame:
    """Statement kind, UNNEST flag and sorted table set; rows without SQL are dropped."""
    return df.filter(~blank("query_sql")).withColumns(
        {
            "intent_type": sx.intent_type("query_sql"),
            "has_unnest": sx.has_unnest("query_sql"),
            "tables": F.sort_array(F.array_distinct(sx.ordered_tables("query_sql"))),
        }
    )


def cte_components(df: DataFrame, last_label: str = "Finally") -> DataFrame:
    """One row per step of a statement, in order."""
    parts = df.select("query_id", sx.cte_parts("query_sql", last_label).alias("_parts"))
    return parts.select("query_id", F.posexplode("_parts").alias("_at", "_p")).select(
        "query_id", F.col("_at").cast("long").alias("step_no"), "_p.label", "_p.fragment"
    )


def shape_flags(df: DataFrame) -> DataFrame:
    return sx.add_shape_flags(df)


def shape_v1(df: DataFrame) -> DataFrame:
    return sx.add_shape_v1(df)


def shape_v2(df: DataFrame) -> DataFrame:
    return sx.add_shape_v2(df)


def select_aliases(df: DataFrame) -> DataFrame:
    """g4: output names of the outer SELECT, or the shape where there are none."""
    rows = sx.add_shape_v1(df, "_shape").withColumn("_names", sx.select_alias_list("query_sql"))
    return rows.withColumn("g4", F.coalesce("_names", "_shape")).drop("_names", "_shape")


def name_slug(df: DataFrame) -> DataFrame:
    return sx.add_name_slug(sx.add_shape_v1(df, "_shape"), shape="_shape").drop("_shape")


def est_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("est_tokens", sx.est_tokens("query_id", "name", "query_sql"))


def quarter_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4))


REPORT_COLUMNS = ["query_sql", "name", "description", "tags", "parameters"]
RATES = {"input at 2.50": 2.50, "input at 3.00": 3.00}


def token_totals(
    df: DataFrame, cols: Sequence[str] = REPORT_COLUMNS, counter: Callable[[Column], Column] = quarter_tokens
) -> DataFrame:
    """One row with a token sum per column.  `counter` maps a text column to a
    count; an exact tokenizer goes in as a pandas UDF."""
    return df.agg(
        *[
            F.coalesce(F.sum(F.when(~blank(c), counter(col(c)))), F.lit(0)).cast("long").alias(c)
            for c in cols
        ]
    )


def token_report(
    df: DataFrame, cols: Sequence[str] = REPORT_COLUMNS, counter: Callable[[Column], Column] = quarter_tokens
) -> DataFrame:
    """Tokens and share per text column; columns without tokens are dropped."""
    totals = token_totals(df, cols, counter)
    whole = sum((F.col(c) for c in cols), F.lit(0))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("tokens")) for c in cols])
    rows = totals.select(whole.alias("_total"), F.inline(cells))
    return rows.filter("tokens > 0").select(
        "column", "tokens", F.round(F.col("tokens") / F.col("_total") * 100, 4).alias("share_pct")
    )


def token_cost(
    df: DataFrame,
    rates: dict[str, float] = RATES,
    cols: Sequence[str] = REPORT_COLUMNS,
    counter: Callable[[Column], Column] = quarter_tokens,
) -> DataFrame:
    """Cost of all tokens at each price per million."""
    total = sum((F.col(c) for c in cols), F.lit(0)).alias("total_tokens")
    prices = F.array(
        *[F.struct(F.lit(k).alias("rate"), F.lit(float(v)).alias("per_million")) for k, v in rates.items()]
    )
    rows = token_totals(df, cols, counter).select(total, F.inline(prices))
    return rows.withColumn("cost", F.round(F.col("total_tokens") / 1e6 * F.col("per_million"), 6))
