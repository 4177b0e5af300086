"""Which queries belong to which popular table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext as sx
from ..functions.text import computed
from ..session import held, small_side
from .incremental import remaining


def reference_map(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """(ref, full_name, ns, cut): which popular tables a reference means.

    The name has no end anchor: ``dex.trades`` is also found in
    ``dex.trades_v2``.  So a reference means the popular tables that equal one of
    its prefixes.  Prefixes are formed once per distinct reference, which is a
    dictionary-sized table, and matched by equality; no query is compared with
    each table.
    """
    return _meanings(queries.select(F.explode(sx.mentions("query_sql")).alias("ref")).distinct(), tables)


def _meanings(refs: DataFrame, tables: DataFrame) -> DataFrame:
    name = F.substring_index("ref", ".", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, F.lit(1), i))
    wanted = tables.select(
        F.lower("namespace").alias("ns"), F.lower(F.col("table")).alias("cut"), "full_name"
    ).distinct()
    parts = refs.select("ref", F.substring_index("ref", ".", 1).alias("ns"), F.explode(cuts).alias("cut"))
    return parts.join(wanted, ["ns", "cut"]).select("ref", "full_name", "ns", "cut")


def _matched(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows x the popular tables they mention, each table once per row.

    The mapping is held and counted, and broadcast if it is small; rows then stay
    where they are.  Two references of a row may mean the same table: the first
    of them is kept, which the row decides from its own list, without a shuffle.
    """
    return _found(computed(rows, _refs=sx.mentions("query_sql")), mapping)


def _found(named: DataFrame, mapping: DataFrame) -> DataFrame:
    columns = [c for c in named.columns if c != "_refs"]
    hits = named.select(*columns, "_refs", F.explode("_refs").alias("ref")).join(small_side(mapping), "ref")
    target = F.concat(F.col("ns"), F.lit("."), F.col("cut"))
    first = F.try_element_at(F.filter("_refs", lambda r: F.startswith(r, target)), F.lit(1))
    return hits.filter(F.col("ref") == first).select(*columns, "full_name")


def mentions_table(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """(query_id, full_name): the query has FROM / JOIN namespace.table."""
    rows = queries.select("query_id", "query_sql")
    return _matched(rows, reference_map(queries, tables)).drop("query_sql")


def _candidates(queries: DataFrame, max_len: int | None) -> DataFrame:
    rows = queries.filter(F.col("query_sql").isNotNull())
    return rows if max_len is None else rows.filter(F.length("query_sql") <= max_len)


def _route(
    queries: DataFrame,
    popular: DataFrame,
    multi: bool,
    max_len: int | None,
    seen: DataFrame | None,
) -> DataFrame:
    n = sx.distinct_ref_count("query_sql")
    rows = _candidates(queries, max_len).filter(n > 1 if multi else n == 1)
    if seen is not None:
        rows = remaining(rows, seen)
    return _matched(rows, reference_map(queries, popular))


def route_single(
    queries: DataFrame, popular: DataFrame, max_len: int | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """Queries that use only this one table, with its full_name."""
    return _route(queries, popular, False, max_len, seen)


def route_multi(
    queries: DataFrame, popular: DataFrame, max_len: int | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """Queries that use this table and another; one row per popular table."""
    return _route(queries, popular, True, max_len, seen)


def route_summary(single: DataFrame, multi: DataFrame) -> DataFrame:
    """Rows per table and mode; tables with none do not appear."""
    both = single.select("full_name", F.lit(1).alias("s"), F.lit(0).alias("m")).unionByName(
        multi.select("full_name", F.lit(0).alias("s"), F.lit(1).alias("m"))
    )
    return both.groupBy("full_name").agg(F.sum("s").alias("n_single"), F.sum("m").alias("n_multi"))


def route_counts(
    queries: DataFrame, popular: DataFrame, max_len: int | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """`route_summary` of both modes from one pass over the log.

    The pass writes (references, several) of each query that names a table, without its text; the
    dictionary of references and the counts are read from there.
    """
    rows = _candidates(queries, max_len)
    if seen is not None:
        rows = remaining(rows, seen)
    parsed = computed(rows, _refs=sx.mentions("query_sql"), _n=sx.distinct_ref_count("query_sql"))
    parsed = held(parsed.filter(F.col("_n") > 0).select("_refs", (F.col("_n") > 1).alias("several")))
    mapping = _meanings(parsed.select(F.explode("_refs").alias("ref")).distinct(), popular)
    return (
        _found(parsed, mapping)
        .groupBy("full_name")
        .agg(F.count_if(~F.col("several")).alias("n_single"), F.count_if("several").alias("n_multi"))
    )


# Named sets of tables whose signals combine (fixed values).
COMPOSITE_GROUPS = {
    "whale_accumulation": [("prices", "usd"), ("tokens", "transfers"), ("tokens", "balances")],
    "price_volume_div": [("prices", "usd"), ("dex", "trades")],
    "protocol_health": [("dex", "trades"), ("prices", "usd"), ("tokens", "transfers")],
    "wallet_classifier": [("tokens", "transfers"), ("gas", "fees"), ("transactions", "v2")],
    "wash_trading": [("nft", "trades"), ("prices", "usd"), ("tokens", "transfers")],
    "liquidation_cascade": [("aave", "borrows"), ("prices", "usd")],
    "mev_price_impact": [("dex", "trades"), ("sandwich", "transactions")],
    "lending_health": [("aave", "borrows"), ("aave", "repays"), ("prices", "usd")],
    "nft_wash_detector": [("nft", "trades"), ("tokens", "transfers")],
    "cross_chain_arb": [("dex", "trades"), ("bridge", "transfers")],
    "retention_revenue": [("dex", "trades"), ("tokens", "balances"), ("prices", "usd")],
    "bot_vs_human": [("transactions", "v2"), ("gas", "fees"), ("dex", "trades")],
}


def composite_members(spark, groups: dict[str, list[tuple[str, str]]] = COMPOSITE_GROUPS) -> DataFrame:
    rows = [
        (group, i, namespace, table, f"{namespace}.{table}")
        for group, tables in groups.items()
        for i, (namespace, table) in enumerate(tables)
    ]
    schema = "group_name string, member_no int, namespace string, `table` string, full_name string"
    return spark.createDataFrame(rows, schema)


def sample_composites(
    queries: DataFrame, members: DataFrame, k: int = 40, seed: str = "0", done: DataFrame | None = None
) -> DataFrame:
    """k multi-table queries per table in md5(seed, id) order, joined to the groups
    the table is a member of; a query stays under its first member only.

    The sample is per table, not per group: ``row_number <= k`` is cut inside
    each input partition first, so a hot table sends k rows per partition.
    """
    if done is not None:
        members = members.join(done.select("group_name"), "group_name", "left_anti")
    multi = queries.filter(F.col("query_sql").isNotNull() & (sx.distinct_ref_count("query_sql") > 1))
    tables = members.select("namespace", "table", "full_name").distinct()
    order = F.md5(F.concat(F.lit(seed), F.col("query_id").cast("string")))
    by_table = Window.partitionBy("full_name").orderBy(order, "query_id")
    sample = (
        mentions_table(multi, tables)
        .withColumn("_r", F.row_number().over(by_table))
        .filter(F.col("_r") <= k)
        .drop("_r")
    )
    placed = sample.join(members.select("group_name", "member_no", "full_name"), "full_name")
    return placed.groupBy("group_name", "query_id").agg(
        F.min("member_no").alias("member_no"), F.min_by("full_name", "member_no").alias("full_name")
    )
