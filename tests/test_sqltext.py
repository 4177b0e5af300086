"""Text rules on small cases typed by hand."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import sqltext as sx
from logloom.functions import text as tx
from logloom.operators import features as ft


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn("v").alias("r")).first()["r"]


@pytest.mark.parametrize(
    "sql, want",
    [
        ('SELECT * FROM "Dex"."Trades" JOIN dex.trades ON 1=1', ["dex.trades"]),
        ("select 1 from a.a", []),
        ('select 1 from "a"."a"', ["a.a"]),
        ("select 1 from trades join cat.ns.tbl on true", ["cat.ns.tbl"]),
        ("select 1 from dex.träde", ["dex.träde"]),
        (None, None),
    ],
)
def test_qualified_tables(spark, sql, want):
    assert one(spark, sql, sx.qualified_tables) == want


@pytest.mark.parametrize(
    "sql, want",
    [
        ("-- from x.y\nselect 1 FROM A.b join `c d` on 1 join A.b /* from z */", ["a.b", "c d", "a.b"]),
        ("select 1 from (select 2) join lateral f", []),
        ('select 1 from dex."Evt Swap"', ['dex."evt swap']),
        (None, []),
    ],
)
def test_ordered_tables(spark, sql, want):
    assert one(spark, sql, sx.ordered_tables) == want


def test_mentions_overlap(spark):
    assert one(spark, "select 1 from a.from b.c join \"D\".e", sx.mentions) == ["a.from", "b.c", "d.e"]


@pytest.mark.parametrize(
    "sql, want",
    [
        ("select a, b as c, t.d, sum(x), y z from t", "a|c|d|sum|z"),
        ("with q as (select p from r) select q.p, (select max(v) from w) as m from q", "p|m"),
        ("select x from a union all select y as yy from b", "yy"),
        ("select case when a then b end from t", None),
        ("select * from t", None),
        ("select count(*) filter (where f = 1) as n1, count(*) as n2\nfrom\tt", "n1|n2"),
        ("-- select q from z\nselect 1", None),
        ("delete from t", None),
    ],
)
def test_select_aliases(spark, sql, want):
    assert one(spark, sql, sx.select_alias_list) == want


@pytest.mark.parametrize(
    "sql, want",
    [
        ("select rank() over (order by x) from t", "leaderboard"),
        ("select a, sum(b) from t group by 1 order by 2 limit 5", "leaderboard"),
        ("select date_trunc('day', t), count(*) from t group by 1", "time_series"),
        ("select sum(x) over (order by t) from t", "time_series"),
        ("select case when a then 1 end, sum(b) from t group by 1", "breakdown"),
        ("select sum(b) from t", "scalar"),
        ("select a from t -- sum(b)", "raw"),
        ("", "raw"),
        (None, "scalar"),
    ],
)
def test_shape_v1(spark, sql, want):
    df = spark.createDataFrame([(sql,)], "query_sql string")
    assert ft.shape_v1(df).first()["g5"] == want


@pytest.mark.parametrize(
    "sql, want",
    [
        ("select a from t order by a desc limit 5", "leaderboard"),
        ("select a from t order by a\ndesc limit 5", "series"),
        ("select a from t where wallet = 0xab", "lookup"),
        ("select a, count(*) from t group by block_date", "time_series"),
        ("select a, count(*) from t group by a", "snapshot"),
        ("select a from t order by block_time desc", "series"),
        ("select a from t order by a desc", "time_series"),
        ("", "time_series"),
        (None, "time_series"),
    ],
)
def test_shape_v2(spark, sql, want):
    df = spark.createDataFrame([(sql,)], "query_sql string")
    assert ft.shape_v2(df).first()["g5"] == want


@pytest.mark.parametrize(
    "name, shape, want",
    [
        ("Uniswap V3 Pool Count by Fee Tier", "scalar", "pool_count_by_fee_tier_scalar"),
        ("Daily Time Series of Fees", "time_series", "daily_timeseries_of_fees_timeseries"),
        ("Volume time-series", "time_series", "volume_timeseries"),
        ("time series time series", "raw", "timeseries_timeseries_raw"),
        ("Holder Distribution", "breakdown", "holder_breakdown"),
        ("V2", "scalar", "_scalar"),
        ("  ", "raw", "generic_raw"),
        (None, "raw", "generic_raw"),
    ],
)
def test_name_slug(spark, name, shape, want):
    df = spark.createDataFrame([(name, shape)], "name string, g5 string")
    assert sx.add_name_slug(df).first()["g3"] == want


def test_cte_components(spark):
    sql = """WITH a AS (SELECT ')' AS x FROM t), b (c) AS MATERIALIZED (WITH n AS (SELECT 1) SELECT * FROM n)
    SELECT * FROM a -- end"""
    df = spark.createDataFrame([(1, sql), (2, "select 1"), (3, "with a as (select 1"), (4, None)], "query_id int, query_sql string")
    got = [tuple(r) for r in ft.cte_components(df).orderBy("query_id", "step_no").collect()]
    assert got == [
        (1, 0, "Step 'a'", "SELECT ')' AS x FROM t"),
        (1, 1, "Step 'b'", "WITH n AS (SELECT 1) SELECT * FROM n"),
        (1, 2, "Step 'n'", "SELECT 1"),
        (1, 3, "Finally", "SELECT * FROM a"),
        (2, 0, "Finally", "select 1"),
        (3, 0, "Query", "with a as (select 1"),
    ]
    labels = {r.query_id: r.label for r in ft.cte_components(df, "Final result").orderBy("step_no").collect()}
    assert labels == {1: "Final result", 2: "Query", 3: "Query"}


def test_small_texts(spark):
    assert one(spark, "  A b\tc ", tx.clean_label) == "a_b\tc"
    assert one(spark, "--Daily  DEX!", tx.slugify) == "daily-dex"
    assert one(spark, "The query counts rows", tx.strip_reply_prefix) == "Counts rows"
    assert one(spark, "the query counts rows", tx.strip_reply_prefix) == "the query counts rows"
    assert one(spark, "The SQL ", tx.strip_reply_prefix) == "The SQL"
    assert one(spark, "Top list", tx.contaminated) is True  # holds "op"
    assert one(spark, "a.b.c", sx.namespace_of) == "b"
    assert one(spark, "a", sx.namespace_of) == ""


def test_exact_tokenizer_plugs_in(spark):
    from pyspark.sql import types as T

    words = F.pandas_udf(lambda s: s.str.split().str.len(), T.LongType())
    df = spark.createDataFrame([("a b c", " "), (None, "d e")], "query_sql string, name string")
    got = {r.column: (r.tokens, r.share_pct) for r in ft.token_report(df, ["query_sql", "name"], words).collect()}
    assert got == {"query_sql": (3, 60.0), "name": (2, 40.0)}
