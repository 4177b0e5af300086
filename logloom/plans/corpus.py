"""Query logs and companions derived from the given tables, as portable SQL.

The same text runs in Spark and in the checking engine.  Every derived table has
one row per row of its source, so its size follows the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def log_sql(source: str, query_id: str, pos: str, n: str, pick: str, note: str) -> str:
    """A 12-column query log.  n and pick are whole-number expressions that choose texts."""
    text = lambda e: f"CAST({e} AS VARCHAR(20))"
    return f"""
SELECT {query_id} AS query_id, {pos} AS pos,
  CASE WHEN {n} % 13 = 0 THEN 'New Query'
       WHEN {n} % 7 = 0 THEN concat('Copy of (#', {text(n)}, ') Copy of Daily DEX Volume')
       WHEN {n} % 5 = 0 THEN '  Top Uniswap Traders '
       WHEN {n} % 11 = 0 THEN CAST(NULL AS VARCHAR(1))
       ELSE concat('NFT Sales Breakdown V', {text(f"{pick} % 4")}) END AS name,
  CASE WHEN {n} % 4 = 0 THEN 'N/A' WHEN {n} % 4 = 1 THEN ' test ' WHEN {n} % 4 = 2 THEN ''
       ELSE concat(' about ', {note}) END AS description,
  CASE WHEN {pick} % 3 = 0 THEN '[]' ELSE '["dex","daily"]' END AS tags,
  {text(f"{n} % 3 + 1")} AS version,
  CASE WHEN {pick} % 6 = 0 THEN '[{{"key":"protocol","type":"text"}}]' ELSE '[]' END AS parameters,
  CASE WHEN {pick} % 3 = 0 THEN 'v1 Ethereum [deprecated]' WHEN {pick} % 3 = 1 THEN 'v2 SQL' ELSE 'v2 Spark SQL' END AS query_engine,
  CASE {pick} % 12
   WHEN 0 THEN concat('SELECT date_trunc(''day'', block_time) AS day, SUM(amount_usd) AS volume FROM dex.trades WHERE n > ', {text(f"{n} % 50")}, ' GROUP BY 1 ORDER BY 1')
   WHEN 1 THEN concat('SELECT project, COUNT(*) AS txs FROM "dex"."trades" t JOIN prices.usd p ON t.token = p.token GROUP BY project ORDER BY txs DESC LIMIT ', {text(f"{n} % 20")})
   WHEN 2 THEN '-- raw' || chr(10) || 'SELECT * FROM nft.trades'
   WHEN 3 THEN concat('WITH a AS (SELECT taker, SUM(x) AS s FROM DEX.trades GROUP BY 1) SELECT a.taker, s, row_number() OVER (ORDER BY s DESC) AS rk FROM a JOIN tokens.transfers b ON a.taker = b.taker JOIN prices.usd c ON b.t = c.t WHERE z < ', {text(f"{n} % 9")})
   WHEN 4 THEN concat('SELECT CASE WHEN v > ', {text(f"{n} % 30")}, ' THEN 1 ELSE 0 END AS big, COUNT(*) AS n FROM aave.borrows b JOIN prices.usd u ON b.a = u.a GROUP BY 1')
   WHEN 5 THEN 'SELECT COUNT(DISTINCT wallet) AS holders FROM erc20.evt_transfer /* multi' || chr(10) || ' line */ WHERE to IS NOT NULL'
   WHEN 6 THEN concat('SELECT block_time, hash FROM ethereum.transactions WHERE address = 0xab', {text(f"{n} % 10")}, ' ORDER BY block_time')
   WHEN 7 THEN 'select 1'
   WHEN 8 THEN ''
   WHEN 9 THEN CAST(NULL AS VARCHAR(1))
   WHEN 10 THEN concat('SELECT day, SUM(v) OVER (ORDER BY day) AS cum, {{{{protocol}}}} AS p FROM dex.trades a JOIN prices.usd b ON a.t=b.t JOIN tokens.transfers c ON a.t=c.t JOIN nft.trades d ON a.t=d.t JOIN aave.borrows e ON a.t=e.t WHERE q=', {text(f"{n} % 40")})
   ELSE concat('SELECT x FROM ns0.t0 JOIN ns1.t1 ON 1=1 JOIN dex.trades_v2 ON 1=1 JOIN ns3.swap_', {text(f"{n} % 6")}, ' ON 1=1 JOIN prices.usd ON 1=1 JOIN ns5.t5 ON 1=1 CROSS JOIN UNNEST(z) JOIN ns6.t6 ON 1=1 WHERE k=', {text(f"{n} % 5")}) END AS query_sql,
  CASE WHEN {n} % 9 = 0 THEN 'true' ELSE 'false' END AS is_private,
  'false' AS is_archived, 'false' AS is_unsaved,
  concat(' Owner', {text(f"{pick} % 17")}, ' ') AS owner
FROM {source}"""


# Tables that logs are made from.
LOG_SOURCES = {"orders", "events"}

# One query per order; ids are unique.
CORPUS = log_sql("orders", "o_orderkey", "o_orderkey", "o_orderkey", "o_custkey", "o_orderpriority")

# A log as it arrives: one query per event, ids repeat and some are missing.
ARRIVALS = log_sql(
    "events",
    "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR(20)) END",
    "event_id",
    "event_id",
    "(event_id + user_id)",
    "event_type",
)

# Table dictionary: one row per part.  Names meet those of the logs exactly, by
# namespace only, and by a shared word only.
TAXONOMY = """
SELECT p_partkey AS pos,
  CASE p_partkey % 7 WHEN 0 THEN 'dex' WHEN 1 THEN 'prices' WHEN 2 THEN '' WHEN 3 THEN ' NFT ' WHEN 4 THEN 'ethereum'
       WHEN 5 THEN CAST(NULL AS VARCHAR(1)) ELSE 'uniswap' END AS namespace,
  CASE p_partkey % 11 WHEN 0 THEN 'Trades' WHEN 1 THEN 'usd' WHEN 2 THEN 'evt_transfer'
       WHEN 3 THEN concat('swap_', CAST(p_size AS VARCHAR(20))) WHEN 4 THEN 'borrows_v2' WHEN 5 THEN 'all_transfers'
       ELSE concat('pool_', CAST(p_partkey % 40 AS VARCHAR(20))) END AS table_name,
  CASE p_size % 5 WHEN 0 THEN 'defi' WHEN 1 THEN 'nft' WHEN 2 THEN 'lending' WHEN 3 THEN 'infra' ELSE 'payments' END AS g1,
  concat('system_', lower(p_type)) AS g2,
  concat('action_', CAST(p_size % 9 AS VARCHAR(20))) AS g3
FROM part"""

# Labelled rows for the caps: one per part, in part order.
LABEL_ROWS = """
SELECT p_partkey + 1 AS pos, lower(p_brand) AS namespace, p_name AS table_name,
  CASE WHEN p_partkey % 17 = 0 THEN 'unknown' ELSE ' DeFi ' END AS g1,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE concat(lower(p_type), '_', replace(p_name, ' ', '_')) END AS g2,
  concat(replace(p_name, ' ', '_'), '_of_', lower(p_type), '_', CAST(p_size AS VARCHAR(20))) AS g3
FROM part"""

# A registry with tools from suppliers; ids `g1.g3`.
TOOLS = """
SELECT concat(g1, '.', g3) AS tool_id, g1, g2, g3, g4, g5, description, 'generic' AS scope, '[]' AS returns,
  'table' AS viz, inputs, usage_count, CAST(NULL AS TIMESTAMP) AS last_used_at
FROM (SELECT concat('g', CAST(s_nationkey % 4 AS VARCHAR(20))) AS g1, concat('m', CAST(s_nationkey AS VARCHAR(20))) AS g2,
        concat('tool ', s_name) AS g3, 'Ranked List' AS g4, concat('from ', s_name) AS g5,
        concat('Ranks rows of ', s_name) AS description, s_suppkey % 5 AS usage_count,
        concat('[{"key":"k', CAST(s_suppkey AS VARCHAR(20)), '","label":"K","type":"text","required":true,"default":null}]') AS inputs
      FROM supplier) s"""

# Source links of the registry: the parts a supplier delivers, as query ids.
LINK_ROWS = """
SELECT concat('g', CAST(s_nationkey % 4 AS VARCHAR(20)), '.tool ', s_name) AS tool_id, 'source' AS kind,
  CAST(l_partkey AS VARCHAR(20)) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
LINKS = LINK_ROWS.replace("SELECT", "SELECT DISTINCT", 1)

DISTINCT_ROWS = 500_000  # that one task compares

# Proposed tools, one per order; every third key is in the registry already.
NEW_TOOLS = """
SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE concat('g', CAST(s_nationkey % 4 AS VARCHAR(20))) END AS g1,
  concat('m', CAST(s_nationkey AS VARCHAR(20))) AS g2,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('tool ', s_name)
       ELSE concat('New Tool: ', CAST(o_custkey % 50 AS VARCHAR(20)), ' ', o_orderpriority) END AS g3,
  'Point Value' AS g4, concat('order ', CAST(o_orderkey AS VARCHAR(20))) AS g5,
  concat('Counts ', o_orderpriority) AS description, 'generic' AS scope, '[]' AS returns, 'table' AS viz, '[]' AS inputs,
  o_orderkey AS query_id
FROM (SELECT o.*, o_custkey % (SELECT count(*) FROM supplier) AS k FROM orders o) o JOIN supplier ON k = s_suppkey"""

# Batches of five orders, and a model's reply per batch as written by the SQL.
MEMBERS = """
SELECT o_orderkey AS query_id, CAST(floor(o_orderkey / 5.0) AS BIGINT) AS batch_id,
  CAST(o_orderkey % 5 + 1 AS INT) AS position, o_custkey, o_orderpriority FROM orders"""


class Inputs:
    """The given tables below one folder, and the tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def sql(self, text: str) -> DataFrame:
        """Run portable SQL over the given tables."""
        for name in TABLES:
            if name in text:
                rows = self.table(name)
                (self.spread(rows) if name in LOG_SOURCES else rows).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def spread(self, rows: DataFrame) -> DataFrame:
        """Sources of a log come as one small file here; their texts are made and
        scanned on all cores.  Large input has more splits than cores and stays as it is."""
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

    def links(self) -> DataFrame:
        """The rows of LINKS.  A table of few repeats is dealt out before it is made distinct, in parts that follow
        its size: otherwise each task would hold its whole split."""
        parts = max(1, math.ceil(self.table("lineitem").count() / DISTINCT_ROWS))
        # `kind` is a constant, which the optimizer takes out of the distinct; dealt out by it, rows would move twice
        return self.sql(LINK_ROWS).repartition(parts, "tool_id", "value").distinct()

    def corpus(self) -> DataFrame:
        return self.sql(CORPUS)

    def arrivals(self) -> DataFrame:
        return self.sql(ARRIVALS)
