"""Queries over evaluation and exploration of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import explore as ex
from .catalog import query

PRED = """SELECT o_orderkey AS query_id, CASE o_custkey % 4 WHEN 0 THEN ' DeFi' WHEN 1 THEN 'nft' WHEN 2 THEN 'infra ' ELSE 'lending' END AS g1,
  concat('sys_', CAST(o_custkey % 12 AS VARCHAR(20))) AS g2, concat('tool_', CAST(o_custkey % 36 AS VARCHAR(20))) AS g3,
  CASE WHEN o_custkey % 9 = 0 THEN 'nft' ELSE concat('col_', CAST(o_orderkey % 5 AS VARCHAR(20))) END AS g4,
  CASE o_orderkey % 3 WHEN 0 THEN 'time_series' WHEN 1 THEN 'scalar' ELSE 'leaderboard' END AS g5 FROM orders"""
GOLD = """SELECT o_orderkey AS query_id, o_orderpriority AS name, 'defi' AS g1, concat('sys_', CAST(o_custkey % 12 AS VARCHAR(20))) AS g2,
  concat('tool_', CAST(o_custkey % 72 AS VARCHAR(20))) AS g3, concat('col_', CAST(o_orderkey % 10 AS VARCHAR(20))) AS g4, 'scalar' AS g5
FROM orders WHERE o_orderstatus = 'F'"""
BOTH = f"pred AS ({PRED}), gold AS ({GOLD}), pairs AS (SELECT p.*, q.g1 AS a1, q.g2 AS a2, q.g3 AS a3, q.g4 AS a4, q.g5 AS a5 FROM gold q JOIN pred p USING (query_id))"


def _pair(t):
    return t.sql(PRED), t.sql(GOLD)


@query(
    "label_accuracy",
    f"WITH {BOTH} "
    + " UNION ALL ".join(
        f"SELECT 'g{i}' AS label, count(*) FILTER (g{i} = a{i}) AS hits, count(*) AS total, round(count(*) FILTER (g{i} = a{i}) / count(*), 6) AS accuracy FROM pairs"
        for i in (3, 4, 5)
    ),
)
def _(t):
    return ev.label_accuracy(*_pair(t))


@query(
    "side_by_side",
    f"""WITH {BOTH} SELECT query_id, gold.name, {", ".join(f"gold.g{i} AS g{i}_actual, pred.g{i} AS g{i}" for i in range(1, 6))} FROM gold LEFT JOIN pred USING (query_id)""",
)
def _(t):
    return ev.side_by_side(*_pair(t))


RIGHT = "g3 = a3 AND g4 = a4"


@query(
    "coverage",
    f"WITH {BOTH} SELECT count(*) FILTER ({RIGHT}) AS hits, count(*) AS total, round(count(*) FILTER ({RIGHT}) / count(*), 6) AS coverage FROM pairs",
)
def _(t):
    return ev.coverage(*_pair(t))


@query(
    "coverage_misses",
    f"""WITH {BOTH}
SELECT query_id, a3 AS g3_actual, a4 AS g4_actual, g3, g4 FROM pairs WHERE NOT ({RIGHT})""",
)
def _(t):
    return ev.coverage_misses(*_pair(t))


@query(
    "toolbox_efficiency",
    f"""WITH {BOTH}, s AS (SELECT count(DISTINCT (g3, g4)) AS n FROM pred), c AS (SELECT count(*) FILTER ({RIGHT}) / count(*) AS c FROM pairs)
SELECT n AS toolbox_size, round(1 / log2(greatest(n, 2)), 6) AS efficiency, round(CASE WHEN n > 1 THEN round(c, 6) / log2(n) ELSE 0 END, 6) AS weighted FROM s, c""",
)
def _(t):
    covered = ev.coverage(*_pair(t)).select("coverage").scalar()
    return ev.toolbox_efficiency(t.sql(PRED), covered)


@query("label_distribution", f"""WITH p AS ({PRED}) SELECT g5 AS label, count(*) AS "count", round(count(*) / (SELECT count(*) FROM p) * 100, 4) AS pct FROM p GROUP BY 1""")
def _(t):
    return ev.label_distribution(t.sql(PRED), "g5")


@query(
    "label_distribution_domain",
    f"""WITH p AS ({PRED}) SELECT lower(trim(g1)) AS label, count(*) AS "count", round(count(*) / (SELECT count(*) FROM p) * 100, 4) AS pct FROM p GROUP BY 1""",
)
def _(t):
    return ev.label_distribution(t.sql(PRED).withColumn("domain", F.lower(F.trim("g1"))), "domain")


@query("top_labels", f"""WITH p AS ({PRED}) SELECT g3, count(*) AS "count" FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(t):
    return ev.top_labels(t.sql(PRED), ["g3"], 15)


@query("top_tools", f"""WITH p AS ({PRED}) SELECT g3, g5, count(*) AS "count" FROM p GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def _(t):
    return ev.top_labels(t.sql(PRED), ["g3", "g5"], 20)


# --- exploration ------------------------------------------------------------


@query("facet_options", f"SELECT DISTINCT g3 AS option FROM ({PRED}) p WHERE lower(trim(g1)) = 'defi' AND g2 = 'sys_4'")
def _(t):
    return ex.facet_options(t.sql(PRED), ["defi", "sys_4"])


@query(
    "drill_down",
    f"""SELECT query_id, lower(trim(g1)) AS g1, g2, g3, g5 FROM ({PRED}) p WHERE lower(trim(g1)) = 'infra' AND g2 = 'sys_2' AND g3 = 'tool_14' AND g5 = 'scalar'""",
)
def _(t):
    return ex.drill_down(t.sql(PRED), "infra", "sys_2", "tool_14", "scalar")


_STEPS = [f"CASE WHEN d >= {i} THEN '/' || g{i} ELSE '' END" for i in range(1, 6)]
_UPPER = [f"CASE WHEN d >= {i + 1} THEN '/' || g{i} ELSE '' END" for i in range(1, 5)]


@query(
    "taxonomy_tree",
    f"""WITH paths AS (SELECT DISTINCT g1, g2, g3, g4, g5 FROM ({PRED}) p),
nodes AS ({" UNION ALL ".join(f"SELECT {d} AS d, " + ", ".join(f"g{i}" if i <= d else f"NULL AS g{i}" for i in range(1, 6)) + ", count(*) AS value FROM paths" + (" GROUP BY " + ", ".join(f"g{i}" for i in range(1, d + 1)) if d else "") for d in range(6))})
SELECT d AS depth, 'root' || {" || ".join(_STEPS)} AS path, CASE WHEN d > 0 THEN 'root' || {" || ".join(_UPPER)} END AS parent,
  CASE d WHEN 0 THEN 'root' WHEN 1 THEN g1 WHEN 2 THEN g2 WHEN 3 THEN g3 WHEN 4 THEN g4 ELSE g5 END AS name, value FROM nodes""",
)
def _(t):
    return ex.taxonomy_tree(t.sql(PRED))


LONG = f"long AS ({' UNION ALL '.join(f'SELECT query_id, {i} AS i, g{i} AS label FROM ({PRED}) p' for i in range(1, 5))})"


@query(
    "label_cooccurrence",
    f"""WITH {LONG} SELECT a.label AS label_a, b.label AS label_b, count(*) AS "count" FROM long a JOIN long b USING (query_id)
WHERE a.i = b.i OR a.label <> b.label GROUP BY 1, 2""",
)
def _(t):
    return ex.label_cooccurrence(t.sql(PRED))


@query("label_occurrence", f"""SELECT g2 AS label_a, g2 AS label_b, count(*) AS "count" FROM ({PRED}) p GROUP BY 1""")
def _(t):
    return ex.label_cooccurrence(t.sql(PRED), "2")


@query("label_index", f"WITH {LONG} SELECT label, count(DISTINCT query_id) AS n_queries FROM long GROUP BY 1")
def _(t):
    return ex.label_index(t.sql(PRED))


@query("label_edges", f"WITH {LONG} SELECT DISTINCT query_id, label FROM long")
def _(t):
    return ex.label_edges(t.sql(PRED))


@query(
    "label_nodes",
    f"WITH {LONG} SELECT CAST(query_id AS VARCHAR) AS id, 'query' AS kind FROM ({PRED}) p UNION ALL SELECT DISTINCT 'g_' || label, 'label' FROM long",
)
def _(t):
    return ex.label_nodes(t.sql(PRED))
