"""Queries over the tool registry and the capped label vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import registry as rg
from .catalog import query
from .corpus import LABEL_ROWS, LINKS, NEW_TOOLS, TOOLS
from .matching import nearest_sql

FIELDS = ["g2", "g4", "g5", "description", "scope", "returns", "viz", "inputs"]
REG = f"tools AS ({TOOLS}), links AS ({LINKS}), new_tools AS ({NEW_TOOLS})"
FIRST_NEW = "fresh AS (SELECT * FROM new_tools WHERE trim(g1) <> '' AND trim(g3) <> '' QUALIFY row_number() OVER (PARTITION BY trim(g1), trim(g3) ORDER BY pos) = 1)"


def _new(t):
    rows = t.sql(NEW_TOOLS)
    ids = F.array(F.col("query_id").cast("string"))
    # every fifth proposal also names two tools it combines
    combined = F.when(F.col("pos") % 5 == 0, F.array(F.lit("a.x"), F.concat(F.lit("b."), "g2"))).otherwise(
        F.array().cast("array<string>")
    )
    return rows.withColumns({"source_query_ids": ids, "combines": combined})


@query(
    "merge_tools",
    f"""WITH {REG}, {FIRST_NEW}
SELECT coalesce(t.tool_id, n.g1 || '.' || n.g3) AS tool_id, coalesce(t.g1, n.g1) AS g1, coalesce(t.g3, n.g3) AS g3,
  {", ".join(f"CASE WHEN t.tool_id IS NOT NULL THEN t.{c} ELSE n.{c} END AS {c}" for c in FIELDS)}
FROM tools t FULL JOIN fresh n ON t.g1 = n.g1 AND t.g3 = n.g3""",
)
def _(t):
    tools = t.sql(TOOLS).drop("usage_count", "last_used_at")
    return rg.merge_tools(tools, _new(t))


@query(
    "merge_links",
    f"""WITH {REG}, valid AS (SELECT *, trim(g1) || '.' || trim(g3) AS tool_id FROM new_tools WHERE trim(g1) <> '' AND trim(g3) <> '')
SELECT tool_id, kind, value FROM links
UNION SELECT tool_id, 'source', CAST(query_id AS VARCHAR) FROM valid
UNION SELECT tool_id, 'combines', 'a.x' FROM valid WHERE pos % 5 = 0
UNION SELECT tool_id, 'combines', 'b.' || g2 FROM valid WHERE pos % 5 = 0""",
)
def _(t):
    return rg.merge_links(t.sql(TOOLS), t.links(), _new(t))


SLUG = "trim(regexp_replace(lower(n.g3), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    "upsert_by_g3",
    f"""WITH {REG}, fresh AS (SELECT * FROM new_tools QUALIFY row_number() OVER (PARTITION BY g3 ORDER BY pos) = 1)
SELECT coalesce(t.tool_id, {SLUG}) AS tool_id, coalesce(t.g3, n.g3) AS g3, coalesce(t.description, n.g5) AS description,
  {", ".join(f"coalesce(t.{c}, n.{c}) AS {c}" for c in ["g1", "g2", "g4", "g5", "inputs"])}
FROM tools t FULL JOIN fresh n ON t.g3 = n.g3""",
)
def _(t):
    return rg.upsert_by_g3(t.sql(TOOLS), t.sql(NEW_TOOLS))


@query(
    "upsert_links",
    f"""WITH {REG} SELECT tool_id, kind, value FROM links
UNION SELECT coalesce(t.tool_id, {SLUG}), 'source', CAST(n.query_id AS VARCHAR) FROM new_tools n LEFT JOIN tools t ON t.g3 = n.g3""",
)
def _(t):
    return rg.upsert_links(t.sql(TOOLS), t.links(), t.sql(NEW_TOOLS))


COUNTED = "counts AS (SELECT tool_id, count(*) AS n FROM links WHERE kind = 'source' GROUP BY 1)"


@query(
    "registry_listing",
    f"""WITH {REG}, {COUNTED} SELECT tool_id, g3, g4, description, inputs, coalesce(n, 0) AS source_count,
  '{{"g3":"' || g3 || '","g4":"' || g4 || '","description":"' || description || '"}}' AS slim
FROM tools LEFT JOIN counts USING (tool_id)""",
)
def _(t):
    return rg.registry_listing(t.sql(TOOLS), t.links())


@query("find_by_g3", f"WITH {REG} SELECT tool_id, g1, g3 FROM tools WHERE g3 = 'tool Supplier#000000007' ORDER BY tool_id LIMIT 1")
def _(t):
    return rg.find_by_g3(t.sql(TOOLS), "tool Supplier#000000007").select("tool_id", "g1", "g3")


DOMAINS = "SELECT c_custkey AS domain_id, c_name AS name, c_mktsegment AS description FROM customer"


@query("domains_listing", f"SELECT name, description FROM ({DOMAINS}) d ORDER BY domain_id")
def _(t):
    return rg.domains_listing(t.sql(DOMAINS))


USAGE = """SELECT concat('g', CAST(s_nationkey % 4 AS VARCHAR(20)), '.tool ', s_name) AS tool_id, ts AS used_at
FROM events JOIN supplier ON user_id = s_suppkey"""


@query(
    "apply_usage",
    f"""WITH {REG}, used AS (SELECT tool_id, count(*) AS n, max(used_at) AS last FROM ({USAGE}) GROUP BY 1)
SELECT tool_id, usage_count + coalesce(n, 0) AS usage_count, coalesce(strftime(greatest(last_used_at, last), '%Y-%m-%d %H:%M:%S'), 'never') AS last_used
FROM tools LEFT JOIN used USING (tool_id)""",
)
def _(t):
    rows = rg.apply_usage(t.sql(TOOLS), t.sql(USAGE))
    last = F.coalesce(F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss"), F.lit("never"))
    return rows.select("tool_id", "usage_count", last.alias("last_used"))


@query(
    "popularity",
    f"""WITH {REG}, {COUNTED} SELECT tool_id, round(0.6 * ln(usage_count + 1) + 0.4 * ln(coalesce(n, 0) + 1), 6) AS popularity
FROM tools LEFT JOIN counts USING (tool_id)""",
)
def _(t):
    return rg.popularity(t.sql(TOOLS), t.links())


@query(
    "tool_json",
    f"""WITH {REG} SELECT tool_id, '{{"tool_id":"' || tool_id || '","name":"' || g3 || '","description":"' || description || '","inputs":' || inputs || '}}' AS node FROM tools""",
)
def _(t):
    return rg.tool_json(t.sql(TOOLS))


SOURCE_JSON = """SELECT o_orderkey AS pos, concat('["', CAST(o_custkey % 7 AS VARCHAR(20)), '","', CAST(o_custkey % 5 AS VARCHAR(20)), '"]') AS ids,
  CAST(o_orderkey % 7 AS VARCHAR(20)) AS query_id FROM orders"""


@query(
    "add_source_query",
    f"""SELECT pos, CASE WHEN contains(ids, '"' || query_id || '"') THEN ids ELSE replace(ids, ']', ',"' || query_id || '"]') END AS ids
FROM ({SOURCE_JSON}) s""",
)
def _(t):
    return t.sql(SOURCE_JSON).select("pos", rg.add_source_query(F.col("ids"), F.col("query_id")).alias("ids"))


# --- labels -----------------------------------------------------------------

# Labels in use before: from customers for g3, from suppliers for g2.
REGISTRY = """SELECT DISTINCT 'g3' AS kind, concat('segment_', lower(c_mktsegment), '_', CAST(c_nationkey AS VARCHAR(20))) AS label FROM customer
UNION SELECT DISTINCT 'g2' AS kind, concat('economy_', CAST(s_nationkey AS VARCHAR(20))) AS label FROM supplier"""
BATCH = 25


def _layer(layer, cap):
    fallback = lb.FALLBACK[layer]
    return f"""{layer}_known AS (SELECT DISTINCT label FROM registry WHERE kind = '{layer}'),
{layer}_first AS (SELECT coalesce(trim(lower({layer})), '{fallback}') AS label, min(pos) AS pos FROM rows GROUP BY 1),
{layer}_new AS (SELECT label, pos FROM {layer}_first WHERE label NOT IN (SELECT label FROM {layer}_known)
  QUALIFY row_number() OVER (ORDER BY pos) <= {cap} - (SELECT count(*) FROM {layer}_known)),
{layer}_final AS (SELECT label FROM {layer}_known UNION SELECT label FROM {layer}_new),
{layer}_out AS (SELECT label FROM {layer}_first WHERE label NOT IN (SELECT label FROM {layer}_final)),
{layer}_moved AS ({nearest_sql(f"{layer}_out", f"{layer}_final")})"""


BASE = f"rows AS ({LABEL_ROWS}), registry AS ({REGISTRY}), {_layer('g2', lb.CAPS['g2'])}, {_layer('g3', lb.CAPS['g3'])}"


@query(
    "admit_labels",
    f"""WITH {BASE} SELECT r.pos, namespace, table_name,
  CASE WHEN trim(lower(g1)) IN ({", ".join(f"'{g}'" for g in lb.G1_LABELS)}) THEN trim(lower(g1)) ELSE '{lb.FALLBACK["g1"]}' END AS g1,
  coalesce(m2.nearest, trim(lower(g2)), '{lb.FALLBACK["g2"]}') AS g2, coalesce(m3.nearest, trim(lower(g3)), '{lb.FALLBACK["g3"]}') AS g3
FROM rows r LEFT JOIN g2_moved m2 ON m2.label = coalesce(trim(lower(g2)), '{lb.FALLBACK["g2"]}')
LEFT JOIN g3_moved m3 ON m3.label = coalesce(trim(lower(g3)), '{lb.FALLBACK["g3"]}')""",
)
def _(t):
    return lb.admit_labels(t.sql(LABEL_ROWS), t.sql(REGISTRY))


def _new_per_batch(layer):
    return f"(SELECT count(*) FROM {layer}_new n WHERE (n.pos - 1) // {BATCH} = b.batch_no) AS new_{layer}"


BATCHES = f"""{BASE}, sizes AS (SELECT (pos - 1) // {BATCH} AS batch_no, count(*) AS n_rows FROM rows GROUP BY 1),
fresh AS (SELECT b.*, {_new_per_batch('g2')}, {_new_per_batch('g3')} FROM sizes b),
batches AS (SELECT *, sum(n_rows) OVER w - n_rows AS start,
  (SELECT count(*) FROM g2_known) + sum(new_g2) OVER w - new_g2 AS g2_used, (SELECT count(*) FROM g3_known) + sum(new_g3) OVER w - new_g3 AS g3_used,
  batch_no - coalesce(max(CASE WHEN new_g2 > 0 THEN batch_no END) OVER w, -1) AS stall_g2,
  batch_no - coalesce(max(CASE WHEN new_g3 > 0 THEN batch_no END) OVER w, -1) AS stall_g3
  FROM fresh WINDOW w AS (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _batches(t):
    rows = t.sql(LABEL_ROWS).withColumn("batch_no", F.floor((F.col("pos") - 1) / BATCH))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return lb.batch_labels(rows, t.sql(REGISTRY), block=16), total


@query(
    "stall_runs",
    f"WITH {BATCHES} SELECT batch_no, stall_g2, stall_g2 >= 3 AS g2_stalled, stall_g3, stall_g3 >= 3 AS g3_stalled FROM batches",
)
def _(t):
    return lb.stall_runs(_batches(t)[0])


def _pressure(layer):
    ratio = f"{layer}_used / {lb.CAPS[layer]} / greatest(done, 0.01)"
    p = lb.PRESSURE
    return f"CASE WHEN {ratio} > 1.5 THEN '{p['over']}' WHEN {ratio} < 0.5 THEN '{p['under']}' ELSE '{p['ok']}' END AS {layer}_pressure"


@query(
    "label_quota",
    f"""WITH {BATCHES}, q AS (SELECT *, (SELECT count(*) FROM rows) - start AS remain, greatest(0, 225 - g2_used) AS r2, greatest(0, 1275 - g3_used) AS r3,
  coalesce(lag(stall_g3) OVER (ORDER BY batch_no), 0) AS before FROM batches),
s AS (SELECT *, n_rows / greatest(remain, n_rows) AS share, greatest(0.01, 1.0 - remain / greatest(remain + n_rows, 1)) AS done FROM q),
u AS (SELECT *, least(greatest(1, round_even(r3 * share, 0)), r3) AS base FROM s)
SELECT batch_no, CAST(g2_used AS BIGINT) AS g2_used, CAST(r2 AS BIGINT) AS g2_remaining, CAST(g3_used AS BIGINT) AS g3_used, CAST(r3 AS BIGINT) AS g3_remaining,
  CAST(least(floor(r2 * share), r2) AS BIGINT) AS min_new_g2,
  CAST(CASE WHEN before >= 3 THEN least(greatest(base, 3), r3) WHEN r3 > 0 THEN greatest(base, 1) ELSE 0 END AS BIGINT) AS min_new_g3,
  CAST(greatest(0, remain - n_rows) AS BIGINT) AS rows_remaining, {_pressure('g2')}, {_pressure('g3')} FROM u""",
)
def _(t):
    return lb.label_quota(*_batches(t))


@query(
    "coverage_check",
    f"""WITH {BATCHES}, e AS (SELECT *, start / (SELECT count(*) FROM rows) * 225 AS e2, start / (SELECT count(*) FROM rows) * 1275 AS e3 FROM batches)
SELECT batch_no, CAST(g2_used AS BIGINT) AS g2_used, round(e2, 4) AS g2_expected, CAST(g3_used AS BIGINT) AS g3_used, round(e3, 4) AS g3_expected,
  g2_used / greatest(e2, 1) > 1.5 AS g2_over, g2_used / greatest(e2, 1) < 0.5 AS g2_under, g3_used / greatest(e3, 1) < 0.5 AS g3_under
FROM e WHERE start > 0""",
)
def _(t):
    return lb.coverage_check(*_batches(t))
