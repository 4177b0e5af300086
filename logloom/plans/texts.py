"""Queries over SQL-text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext as sx
from ..functions import text as tx
from ..operators import features as ft
from .catalog import query
from .corpus import CORPUS, TOOLS
from .ingesting import STRIP
from .popularity import REF, SIMPLE

LOG = f"WITH corpus AS ({CORPUS})"
NO_COMMENT = "regexp_replace(regexp_replace(query_sql, '--[^\\n]*', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g')"
JOINED = "array_to_string({}, ',')"


def joined(name="tables"):
    return F.array_join(name, ",").alias("tables")


@query(
    "tables_qualified",
    f"""{LOG} SELECT query_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(
  regexp_extract_all(query_sql, '{REF}', 1), lambda x: length(x) > 3), lambda x: lower(replace(x, '"', '')))), 'ASC'), ',') AS tables
FROM corpus""",
)
def _(t):
    rows = ft.tables_qualified(t.corpus())
    return rows.select("query_id", joined(F.sort_array("tables")))


ORDERED_SQL = (
    "list_filter(list_transform(regexp_extract_all(lower(" + NO_COMMENT + "), "
    "'(?:from|join)\\s+((?:[a-z_][a-z0-9_\\-]*\\.)?(?:\"[^\"]+\"|`[^`]+`|[a-z_][a-z0-9_]*))', 1), "
    "lambda x: trim(trim(x, '\"'), '`')), lambda x: x NOT IN ("
    + ", ".join(f"'{w}'" for w in sx.NOT_TABLES)
    + "))"
)


@query("tables_ordered", f"{LOG} SELECT query_id, coalesce(array_to_string({ORDERED_SQL}, ','), '') AS tables FROM corpus")
def _(t):
    return ft.tables_ordered(t.corpus()).select("query_id", joined())


@query(
    "tables_simple",
    f"{LOG} SELECT query_id, coalesce(array_to_string(regexp_extract_all(lower(query_sql), '{SIMPLE}', 1), ','), '') AS tables FROM corpus",
)
def _(t):
    return ft.tables_simple(t.corpus()).select("query_id", joined())


@query(
    "table_count",
    f"{LOG} SELECT query_id, coalesce(len(list_distinct(regexp_extract_all(query_sql, '{REF}', 1))), 0) AS table_count FROM corpus",
)
def _(t):
    return ft.table_count(t.corpus()).select("query_id", F.col("table_count").cast("long").alias("table_count"))


@query(
    "split_name",
    f"""{LOG}, hits AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query_sql), '{SIMPLE}', 1))) AS full_name FROM corpus)
SELECT query_id, full_name, coalesce(list_extract(string_split(full_name, '.'), -2), '') AS namespace,
  list_extract(string_split(full_name, '.'), -1) AS "table", string_split(full_name, '.')[1] AS prefix FROM hits""",
)
def _(t):
    names = F.explode(F.array_distinct(sx.simple_tables("query_sql"))).alias("full_name")
    return ft.split_name(t.corpus().select("query_id", names))


@query("strip_comments", f"{LOG} SELECT query_id, {NO_COMMENT} AS bare FROM corpus")
def _(t):
    return t.corpus().select("query_id", sx.strip_comments("query_sql").alias("bare"))


@query(
    "statement_features",
    f"""{LOG}, f AS (SELECT query_id, upper(regexp_extract({NO_COMMENT}, '([a-zA-Z]+)', 1)) AS w,
  regexp_matches({NO_COMMENT}, '(?i)\\bunnest\\s*\\(') AS has_unnest,
  array_to_string(list_sort(list_distinct({ORDERED_SQL})), ',') AS tables FROM corpus WHERE trim(query_sql) <> '')
SELECT query_id, CASE WHEN w = 'WITH' THEN 'SELECT' ELSE w END AS intent_type, has_unnest, tables FROM f""",
)
def _(t):
    return ft.statement_features(t.corpus()).select("query_id", "intent_type", "has_unnest", joined())


# Only one kind of statement in the corpus has a WITH, so its step is cut out by a pattern.
STEPS = f"""bare AS (SELECT query_id, {STRIP(NO_COMMENT)} AS b FROM corpus WHERE query_sql IS NOT NULL),
steps AS (SELECT query_id, CAST(0 AS BIGINT) AS step_no, 'Step ''a''' AS label, regexp_extract(b, '^WITH a AS \\((.* GROUP BY 1)\\) SELECT', 1) AS fragment
  FROM bare WHERE starts_with(b, 'WITH a')
  UNION ALL SELECT query_id, CASE WHEN starts_with(b, 'WITH a') THEN 1 ELSE 0 END, 'Finally',
  regexp_replace(b, '^WITH a AS \\(.* GROUP BY 1\\) SELECT', 'SELECT') FROM bare)"""


@query("cte_components", f"{LOG}, {STEPS} SELECT * FROM steps")
def _(t):
    return ft.cte_components(t.corpus())


BARE = f"lower({NO_COMMENT})"
FLAGS = {
    "has_rank": "\\b(rank|row_number|dense_rank|ntile)\\s*\\(",
    "has_limit": "\\blimit\\b",
    "has_order": "\\border\\s+by\\b",
    "has_time_trunc": "\\b(date_trunc|time_bucket)\\b",
    "has_group": "\\bgroup\\s+by\\b",
    "has_agg": "\\b(sum|count|avg|max|min)\\s*\\(",
    "has_window": "\\bover\\s*\\(",
    "has_case": "\\bcase\\b",
    "has_filter_agg": "\\bfilter\\s*\\(\\s*where\\b",
    "is_star": "^\\s*select\\s+\\*",
}
FLAG_SQL = ", ".join(f"coalesce(regexp_matches({BARE}, '{rx}'), false) AS {n}" for n, rx in FLAGS.items())
SHAPED = f"""{LOG}, flags AS (SELECT *, {FLAG_SQL} FROM corpus),
shaped AS (SELECT *, CASE WHEN query_sql IS NULL THEN 'scalar'
  WHEN has_rank OR (has_order AND has_limit AND has_agg) THEN 'leaderboard'
  WHEN has_time_trunc AND has_group THEN 'time_series' WHEN has_window AND has_agg THEN 'time_series'
  WHEN (has_case OR has_filter_agg) AND has_group AND has_agg THEN 'breakdown'
  WHEN has_agg THEN 'scalar' ELSE 'raw' END AS g5 FROM flags)"""


@query("shape_flags", f"{SHAPED} SELECT query_id, {', '.join(FLAGS)} FROM flags")
def _(t):
    return ft.shape_flags(t.corpus()).select("query_id", *sx.SHAPE_FLAGS)


@query("shape_v1", f"{SHAPED} SELECT query_id, g5 FROM shaped")
def _(t):
    return ft.shape_v1(t.corpus()).select("query_id", "g5")


SHAPE_V2_SQL = """CASE WHEN coalesce(query_sql, '') IN ('', 'nan') THEN 'time_series'
  WHEN regexp_matches(q, 'order\\s+by\\s+.*\\bdesc\\b') AND regexp_matches(q, '\\blimit\\b\\s+\\d+')
    AND NOT regexp_matches(q, '(?s)group\\s+by.*(date|day|week|month|hour|time|minute|year|quarter)')
    AND NOT (contains(q, 'date_trunc') OR contains(q, 'date_format')) THEN 'leaderboard'
  WHEN regexp_matches(q, '(?s)where.*(address|wallet|owner)\\s*(=|in)\\s*(0x|''0x|\\{\\{)') AND NOT contains(q, 'group by') THEN 'lookup'
  WHEN regexp_matches(q, '(?s)group\\s+by.*(date|day|week|month|hour|time|minute|year|quarter)')
    OR contains(q, 'date_trunc') OR contains(q, 'date_format')
    OR regexp_matches(q, '(?s)select.*(date_trunc|date_format|to_date|from_unixtime)') THEN 'time_series'
  WHEN contains(q, 'group by') THEN 'snapshot'
  WHEN regexp_matches(q, 'order\\s+by\\s+.*(time|block_number|timestamp)') THEN 'series'
  WHEN NOT regexp_matches(q, 'order\\s+by\\s+.*\\bdesc\\b') THEN 'series' ELSE 'time_series' END"""
V2 = f"v2 AS (SELECT *, {SHAPE_V2_SQL} AS shape FROM (SELECT *, lower(query_sql) AS q FROM corpus))"


@query("shape_v2", f"{LOG}, {V2} SELECT query_id, shape AS g5 FROM v2")
def _(t):
    return ft.shape_v2(t.corpus()).select("query_id", "g5")


# Output names by kind of statement.
ALIASES = """CASE o_custkey % 12 WHEN 0 THEN 'day|volume' WHEN 1 THEN 'project|txs' WHEN 3 THEN 'taker|s|rk' WHEN 4 THEN 'big|n'
  WHEN 5 THEN 'holders' WHEN 6 THEN 'block_time|hash' WHEN 9 THEN 'scalar' WHEN 10 THEN 'day|cum|p' WHEN 11 THEN 'x' ELSE 'raw' END"""


@query("select_aliases", f"SELECT o_orderkey AS query_id, {ALIASES} AS g4 FROM orders")
def _(t):
    return ft.select_aliases(t.corpus()).select("query_id", "g4")


SLUG = (
    "CASE WHEN name IS NULL OR trim(name) = '' THEN 'generic_' || g5 ELSE slug || CASE WHEN ends_with(slug, sfx) THEN '' ELSE '_' || sfx END END"
)
SLUGS = f"""{SHAPED}, words AS (SELECT query_id, name, g5, replace(g5, 'time_series', 'timeseries') AS sfx,
  list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
    lambda w: length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in sx.NAME_STOP)})) AS w FROM shaped),
slugs AS (SELECT *, replace(trim(replace(replace(' ' || array_to_string(w, '  ') || ' ', ' time  series ', ' timeseries '),
  ' distribution ', ' breakdown ')), '  ', '_') AS slug FROM words)"""


@query("name_slug", f"{SLUGS} SELECT query_id, {SLUG} AS g3 FROM slugs")
def _(t):
    return ft.name_slug(t.corpus()).select("query_id", "g3")


@query(
    "est_tokens",
    f"""{LOG} SELECT query_id, (length(CAST(query_id AS VARCHAR)) + coalesce(length(name), 0) + coalesce(length(query_sql), 0)) // 2
  AS est_tokens FROM corpus""",
)
def _(t):
    rows = t.corpus().withColumn("query_id", F.col("query_id").cast("string"))
    return ft.est_tokens(rows).select(F.col("query_id").cast("long").alias("query_id"), "est_tokens")


def _tokens(c):
    return f"sum(CASE WHEN {c} IS NOT NULL AND {STRIP(c)} <> '' THEN greatest(1, length({c}) // 4) ELSE 0 END)"


def _report(source, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({_tokens(c)} AS BIGINT) AS tokens FROM {source}" for c in cols)


@query(
    "token_report",
    f"""{LOG}, r AS ({_report("corpus", ft.REPORT_COLUMNS)})
SELECT "column", tokens, round(tokens / (SELECT sum(tokens) FROM r) * 100, 4) AS share_pct FROM r WHERE tokens > 0""",
)
def _(t):
    return ft.token_report(t.corpus())


@query(
    "token_report_documents",
    f"""WITH r AS ({_report("documents", ["text", "lang", "source"])})
SELECT "column", tokens, round(tokens / (SELECT sum(tokens) FROM r) * 100, 4) AS share_pct FROM r WHERE tokens > 0""",
)
def _(t):
    return ft.token_report(t.table("documents"), ["text", "lang", "source"])


@query(
    "token_cost",
    f"""{LOG}, r AS (SELECT CAST(sum(tokens) AS BIGINT) AS total_tokens FROM ({_report("corpus", ft.REPORT_COLUMNS)}))
SELECT 'input at 2.50' AS rate, CAST(2.5 AS DOUBLE) AS per_million, total_tokens, round(total_tokens / 1e6 * 2.5, 6) AS cost FROM r
UNION ALL SELECT 'input at 3.00', 3.0, total_tokens, round(total_tokens / 1e6 * 3.0, 6) FROM r""",
)
def _(t):
    return ft.token_cost(t.corpus())


@query("truncate_sql", "SELECT doc_id, substr(text, 1, 8000) AS head FROM documents")
def _(t):
    return t.table("documents").select("doc_id", tx.truncate_sql("text", 8000).alias("head"))


@query("clean_label", f"SELECT doc_id, replace(lower({STRIP('text')}), ' ', '_') AS label FROM documents")
def _(t):
    return t.table("documents").select("doc_id", tx.clean_label("text").alias("label"))


@query(
    "contaminated",
    "SELECT doc_id, ("
    + " OR ".join(f"contains(lower(text), '{b}')" for b in tx.BRANDS)
    + ") AS contaminated FROM documents",
)
def _(t):
    return t.table("documents").select("doc_id", tx.contaminated("text").alias("contaminated"))


@query("slugify", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def _(t):
    return t.table("documents").select("doc_id", tx.slugify("text").alias("slug"))


LEAD = "CASE doc_id % 5 WHEN 0 THEN 'This query ' WHEN 1 THEN ' The SQL ' WHEN 2 THEN 'The query' WHEN 3 THEN 'This SQL ' ELSE '' END"


def _lead(k):
    word = tx.REPLY_LEADS[k]
    return f"WHEN starts_with(s, '{word}') THEN upper(substr(s, {len(word) + 1}, 1)) || substr(s, {len(word) + 2})"


@query(
    "strip_reply_prefix",
    f"""WITH r AS (SELECT doc_id, {STRIP(f"concat({LEAD}, text)")} AS s FROM documents)
SELECT doc_id, CASE {' '.join(_lead(k) for k in range(4))} ELSE s END AS reply FROM r""",
)
def _(t):
    rows = t.sql(f"SELECT doc_id, concat({LEAD}, text) AS reply FROM documents")
    return rows.select("doc_id", tx.strip_reply_prefix("reply").alias("reply"))


@query("registry_slugs", f"WITH tools AS ({TOOLS}) SELECT tool_id, trim(regexp_replace(lower(g3), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM tools")
def _(t):
    return t.sql(TOOLS).select("tool_id", tx.slugify("g3").alias("slug"))
