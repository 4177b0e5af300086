"""Queries over sources, sinks and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..operators import cleaning
from ..session import scratch_path
from ..sources import files, log
from .catalog import query
from .corpus import ARRIVALS, CORPUS
from .popularity import POPULAR_CHECK, popular

STRIP = lambda x: f"trim({x}, '{WHITESPACE}')"


@query("scan_log", "SELECT doc_id, lang FROM documents")
def _(t):
    return log.scan_log(t.spark, t.path("documents"), ["doc_id", "lang"])


def _cell(c):
    return (
        f"nullif(CASE WHEN CAST({c} AS VARCHAR) IN ('None', 'nan', '<NA>') THEN '' "
        f"ELSE replace(CAST({c} AS VARCHAR), chr(9), ' ') END, '') AS {c}"
    )


@query(
    "to_all_text",
    "SELECT " + ", ".join(_cell(c) for c in ["doc_id", "text", "lang", "source", "n_chars"]) + " FROM documents",
)
def _(t):
    return log.to_all_text(t.table("documents"))


@query(
    "load_report",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{n}.parquet' AS file, count(*) AS n_rows FROM {n}" for n in ("orders", "customer"))
    + ") SELECT * FROM c UNION ALL SELECT NULL, CAST(sum(n_rows) AS BIGINT) FROM c",
)
def _(t):
    return log.load_report(t.spark.read.parquet(t.path("orders"), t.path("customer")))


@query(
    "page",
    f"""WITH corpus AS ({CORPUS})
SELECT query_id, coalesce(name, '') AS name, query_sql FROM corpus WHERE query_sql IS NOT NULL
ORDER BY query_id LIMIT 500 OFFSET 700""",
)
def _(t):
    return log.page(t.corpus(), 700, 500)


@query("popular_csv_round_trip", POPULAR_CHECK)
def _(t):
    path = scratch_path(t.spark, "popular")
    files.write_table(popular(t), path, "csv")
    return files.read_popular(t.spark, path)


@query("label_tsv_append", f"WITH corpus AS ({CORPUS}) SELECT CAST(query_id AS VARCHAR) AS query_id, query_engine AS label FROM corpus")
def _(t):
    path = scratch_path(t.spark, "labels")
    rows = t.corpus().select("query_id", F.col("query_engine").alias("label"))
    for mark in (True, False):
        files.write_table(rows.filter((F.col("label") == "v2 SQL") == mark), path, "tsv", mode="append")
    return files.read_labels(t.spark, path)


def sql_literal(c):
    v = f"CAST({c} AS VARCHAR)"
    return (
        f"CASE WHEN {v} IS NULL OR {STRIP(v)} IN ('', 'None', 'nan', 'NULL') THEN 'NULL' "
        f"ELSE '''' || replace({v}, '''', '''''') || '''' END"
    )


@query(
    "render_inserts",
    f"WITH corpus AS ({CORPUS}) SELECT query_id, 'INSERT INTO \"Query\" ("
    + ", ".join(f'"{c}"' for c in log.LOG_COLUMNS)
    + ") VALUES (' || "
    + " || ', ' || ".join(sql_literal(c) for c in log.LOG_COLUMNS)
    + " || ');' || chr(10) AS statement FROM corpus",
)
def _(t):
    return files.render_inserts(t.corpus()).select("query_id", "statement")


@query(
    "render_blocks",
    f"""WITH corpus AS ({CORPUS}) SELECT query_id, '--- Query ID: ' || CAST(query_id AS VARCHAR) || ' ---' || chr(10)
|| coalesce(query_sql, '') || chr(10) || repeat('-', 50) || chr(10) || chr(10) AS block FROM corpus""",
)
def _(t):
    return files.render_blocks(t.corpus(), "query_sql")


# YAML lines from parts: brands are files, types are sources, parts are tables.  Five
# lines per part; the line number follows the part key.
_LINES = [
    "CASE WHEN p_partkey % 3 = 0 THEN concat('  - name: ', p_type) ELSE '# comment' END",
    "CASE WHEN p_partkey % 3 = 0 THEN '    schema: x' ELSE '' END",
    "CASE WHEN p_partkey % 4 = 0 THEN '    tables:' WHEN p_partkey % 4 = 1 THEN '   meta: y' ELSE '        columns:' END",
    "concat('      - name: ', p_name, ' ')",
    "'          - name: column'",
]
YAML = " UNION ALL ".join(
    f"SELECT p_brand AS file, CAST(p_partkey * 5 + {k} AS BIGINT) AS line_no, {line} AS line FROM part"
    for k, line in enumerate(_LINES)
)
YAML_CHECK = f"""WITH lines AS ({YAML}), a AS (
  SELECT *, trim(line) AS s, length(line) - length(ltrim(line)) AS indent FROM lines WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%'),
b AS (SELECT *, CASE WHEN indent = 2 AND s LIKE '- name:%' THEN trim(substr(s, 8)) END AS src,
  CASE WHEN indent = 4 AND s = 'tables:' THEN 1 WHEN indent <= 4 AND s <> 'tables:' THEN 0 END AS op FROM a),
c AS (SELECT *, last_value(src IGNORE NULLS) OVER w AS source, last_value(op IGNORE NULLS) OVER w AS is_open
  FROM b WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
found AS (SELECT file, line_no, coalesce(source, '') AS source, trim(substr(s, 8)) AS "table"
  FROM c WHERE is_open = 1 AND indent = 6 AND s LIKE '- name:%')"""


@query("scan_source_yaml", YAML_CHECK + " SELECT * FROM found")
def _(t):
    return files.scan_source_yaml(t.sql(YAML))


@query("source_tables", YAML_CHECK + ' SELECT DISTINCT source AS namespace, "table" AS table_name FROM found')
def _(t):
    return files.source_tables(files.scan_source_yaml(t.sql(YAML)))


@query(
    "seed_dimension",
    """WITH cur AS (SELECT c_custkey AS domain_id, c_name AS name, c_mktsegment AS description, c_acctbal AS created FROM customer),
seed AS (SELECT s_suppkey * 3 AS domain_id, s_name AS name, 'seeded' AS description FROM supplier
  UNION ALL SELECT -1 - s_suppkey, s_name, 'new' FROM supplier)
SELECT coalesce(s.domain_id, c.domain_id) AS domain_id, coalesce(s.name, c.name) AS name,
  coalesce(s.description, c.description) AS description, c.created FROM cur c FULL JOIN seed s ON s.domain_id = c.domain_id""",
)
def _(t):
    current = t.sql("SELECT c_custkey AS domain_id, c_name AS name, c_mktsegment AS description, c_acctbal AS created FROM customer")
    seed = t.sql(
        "SELECT s_suppkey * 3 AS domain_id, s_name AS name, 'seeded' AS description FROM supplier "
        "UNION ALL SELECT -1 - s_suppkey, s_name, 'new' FROM supplier"
    )
    return files.seed_dimension(current, seed)


# --- cleaning ---------------------------------------------------------------

ALL = "query_id, pos, name, description, tags, version, parameters, query_engine, query_sql, is_private, is_archived, is_unsaved, owner"
BY_ID = f"""arrivals AS ({ARRIVALS}),
by_id AS (SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM arrivals)
  WHERE r = 1 OR query_id IS NULL)"""
BY_SQL = f"""{BY_ID}, by_sql AS (SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY md5(query_sql) ORDER BY pos) AS r FROM by_id) WHERE r = 1)"""
LONG = f"{BY_SQL}, long_sql AS (SELECT * FROM by_sql WHERE length(trim(query_sql)) >= 10)"
NORMAL = f"""{LONG}, normal AS (SELECT * REPLACE (lower(trim(owner)) AS owner,
  lower(trim(regexp_replace(name, '(Copy of\\s*(\\(#\\d+\\))?\\s*)+', '', 'i'))) AS name,
  CASE WHEN lower(trim(description)) IN ('', 'null', 'none', 'test', 'n/a', '-') THEN NULL ELSE trim(description) END AS description)
  FROM long_sql)"""
NAMED = f"""{NORMAL}, named AS (SELECT * REPLACE (CASE WHEN lower(trim(name)) IN
  ('new query', 'untitled', 'query', 'test', 'unnamed query') THEN NULL ELSE name END AS name) FROM normal)"""


@query("dedupe_by_id", f"WITH {BY_ID} SELECT {ALL} FROM by_id")
def _(t):
    return cleaning.dedupe_by_id(t.arrivals())


@query("dedupe_by_sql", f"WITH {BY_SQL} SELECT {ALL} FROM by_sql")
def _(t):
    return cleaning.dedupe_by_sql(cleaning.dedupe_by_id(t.arrivals()))


@query("drop_short_sql", f"WITH arrivals AS ({ARRIVALS}) SELECT {ALL} FROM arrivals WHERE length(trim(query_sql)) >= 10")
def _(t):
    return cleaning.drop_short_sql(t.arrivals())


@query("normalize_text", f"WITH {NORMAL} SELECT {ALL} FROM normal")
def _(t):
    rows = cleaning.dedupe_by_sql(cleaning.dedupe_by_id(t.arrivals()))
    return cleaning.normalize_text(cleaning.drop_short_sql(rows))


@query(
    "null_garbage_names",
    f"""WITH arrivals AS ({ARRIVALS}) SELECT pos, CASE WHEN lower(trim(name)) IN
  ('new query', 'untitled', 'query', 'test', 'unnamed query') THEN NULL ELSE name END AS name FROM arrivals""",
)
def _(t):
    return cleaning.null_garbage_names(t.arrivals()).select("pos", "name")


@query("clean", f"WITH {NAMED} SELECT {ALL} FROM named WHERE trim(query_sql) <> ''")
def _(t):
    return cleaning.clean(t.arrivals())


_COUNTS = [
    "(SELECT count(*) FROM arrivals)",
    "(SELECT count(*) FROM by_id)",
    "(SELECT count(*) FROM by_sql)",
    *["(SELECT count(*) FROM long_sql)"] * 4,
]


@query(
    "clean_audit",
    f"WITH {LONG}, steps AS ("
    + " UNION ALL ".join(
        f"SELECT {i + 1} AS step_no, '{s}' AS step, {_COUNTS[i]} AS rows_before, {_COUNTS[i + 1]} AS rows_after"
        for i, s in enumerate(cleaning.CLEAN_STEPS)
    )
    + f" UNION ALL SELECT 7, 'total', {_COUNTS[0]}, {_COUNTS[-1]}) "
    "SELECT *, rows_before - rows_after AS dropped FROM steps",
)
def _(t):
    return cleaning.clean_audit(t.arrivals())


