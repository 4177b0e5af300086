"""Queries over routing, packing and incremental state."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions.sqltext import est_tokens
from ..operators import incremental as inc
from ..operators import packing, routing
from ..session import held, scratch_path
from ..sources import files
from ..sources.log import LOG_COLUMNS
from ..streaming import arrivals
from . import flows
from .catalog import query
from .corpus import ARRIVALS, CORPUS, LINKS, TOOLS
from .ingesting import sql_literal
from .popularity import CORPUS_IMPACT, REF, top_tables

# Routing: the same test as a regular expression per (query, table).
MATCH = "regexp_matches(query_sql, '(?i)(?:FROM|JOIN)\\s+\"?' || namespace || '\"?\\.\"?' || \"table\" || '\"?')"
TOP = f"{CORPUS_IMPACT}, top AS (SELECT * FROM impact WHERE tier = 'top_80')"
REF_COUNT = f"len(list_distinct(regexp_extract_all(query_sql, '{REF}', 1)))"
FIELDS = "query_id, name, query_sql, full_name"
HITS = f"{TOP}, hits AS (SELECT corpus.*, full_name, {REF_COUNT} AS n_refs FROM corpus JOIN top ON {MATCH} WHERE query_sql IS NOT NULL)"


@query("mentions_table", f"{HITS} SELECT query_id, full_name FROM hits")
def _(t):
    return routing.mentions_table(t.corpus(), top_tables(t))


@query("route_single", f"{HITS} SELECT {FIELDS} FROM hits WHERE n_refs = 1")
def _(t):
    return routing.route_single(t.corpus(), top_tables(t)).select(*FIELDS.split(", "))


@query("route_multi", f"{HITS} SELECT {FIELDS} FROM hits WHERE n_refs > 1")
def _(t):
    return routing.route_multi(t.corpus(), top_tables(t)).select(*FIELDS.split(", "))


SEEN = "SELECT DISTINCT CAST(l_orderkey AS VARCHAR(20)) AS query_id FROM lineitem WHERE l_returnflag = 'R'"


@query(
    "route_multi_unseen",
    f"""{HITS} SELECT {FIELDS} FROM hits WHERE n_refs > 1 AND length(query_sql) <= 200
AND CAST(query_id AS VARCHAR) NOT IN ({SEEN})""",
)
def _(t):
    rows = routing.route_multi(t.corpus(), top_tables(t), max_len=200, seen=t.sql(SEEN))
    return rows.select(*FIELDS.split(", "))


@query(
    "route_summary",
    f"""{HITS} SELECT full_name, count(*) FILTER (n_refs = 1) AS n_single, count(*) FILTER (n_refs > 1) AS n_multi
FROM hits WHERE n_refs >= 1 GROUP BY 1""",
)
def _(t):
    log, top = t.corpus(), top_tables(t)
    return routing.route_counts(log, top)


MEMBERS = " UNION ALL ".join(
    f"SELECT '{g}' AS group_name, {i} AS member_no, '{n}' AS namespace, '{t}' AS \"table\", '{n}.{t}' AS full_name"
    for g, names in routing.COMPOSITE_GROUPS.items()
    for i, (n, t) in enumerate(names)
)


@query(
    "sample_composites",
    f"""WITH corpus AS ({CORPUS}), members AS ({MEMBERS}),
picked AS (SELECT group_name, member_no, full_name, query_id,
  row_number() OVER (PARTITION BY group_name, member_no ORDER BY md5('0' || CAST(query_id AS VARCHAR)), query_id) AS r
  FROM corpus JOIN members ON {MATCH} WHERE {REF_COUNT} > 1)
SELECT group_name, query_id, min(member_no) AS member_no, arg_min(full_name, member_no) AS full_name FROM picked WHERE r <= 40 GROUP BY 1, 2""",
)
def _(t):
    return routing.sample_composites(t.corpus(), routing.composite_members(t.spark))


@query(
    "fixed_batches",
    """SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, (row_number() OVER (ORDER BY doc_id) - 1) // 7 AS batch_no
FROM documents""",
)
def _(t):
    return inc.fixed_batches(t.table("documents").select("doc_id"), 7, "doc_id")


# --- packing ----------------------------------------------------------------
#
# The check steps from batch to batch over running totals, one step per batch.

DOCS = """SELECT doc_id, source, text FROM documents"""


def packing_check(source, group, order, size, end, extra):
    """`end`: position behind the last row of a batch that starts at b.n."""
    return f"""WITH RECURSIVE src AS ({source}),
sized AS (SELECT {group} AS grp, {order} AS ord, {size} AS size FROM src),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS n,
  CAST(sum(size) OVER (PARTITION BY grp ORDER BY ord) AS BIGINT) AS upto FROM sized),
starts AS (SELECT grp, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS base, CAST(0 AS BIGINT) AS batch_no FROM num WHERE n = 1
  UNION ALL
  SELECT b.grp, nx.n, nx.upto - nx.size, b.batch_no + 1 FROM starts b JOIN num nx ON nx.grp = b.grp
  WHERE nx.n = ({end})),
out AS (SELECT num.grp, ord, size, batch_no FROM num ASOF JOIN starts ON num.grp = starts.grp AND num.n >= starts.n)
SELECT grp AS {group}, ord AS {order}, size, batch_no{extra} FROM out"""


BEFORE_OVERFLOW = "SELECT min(m.n) FROM num m WHERE m.grp = b.grp AND m.n > b.n AND m.upto - b.base > {budget}"
TOKENS = "greatest(1, length(text) // 4)"


# Texts above the budget in pieces; slot: document and piece in one number.
PIECES = f"""SELECT source, doc_id * 100000 + piece AS slot, least(4000, tokens - piece * 4000) AS tokens
  FROM (SELECT *, unnest(range(0, (tokens - 1) // 4000 + 1)) AS piece FROM (SELECT doc_id, source, {TOKENS} AS tokens FROM documents))"""


@query("pack_tokens", packing_check(PIECES, "source", "slot", "tokens", BEFORE_OVERFLOW.format(budget=4000), ""))
def _(t):
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    packed = packing.pack_tokens(t.table("documents"), 4000, "source", ["doc_id"], tokens)
    return packed.select("source", (F.col("doc_id") * 100000 + F.col("piece_no")).alias("slot"), "size", "batch_no")


@query(
    "pack_tokens_cut",
    packing_check(
        DOCS, "source", "doc_id", f"CASE WHEN {TOKENS} > 4000 THEN 3900 ELSE {TOKENS} END",
        BEFORE_OVERFLOW.format(budget=4000), "",
    ),
)
def _(t):
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    return packing.pack_tokens(t.table("documents"), 4000, "source", ["doc_id"], tokens, cut=True)


# Groups: the names of arriving queries, some of them missing.
UNNAMED = f"SELECT * REPLACE (coalesce(name, '(none)') AS name) FROM ({ARRIVALS}) a"


@query(
    "pack_rows_tokens_arrivals",
    packing_check(
        UNNAMED, "name", "pos", "greatest(1, coalesce(length(query_sql), 0))",
        "SELECT min(m.n) + 1 FROM num m WHERE m.grp = b.grp AND m.n >= b.n AND (m.upto - b.base >= 8000 OR m.n - b.n + 1 >= 90)",
        "",
    ),
)
def _(t):
    size = F.greatest(F.lit(1), F.coalesce(F.length("query_sql"), F.lit(0)))
    packed = packing.pack_rows_tokens(t.arrivals(), 90, 8000, "name", ["pos"], size)
    return packed.withColumn("name", F.coalesce("name", F.lit("(none)")))


@query(
    "pack_rows_tokens",
    packing_check(
        CORPUS, "query_engine", "query_id",
        "(length(CAST(query_id AS VARCHAR)) + coalesce(length(name), 0) + coalesce(length(query_sql), 0)) // 2",
        "SELECT min(m.n) + 1 FROM num m WHERE m.grp = b.grp AND m.n >= b.n AND (m.upto - b.base >= 8000 OR m.n - b.n + 1 >= 90)",
        "",
    ),
)
def _(t):
    rows = t.corpus().withColumn("_text_id", F.col("query_id").cast("string"))
    return packing.pack_rows_tokens(
        rows, 90, 8000, "query_engine", ["query_id"], est_tokens("_text_id", "name", "query_sql")
    )


@query(
    "chunk_bytes",
    packing_check(
        DOCS, "source", "doc_id", "octet_length(encode(text))", BEFORE_OVERFLOW.format(budget=20000),
        ", 'file' || CASE WHEN batch_no = 0 THEN '' ELSE CAST(batch_no + 1 AS VARCHAR) END || '.sql' AS file_name",
    ),
)
def _(t):
    return packing.chunk_bytes(t.table("documents"), 20000, "source", ["doc_id"], "text")


@query(
    "write_chunks",
    """SELECT source, count(*) AS n_docs, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY 1""",
)
def _(t):
    docs = t.table("documents").select("source", "doc_id", F.concat("text", F.lit("\n")).alias("line"))
    path = scratch_path(t.spark, "chunks")
    chunks = held(packing.chunk_bytes(docs, 20000, "source", ["doc_id"], "line"))
    packing.write_chunks(docs, chunks, path, "source", ["doc_id"], "line")
    sizes = packing.written_sizes(chunks, path, "source").groupBy("source").agg(F.sum("n_bytes").alias("n_bytes"))
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")).join(sizes, "source")


# --- incremental state ------------------------------------------------------

LEDGER = "SELECT DISTINCT CAST(user_id AS VARCHAR(20)) AS query_id, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS seen_at FROM events"


@query(
    "seen_ids",
    f"""WITH ledger AS ({LEDGER}), links AS ({LINKS})
SELECT query_id FROM ledger UNION SELECT value FROM links WHERE kind = 'source'""",
)
def _(t):
    return inc.seen_ids(t.sql(LEDGER), t.links())


@query(
    "remaining",
    f"""WITH corpus AS ({CORPUS}), ledger AS ({LEDGER})
SELECT query_id, name FROM corpus WHERE CAST(query_id AS VARCHAR) NOT IN (SELECT query_id FROM ledger)""",
)
def _(t):
    return inc.remaining(t.corpus(), t.sql(LEDGER)).select("query_id", "name")


PAIR_DONE = "SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey AS o_custkey FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'"


@query(
    "remaining_pairs",
    f"""WITH done AS ({PAIR_DONE}) SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.o_orderkey = o.o_orderkey AND d.o_custkey = o.o_custkey)""",
)
def _(t):
    return inc.remaining(t.table("orders").select("o_orderkey", "o_custkey"), t.sql(PAIR_DONE), ["o_orderkey", "o_custkey"])


NEW_IDS = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS query_id, o_orderdate AS seen_at FROM orders"


@query(
    "mark_seen",
    f"""WITH ledger AS ({LEDGER}), ids AS ({NEW_IDS})
SELECT query_id, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen_at FROM (
  SELECT * FROM ledger UNION ALL SELECT query_id, min(seen_at) FROM ids WHERE query_id NOT IN (SELECT query_id FROM ledger) GROUP BY 1)""",
)
def _(t):
    seen_at = F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at")
    return inc.mark_seen(t.sql(LEDGER), t.sql(NEW_IDS)).select("query_id", seen_at)


# Tables: part and supplier; their queries: orders; done: tables of the small parts.
PAIR = "concat('p', CAST(l_partkey AS VARCHAR(20)), '.s', CAST(l_suppkey AS VARCHAR(20)))"
ROUTED = f"SELECT l_orderkey AS query_id, {PAIR} AS full_name FROM lineitem"
SEEN_ORDERS = "SELECT o_orderkey AS query_id FROM orders WHERE o_orderstatus <> 'P'"
DONE_TABLES = f"SELECT DISTINCT {PAIR} AS full_name FROM lineitem WHERE l_quantity < 10"


@query(
    "drained_tables",
    f"""WITH routed AS ({ROUTED}) SELECT DISTINCT full_name FROM routed WHERE full_name NOT IN ({DONE_TABLES})
  AND full_name NOT IN (SELECT full_name FROM routed WHERE query_id NOT IN ({SEEN_ORDERS}))""",
)
def _(t):
    routed = t.sql(ROUTED)
    popular = routed.select("full_name").distinct()
    return inc.drained_tables(popular, routed, t.sql(SEEN_ORDERS), t.sql(DONE_TABLES))


@query(
    "progress",
    f"""WITH corpus AS ({CORPUS}), ledger AS ({LEDGER})
SELECT (SELECT count(*) FROM corpus) AS total, (SELECT count(*) FROM ledger) AS done,
  (SELECT count(*) FROM corpus WHERE CAST(query_id AS VARCHAR) NOT IN (SELECT query_id FROM ledger)) AS remaining""",
)
def _(t):
    return inc.progress(t.corpus(), t.sql(LEDGER))


@query(
    "stream_new_queries",
    f"""WITH arrivals AS (SELECT query_id, pos, coalesce(name, '') AS name FROM ({ARRIVALS}) a)
SELECT query_id, min(pos) AS pos, arg_min(name, pos) AS name FROM arrivals WHERE query_id IS NOT NULL GROUP BY 1
UNION ALL SELECT query_id, pos, name FROM arrivals WHERE query_id IS NULL""",
)
def _(t):
    # the log arrives as files; two runs over the same folder pass each row once
    source = scratch_path(t.spark, "incoming")
    t.arrivals().select("query_id", "pos", F.coalesce("name", F.lit("")).alias("name")).write.parquet(source)
    schema = "query_id string, pos long, name string"
    ledger, state = scratch_path(t.spark, "ledger"), scratch_path(t.spark, "state")
    for _run in range(2):
        stream = t.spark.readStream.schema(schema).parquet(source)
        arrivals.stream_new_queries(stream, ledger, state).awaitTermination()
    return arrivals.read_ledger(t.spark, ledger)


EXPORT_BYTES = 40 * 1024 * 1024
STATEMENT = (
    "'INSERT INTO \"Query\" (" + ", ".join(f'"{c}"' for c in LOG_COLUMNS) + ") VALUES (' || "
    + " || ', ' || ".join(sql_literal(c) for c in LOG_COLUMNS) + " || ');' || chr(10)"
)


@query(
    "export_inserts",
    packing_check(
        f"""SELECT full_name, query_id, {STATEMENT} AS statement FROM ({HITS} SELECT * FROM hits WHERE n_refs = 1) h""",
        "full_name", "query_id", "octet_length(encode(statement))", BEFORE_OVERFLOW.format(budget=EXPORT_BYTES),
        ", 'file' || CASE WHEN batch_no = 0 THEN '' ELSE CAST(batch_no + 1 AS VARCHAR) END || '.sql' AS file_name",
    ),
)
def _(t):
    """Single-table queries as files of INSERT statements per popular table."""
    log, top = t.corpus(), top_tables(t)
    rows = held(files.render_inserts(routing.route_single(log, top)).select("full_name", "query_id", "statement"))
    chunks = held(packing.chunk_bytes(rows, EXPORT_BYTES, "full_name", ["query_id"], "statement"))
    path = scratch_path(t.spark, "export")
    packing.write_chunks(rows, chunks, path, "full_name", ["query_id"], "statement")
    return chunks


# --- a whole round ----------------------------------------------------------


def _asked(prompt: str) -> str:
    """The part of a prompt behind the known ids."""
    return prompt[max(0, prompt.find("\n## Queries (")) :]


def _one_tool(prompt: str) -> str:
    """Stands for a model: one tool per batch, named after its first query's kind."""
    ids = [line[1 : line.index("]")] for line in _asked(prompt).split("\n") if line.startswith("[") and "]" in line]
    return f"## Found\ng1: round\ng3: tool_{int(ids[0]) % 3}\nsource_query_ids: {','.join(ids)}\n"


ROUND = f"""{HITS}, ledger AS ({LEDGER}), links AS ({LINKS}),
todo AS (SELECT DISTINCT CAST(query_id AS VARCHAR) AS query_id FROM hits WHERE n_refs >= 1
  AND CAST(query_id AS VARCHAR) NOT IN (SELECT query_id FROM ledger) AND CAST(query_id AS VARCHAR) NOT IN (SELECT value FROM links))"""


def _round(t):
    tools = t.sql(TOOLS).drop("usage_count", "last_used_at")
    state = flows.Registry(tools, t.links(), t.sql(LEDGER))
    return flows.extract_round(t.corpus(), top_tables(t), state, _one_tool, rows=50, tokens=5000)


@query("extract_round_ledger", f"{ROUND} SELECT query_id FROM ledger UNION SELECT query_id FROM todo")
def _(t):
    return _round(t).ledger.select("query_id")


@query("extract_round_sources", f"{ROUND} SELECT value FROM links UNION SELECT query_id FROM todo")
def _(t):
    return _round(t).links.select("value").distinct()


def _shaky(model):
    """The model, failing at the first try of every other prompt."""
    tried = set()

    def call(prompt):
        key = zlib.crc32(_asked(prompt).encode())
        if key % 2 and key not in tried:
            tried.add(key)
            raise TimeoutError("try again")
        return model(prompt)

    return call


def _state(t):
    tools = t.sql(TOOLS).drop("usage_count", "last_used_at")
    return flows.Registry(tools, t.links(), t.sql(LEDGER))


@query(
    "extract_drained",
    f"""{ROUND} SELECT 'query' AS kind, query_id AS name FROM (SELECT query_id FROM ledger UNION SELECT query_id FROM todo)
UNION ALL SELECT 'table', full_name FROM top""",
)
def _(t):
    """Rounds until no top table has an unseen query: the ledger and the finished tables."""
    path = scratch_path(t.spark, "drained")
    calls = {"workers": 4, "retries": 1, "backoff": 0.0, "parallelism": 8}
    end = flows.extract_drained(t.corpus(), top_tables(t), _state(t), _shaky(_one_tool), path, rows=50, tokens=5000, groups=None, **calls)
    seen = end.state.ledger.select(F.lit("query").alias("kind"), F.col("query_id").alias("name"))
    return seen.unionByName(end.tables.select(F.lit("table").alias("kind"), F.col("full_name").alias("name")))


@query(
    "composite_round",
    f"""WITH ledger AS ({LEDGER}), links AS ({LINKS}), members AS ({MEMBERS}),
corpus AS (SELECT * FROM ({CORPUS}) c WHERE CAST(query_id AS VARCHAR) NOT IN (SELECT query_id FROM ledger)
  AND CAST(query_id AS VARCHAR) NOT IN (SELECT value FROM links)),
picked AS (SELECT query_id, row_number() OVER (PARTITION BY group_name, member_no ORDER BY md5('0' || CAST(query_id AS VARCHAR)), query_id) AS r
  FROM corpus JOIN members ON {MATCH} WHERE {REF_COUNT} > 1)
SELECT 'query' AS kind, query_id AS name FROM (SELECT query_id FROM ledger UNION SELECT CAST(query_id AS VARCHAR) FROM picked WHERE r <= 40)
UNION ALL SELECT DISTINCT 'group', group_name FROM members""",
)
def _(t):
    """One prompt for each composite group: the ledger and the finished groups."""
    done = t.spark.createDataFrame([], "group_name string")
    state, groups = flows.composite_round(t.corpus(), _state(t), done, _one_tool)
    seen = state.ledger.select(F.lit("query").alias("kind"), F.col("query_id").alias("name"))
    return seen.unionByName(groups.select(F.lit("group").alias("kind"), F.col("group_name").alias("name")))
