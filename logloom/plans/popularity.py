"""Queries over table popularity, combinations and the Pareto cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD
from ..operators import cleaning
from ..operators import popularity as pop
from ..session import held
from .catalog import query
from .corpus import ARRIVALS, CORPUS

# The reference pattern once more in SQL form; names are lower case without quotes.
REF = rf'(?i)(?:FROM|JOIN){SPACE}+("?{WORD}+"?\."?{WORD}+"?(?:\."?{WORD}+"?)?)'


def names_sql(source: str) -> str:
    return f"""refs AS (SELECT query_id, unnest(regexp_extract_all(query_sql, '{REF}', 1)) AS raw FROM {source}),
names AS (SELECT DISTINCT query_id, lower(replace(raw, '"', '')) AS full_name FROM refs WHERE length(raw) > 3),
many AS (SELECT query_id, count(*) AS n FROM names GROUP BY 1 HAVING count(*) >= 2),
used AS (SELECT query_id, full_name, n FROM names JOIN many USING (query_id)),
counted AS (SELECT full_name, count(*) AS "count" FROM used GROUP BY 1)"""


SPLIT = "coalesce(list_extract(string_split(full_name, '.'), -2), '') AS namespace, list_extract(string_split(full_name, '.'), -1) AS \"table\""
NAMES = f"WITH corpus AS ({CORPUS}), {names_sql('corpus')}"
RANKED = f"""ranked AS (SELECT row_number() OVER (ORDER BY "count" DESC, full_name) AS rank, {SPLIT}, full_name, "count" FROM counted)"""
POPULAR_CHECK = f"{NAMES}, {RANKED} SELECT * FROM ranked"


def popular(t):
    return pop.popular_tables(t.corpus())


@query("popular_tables", POPULAR_CHECK)
def _(t):
    return popular(t)


def _combos(size: int) -> str:
    letters = "abcde"[:size]
    tables = ", ".join(f"u{x}.full_name AS table_{x}" for x in letters)
    joins = "used ua" + "".join(
        f" JOIN used u{b} ON ua.query_id = u{b}.query_id AND u{a}.full_name < u{b}.full_name"
        for a, b in zip(letters, letters[1:])
    )
    return f"SELECT {tables}, count(*) AS \"count\" FROM {joins} {{where}} GROUP BY ALL"


def _ranked_combos(size: int, where: str = "") -> str:
    letters = "abcde"[:size]
    members = ", ".join(f"table_{x}" for x in letters)
    own = ", ".join(f'c{x}."count" AS table_{x}_count' for x in letters)
    joins = " ".join(f"JOIN counted c{x} ON c{x}.full_name = table_{x}" for x in letters)
    return (
        f"{NAMES}, combos AS ({_combos(size).format(where=where)}) "
        f'SELECT row_number() OVER (ORDER BY combos."count" DESC, {members}) AS rank, {members}, combos."count" AS "count", {own} '
        f"FROM combos {joins}"
    )


@query("popular_pairs", _ranked_combos(2))
def _(t):
    return pop.popular_pairs(t.corpus())


@query("popular_pairs_narrow", _ranked_combos(2, "WHERE ua.n <= 6"))
def _(t):
    return pop.popular_pairs(t.corpus(), max_tables=6)


@query("popular_triples", _ranked_combos(3))
def _(t):
    return pop.popular_triples(t.corpus())


@query("popular_quads", _ranked_combos(4))
def _(t):
    return pop.popular_quads(t.corpus())


@query("popular_quints", _ranked_combos(5))
def _(t):
    return pop.popular_quints(t.corpus())


def _top_combos(size: int, k: int) -> str:
    members = ", ".join(f"table_{x}" for x in "abcde"[:size])
    return (
        f"{NAMES}, combos AS ({_combos(size).format(where='')}) "
        f'SELECT row_number() OVER (ORDER BY "count" DESC, {members}) AS rank, {members}, "count" FROM combos '
        f"ORDER BY rank LIMIT {k}"
    )


@query("top_pairs_uncapped", _top_combos(2, 30))
def _(t):
    return pop.top_pairs_uncapped(t.corpus())


@query("top_triples_uncapped", _top_combos(3, 20))
def _(t):
    return pop.top_triples_uncapped(t.corpus())


# Baskets of parts per order: the same functions on denser data.
BASKETS = """baskets AS (SELECT DISTINCT l_orderkey AS query_id, concat('ns.p', CAST(l_partkey % 50 AS VARCHAR(20))) AS full_name FROM lineitem),
many AS (SELECT query_id, count(*) AS n FROM baskets GROUP BY 1 HAVING count(*) >= 2),
used AS (SELECT query_id, full_name, n FROM baskets JOIN many USING (query_id)),
counted AS (SELECT full_name, count(*) AS "count" FROM used GROUP BY 1)"""


def part_baskets(t):
    rows = t.sql("SELECT l_orderkey AS query_id, concat('ns.p', CAST(l_partkey % 50 AS VARCHAR(20))) AS full_name FROM lineitem")
    return (
        rows.groupBy("query_id")
        .agg(F.sort_array(F.collect_set("full_name")).alias("tables"))
        .filter(F.size("tables") >= 2)
    )


@query(
    "basket_pairs",
    f"""WITH {BASKETS}, combos AS ({_combos(2).format(where='')})
SELECT row_number() OVER (ORDER BY combos."count" DESC, table_a, table_b) AS rank, table_a, table_b, combos."count" AS "count",
  ca."count" AS table_a_count, cb."count" AS table_b_count
FROM combos JOIN counted ca ON ca.full_name = table_a JOIN counted cb ON cb.full_name = table_b""",
)
def _(t):
    return pop.popular_combinations(held(part_baskets(t)), 2)


@query(
    "basket_top_triples",
    f"""WITH {BASKETS}, combos AS ({_combos(3).format(where='')})
SELECT row_number() OVER (ORDER BY "count" DESC, table_a, table_b, table_c) AS rank, * FROM combos ORDER BY rank LIMIT 20""",
)
def _(t):
    return pop.top_combinations(held(part_baskets(t)), 3, 20)


# --- Pareto -----------------------------------------------------------------

IMPACT = """shares AS (SELECT rank, namespace, "table", full_name, "count" AS appearances,
  "count" / (SELECT sum("count") FROM ranked) * 100 AS share,
  CAST(sum("count") OVER (ORDER BY rank) AS BIGINT) / (SELECT sum("count") FROM ranked) * 100 AS cumulative FROM ranked),
impact AS (SELECT rank, namespace, "table", full_name, appearances, round(share, 4) AS appearance_share_pct,
  round(cumulative, 4) AS cumulative_pct, CASE WHEN cumulative <= 80 THEN 'top_80' ELSE 'tail_20' END AS tier FROM shares)"""
CLEAN_LOG = f"""arrivals AS ({ARRIVALS}),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM arrivals) WHERE r = 1 OR query_id IS NULL),
v AS (SELECT * EXCLUDE (r) FROM u QUALIFY row_number() OVER (PARTITION BY md5(query_sql) ORDER BY pos) = 1),
cleaned AS (SELECT * REPLACE (pos AS query_id) FROM v WHERE length(trim(query_sql)) >= 10)"""


@query("impact", f"WITH {CLEAN_LOG}, {names_sql('cleaned')}, {RANKED}, {IMPACT} SELECT * FROM impact")
def _(t):
    # ids may be missing in an arriving log; the position names a row
    log = cleaning.clean(t.arrivals()).withColumn("query_id", F.col("pos"))
    return pop.impact(pop.popular_tables(log))


CORPUS_IMPACT = f"{NAMES}, {RANKED}, {IMPACT}"


def impact(t):
    return pop.impact(popular(t))


def top_tables(t):
    return held(pop.top_tier(impact(t)))


@query(
    "impact_summary",
    f"{CORPUS_IMPACT} SELECT tier, count(*) AS n_tables, CAST(sum(appearances) AS BIGINT) AS appearances FROM impact GROUP BY ROLLUP (tier)",
)
def _(t):
    return pop.impact_summary(impact(t))


@query("impact_listing", f"{CORPUS_IMPACT} SELECT * FROM impact ORDER BY rank LIMIT 20")
def _(t):
    return pop.impact_listing(impact(t))


@query("top_tier", f"{CORPUS_IMPACT} SELECT * FROM impact WHERE tier = 'top_80'")
def _(t):
    return pop.top_tier(impact(t))


SIMPLE = rf"(?:from|join){SPACE}+([a-zA-Z0-9_.]+)"
PREFIX_COUNTS = f"""logs AS (SELECT query_sql FROM ({CORPUS}) c UNION ALL SELECT query_sql FROM ({ARRIVALS}) a),
hits AS (SELECT unnest(regexp_extract_all(lower(query_sql), '{SIMPLE}', 1)) AS t FROM logs),
prefix_counts AS (SELECT 'table' AS kind, t AS name, count(*) AS "count" FROM hits GROUP BY t
  UNION ALL SELECT 'prefix', string_split(t, '.')[1], count(*) FROM hits GROUP BY 2)"""


@query("prefix_counts", f"WITH {PREFIX_COUNTS} SELECT * FROM prefix_counts")
def _(t):
    return pop.prefix_counts(t.corpus(), t.arrivals())


@query(
    "prefix_counts_top",
    f"WITH {PREFIX_COUNTS} SELECT * FROM prefix_counts QUALIFY row_number() OVER (PARTITION BY kind ORDER BY \"count\" DESC, name) <= 5",
)
def _(t):
    return pop.prefix_counts(t.corpus(), t.arrivals(), n=5)
