"""Queries over domain classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext as sx
from ..operators import domains as dm
from ..operators import popularity as pop
from ..session import held
from .catalog import query
from .corpus import ARRIVALS, CORPUS, TAXONOMY
from .ingesting import STRIP
from .popularity import PREFIX_COUNTS, SIMPLE
from .texts import ALIASES, LOG, ORDERED_SQL, SLUG, SLUGS


def _values(rows, columns):
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({', '.join(columns)}))"


OVERRIDES = _values([(k, *v) for k, v in dm.OVERRIDES.items()], ["key", "g1", "g2", "g3"])
TAX = f"""tax AS (SELECT pos, {STRIP("lower(coalesce(namespace, ''))")} AS ns, {STRIP("lower(table_name)")} AS tn, g1, g2, g3
  FROM ({TAXONOMY}) x),
keyed AS (SELECT tn AS key, pos, g1, g2, g3 FROM tax UNION ALL SELECT ns || '.' || tn, pos, g1, g2, g3 FROM tax WHERE ns <> ''),
over_rows AS {OVERRIDES},
dict AS (SELECT key, g1, g2, g3 FROM keyed WHERE key NOT IN (SELECT key FROM over_rows) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1
  UNION ALL SELECT * FROM over_rows),
modes AS (SELECT ns AS namespace, arg_min(g1, pos) AS g1, arg_min(g2, pos) AS g2, g3 FROM tax WHERE ns <> '' GROUP BY ns, g3
  QUALIFY row_number() OVER (PARTITION BY ns ORDER BY count(*) DESC, min(pos)) = 1)"""
NAMES = f"""corpus AS ({CORPUS}), refs AS (SELECT query_id, tables, unnest(tables) AS "table", generate_subscripts(tables, 1) AS ord
  FROM (SELECT query_id, {ORDERED_SQL} AS tables FROM corpus)),
names AS (SELECT DISTINCT "table" FROM refs)"""


def _wordlist(name):
    return f"list_filter(regexp_split_to_array({name}, '[_.\\-]'), lambda w: length(w) > 3)"


VOTES = f"""tax_words AS (SELECT pos, g1, g2, g3, unnest({_wordlist('tn')}) AS word FROM tax),
name_words AS (SELECT "table", w AS word, ord FROM (SELECT "table", unnest({_wordlist('"table"')}) AS w,
  generate_subscripts({_wordlist('"table"')}, 1) AS ord FROM names)),
votes AS (SELECT "table", g3, count(*) AS n, min(ord * 1000000000 + pos) AS met, arg_min(g1, ord * 1000000000 + pos) AS g1,
  arg_min(g2, ord * 1000000000 + pos) AS g2 FROM name_words JOIN tax_words USING (word) GROUP BY 1, 2),
voted AS (SELECT "table", g1, g2, g3 FROM votes QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY n DESC, met) = 1)"""
LOOKUP = f"""split AS (SELECT "table", {STRIP('lower("table")')} AS t FROM names),
parts AS (SELECT *, CASE WHEN contains(t, '.') THEN list_extract(string_split(t, '.'), -2) END AS ns, list_extract(string_split(t, '.'), -1) AS tn FROM split),
looked AS (SELECT p."table", coalesce(a.g1, b.g1, c.g1, m.g1, v.g1) AS g1, coalesce(a.g2, b.g2, c.g2, m.g2, v.g2) AS g2,
  coalesce(a.g3, b.g3, c.g3, m.g3, v.g3) AS g3
  FROM parts p LEFT JOIN dict a ON a.key = p.t LEFT JOIN dict b ON b.key = p.ns || '.' || p.tn LEFT JOIN dict c ON c.key = p.tn
  LEFT JOIN modes m ON m.namespace = p.ns LEFT JOIN voted v ON v."table" = p.t)"""
KEYWORDS = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(q, '{w}')" for w in words) + f" THEN '{' '.join(value)}'"
    for words, value in dm.KEYWORD_RULES
) + f" ELSE '{' '.join(dm.KEYWORD_DEFAULT)}' END"
ALL = f"WITH {TAX}, {NAMES}, {VOTES}, {LOOKUP}"


def _tables(t):
    return t.corpus().select(F.explode(sx.ordered_tables("query_sql")).alias("table")).distinct()


def _overrides(t):
    return dm.override_rows(t.spark)


@query("table_dictionary", f"WITH {TAX} SELECT * FROM dict")
def _(t):
    return dm.table_dictionary(t.sql(TAXONOMY), _overrides(t))


@query("namespace_mode", f"WITH {TAX} SELECT * FROM modes")
def _(t):
    return dm.namespace_mode(t.sql(TAXONOMY))


@query("word_vote", f"{ALL} SELECT * FROM voted")
def _(t):
    return dm.word_vote(_tables(t), dm.word_index(t.sql(TAXONOMY)))


@query("lookup_table", f"{ALL} SELECT * FROM looked")
def _(t):
    tax = t.sql(TAXONOMY)
    return dm.lookup_table(_tables(t), dm.table_dictionary(tax, _overrides(t)), dm.namespace_mode(tax), dm.word_index(tax))


@query(
    "keyword_domain",
    f"""WITH corpus AS ({CORPUS}), k AS (SELECT query_id, string_split({KEYWORDS}, ' ') AS v
  FROM (SELECT query_id, lower(coalesce(query_sql, '')) AS q FROM corpus))
SELECT query_id, v[1] AS g1, v[2] AS g2, v[3] AS g3 FROM k""",
)
def _(t):
    return dm.keyword_domain(t.corpus()).select("query_id", "g1", "g2", "g3")


DOMAIN = f"""{ALL}, k AS (SELECT query_id, string_split({KEYWORDS}, ' ') AS v
  FROM (SELECT query_id, lower(coalesce(query_sql, '')) AS q FROM corpus)),
first_hit AS (SELECT r.query_id, arg_min(l.g1, ord) AS g1, arg_min(l.g2, ord) AS g2, arg_min(l.g3, ord) AS g3
  FROM refs r JOIN looked l ON l."table" = r."table" WHERE l.g1 IS NOT NULL GROUP BY 1),
domain_of AS (SELECT query_id, coalesce(g1, v[1]) AS g1, coalesce(g2, v[2]) AS g2, coalesce(g3, v[3]) AS g3 FROM k LEFT JOIN first_hit USING (query_id))"""


@query("query_domain", f"{DOMAIN} SELECT * FROM domain_of")
def _(t):
    return dm.query_domain(t.corpus(), t.sql(TAXONOMY), _overrides(t))


# The log as it arrives: ids are missing and repeat, and every row has its domain.
BY_ROW = f"SELECT * EXCLUDE (query_id), pos AS query_id FROM ({ARRIVALS}) a"


@query(
    "query_domain_arrivals",
    f"""{DOMAIN.replace(CORPUS, BY_ROW)}
SELECT a.query_id, g1, g2, g3 FROM domain_of d JOIN ({ARRIVALS}) a ON a.pos = d.query_id""",
)
def _(t):
    return dm.query_domain(t.arrivals(), t.sql(TAXONOMY), _overrides(t))


@query(
    "classify_rules",
    f"""{DOMAIN}, {SLUGS.removeprefix(LOG + ", ")}
SELECT query_id, d.g1, d.g2, {SLUG} AS g3, {ALIASES} AS g4, g5
FROM slugs JOIN domain_of d USING (query_id) JOIN orders ON o_orderkey = query_id""",
)
def _(t):
    return dm.classify_rules(t.corpus(), t.sql(TAXONOMY), _overrides(t))


# --- prefixes ---------------------------------------------------------------

# Prefixes made from parts: known, containing a seed, with a chain inside, unknown.
PREFIXES = """SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'uniswap' WHEN 1 THEN concat('my_aave_', CAST(p_size AS VARCHAR(20)))
  WHEN 2 THEN 'liabstractdo' WHEN 3 THEN concat('zz', lower(p_brand)) WHEN 4 THEN concat('GMX_', p_type)
  ELSE substr(p_name, 1, 3) END AS name FROM part"""
SEEDS = _values([(i, k, v) for i, (k, v) in enumerate(dm.SEED_PREFIXES.items())], ["i", "seed", "domain"])
CHAINS = _values(list(enumerate(dm.PREFIX_CHAINS)), ["i", "chain"])


def seed_lookup(source):
    return f"""seeds AS {SEEDS}, chains AS {CHAINS}, low AS (SELECT name, lower(name) AS p FROM {source}),
near AS (SELECT name, arg_min(s.domain, s.i) AS domain FROM low JOIN seeds s ON contains(p, seed) OR contains(seed, p) GROUP BY 1),
bare AS (SELECT name, arg_min(s.domain, c.i) AS domain FROM low JOIN chains c ON contains(p, chain)
  JOIN seeds s ON s.seed = trim(replace(p, chain, ''), '_') GROUP BY 1),
seeded AS (SELECT low.name, coalesce(e.domain, near.domain, bare.domain) AS domain FROM low
  LEFT JOIN seeds e ON e.seed = p LEFT JOIN near ON near.name = low.name LEFT JOIN bare ON bare.name = low.name)"""


@query("prefix_domain", f"WITH prefixes AS ({PREFIXES}), {seed_lookup('prefixes')} SELECT * FROM seeded")
def _(t):
    return dm.prefix_domain(t.sql(PREFIXES))


TABLE_RULE = "coalesce(" + ", ".join(
    "CASE WHEN bool_or(" + " OR ".join(f"contains(lower(x.name), '{w}')" for w in words) + f") THEN '{d}' END"
    for d, words in dm.TABLE_RULES
) + ", 'general')"
UNKNOWN = f"""inferred AS (SELECT u.name, {TABLE_RULE} AS domain FROM unknown u
  LEFT JOIN (SELECT name, string_split(name, '.')[1] AS prefix FROM prefix_counts WHERE kind = 'table') x ON x.prefix = u.name GROUP BY 1)"""
TOP = """top AS (SELECT name, "count" FROM prefix_counts WHERE kind = 'prefix')"""
MAP = f"""{PREFIX_COUNTS}, {TOP}, {seed_lookup('top')}, unknown AS (SELECT name FROM seeded WHERE domain IS NULL), {UNKNOWN},
domain_map AS (SELECT top.name, top."count", coalesce(seeded.domain, inferred.domain) AS domain FROM top
  JOIN seeded ON seeded.name = top.name LEFT JOIN inferred ON inferred.name = top.name)"""
DISTRIBUTION = f"""{MAP}, distribution AS (SELECT coalesce(m.domain, 'general') AS domain, CAST(sum(p."count") AS BIGINT) AS "count", sum(p."count") > 10 AS active
  FROM prefix_counts p LEFT JOIN domain_map m ON m.name = p.name WHERE p.kind = 'prefix' GROUP BY 1)"""


def prefix_counts(t):
    return held(pop.prefix_counts(t.corpus(), t.arrivals()))


def mapped(t):
    counts = prefix_counts(t)
    return counts, dm.domain_map(counts)


@query(
    "infer_unknown",
    f"""WITH {PREFIX_COUNTS}, unknown AS (SELECT name FROM prefix_counts WHERE kind = 'prefix'), {UNKNOWN} SELECT * FROM inferred""",
)
def _(t):
    counts = prefix_counts(t)
    return dm.infer_unknown(counts.filter("kind = 'prefix'"), counts.filter("kind = 'table'"))


@query("domain_map", f"WITH {MAP} SELECT * FROM domain_map")
def _(t):
    return mapped(t)[1]


@query("domain_distribution", f"WITH {DISTRIBUTION} SELECT * FROM distribution")
def _(t):
    return dm.domain_distribution(*mapped(t))


KEYWORD_ROWS = _values([(i, k, v) for i, (k, v) in enumerate(dm.NAME_KEYWORDS.items())], ["i", "kw", "domain"])
VOTED = f"""kws AS {KEYWORD_ROWS}, log AS ({CORPUS}),
found AS (SELECT query_id, unnest(tabs) AS tab, generate_subscripts(tabs, 1) AS i
  FROM (SELECT query_id, regexp_extract_all(lower(query_sql), '{SIMPLE}', 1) AS tabs FROM log)),
pieces AS (SELECT query_id, i, unnest(string_split(replace(tab, '.', '_'), '_')) AS piece,
  generate_subscripts(string_split(replace(tab, '.', '_'), '_'), 1) AS j FROM found),
ballots AS (SELECT query_id, i * 1000 AS ord, m.domain FROM found JOIN domain_map m ON m.name = string_split(tab, '.')[1]
  UNION ALL SELECT query_id, p.i * 1000 + j, s.domain FROM pieces p JOIN seeds s ON s.seed = piece
  UNION ALL SELECT query_id, 1000000000 + k.i, k.domain FROM log JOIN kws k ON contains(lower(coalesce(name, '') || ' ' || coalesce(tags, '')), kw)),
tally AS (SELECT query_id, domain, count(*) AS n, min(ord) AS ord FROM ballots GROUP BY 1, 2),
winners AS (SELECT query_id, domain FROM tally QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, ord) = 1),
vote AS (SELECT query_id, coalesce(domain, 'general') AS domain FROM log LEFT JOIN winners USING (query_id))"""


@query("vote_domain", f"WITH {MAP}, {VOTED} SELECT * FROM vote")
def _(t):
    return dm.vote_domain(t.corpus(), mapped(t)[1])


@query(
    "vote_domain_arrivals",
    f"""WITH {MAP}, {VOTED.replace(CORPUS, BY_ROW)}
SELECT a.query_id, vote.domain FROM vote JOIN ({ARRIVALS}) a ON a.pos = vote.query_id""",
)
def _(t):
    return dm.vote_domain(t.arrivals(), mapped(t)[1])


PAIRS = _values([(k, *v) for k, v in dm.DOMAIN_PAIRS.items()], ["domain", "g1", "g2"])


@query(
    "domain_pair",
    f"""WITH pairs AS {PAIRS}, p AS ({PREFIXES}), {seed_lookup('p')}
SELECT name, coalesce(g1, 'activity') AS g1, coalesce(g2, 'general') AS g2 FROM seeded LEFT JOIN pairs USING (domain)""",
)
def _(t):
    rows = dm.prefix_domain(t.sql(PREFIXES)).withColumn("p", dm.domain_pair("domain"))
    return rows.select("name", "p.g1", "p.g2")
