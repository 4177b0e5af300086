"""Queries over the toolbox, TF-IDF matching, nearest vectors and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WORD
from ..operators import domains as dm
from ..operators import similarity as sim
from ..operators import toolbox as tb
from ..session import held
from . import flows
from .catalog import query
from .classifying import DISTRIBUTION, PAIRS, VOTED, _values, mapped
from .corpus import CORPUS
from .popularity import SIMPLE
from .texts import SHAPE_V2_SQL

SEED_LISTS = _values(
    [
        (d, " ".join([k for k, v in dm.SEED_PREFIXES.items() if v == d]))
        for d in dict.fromkeys(dm.SEED_PREFIXES.values())
    ],
    ["domain", "words"],
)
TEMPLATES = _values([(i, *t) for i, t in enumerate(tb.templates())], ["k", "g5", "g3", "g4"])
TOOLBOX = f"""seed_lists AS {SEED_LISTS}, templates AS {TEMPLATES},
active AS (SELECT domain, row_number() OVER (ORDER BY "count" DESC, domain) - 1 AS d FROM distribution WHERE active),
made AS (SELECT a.d * 8 + t.k AS tool_ord, replace(t.g3, '{{domain}}', a.domain) AS g3, t.g4, t.g5, a.domain FROM active a CROSS JOIN templates t),
toolbox AS (SELECT made.*, made.domain || ' ' || g3 || ' ' || g4 || ' ' || coalesce(words, '') AS text FROM made LEFT JOIN seed_lists USING (domain))"""

# Gold rows: the private queries of one engine, labelled by owner.
GOLD_WHERE = "query_engine = 'v2 Spark SQL' AND is_private = 'true'"
GOLD_LABELS = "concat('gold_', replace(trim(lower(owner)), ' ', '_')) AS g3, 'day|value' AS g4, 'time_series' AS g5"


@query("generate_toolbox", f"WITH {DISTRIBUTION}, {TOOLBOX} SELECT * FROM toolbox")
def _(t):
    return tb.generate_toolbox(dm.domain_distribution(*mapped(t)))


WORDS = "|".join(tb.DOMAIN_WORDS)
FEATURES = f"""features AS (SELECT query_id, array_to_string(list_concat([coalesce(name, ''), coalesce(name, ''), coalesce(description, ''), coalesce(tags, '')],
  flatten(list_transform(coalesce(regexp_extract_all(lower(query_sql), '{SIMPLE}', 1), []),
    lambda t: list_concat([t, t, t], list_filter(string_split(replace(t, '.', '_'), '_'), lambda p: length(p) > 2)))),
  coalesce(regexp_extract_all(lower(query_sql), '\\b({WORDS})\\b', 1), [])), ' ') AS features FROM ({CORPUS}) c)"""


@query("feature_text", f"WITH {FEATURES} SELECT * FROM features")
def _(t):
    return tb.feature_text(t.corpus()).select("query_id", "features")


GOLD = f"""gold AS (SELECT row_number() OVER (ORDER BY query_id) AS pos, {GOLD_LABELS}, domain, features
  FROM log JOIN vote USING (query_id) JOIN features USING (query_id) WHERE {GOLD_WHERE}),
gold_tools AS (SELECT 1099511627776 + pos AS tool_ord, g3, g4, g5, domain,
  replace(g3, '_', ' ') || ' ' || replace(g3, '_', ' ') || ' ' || replace(g3, '_', ' ') || ' ' || g4 || ' ' || domain || ' ' || features AS text FROM gold),
tools AS (SELECT * FROM (SELECT * FROM toolbox UNION ALL SELECT * FROM gold_tools) QUALIFY row_number() OVER (PARTITION BY g3 ORDER BY tool_ord) = 1)"""
EVERYTHING = f"{DISTRIBUTION}, {TOOLBOX}, {VOTED}, {FEATURES}, {GOLD}"


def _toolbox(t):
    log = t.corpus()
    g3 = F.concat(F.lit("gold_"), F.replace(F.trim(F.lower("owner")), F.lit(" "), F.lit("_")))
    gold = log.filter(GOLD_WHERE).select(
        "query_id", g3.alias("g3"), F.lit("day|value").alias("g4"), F.lit("time_series").alias("g5")
    )
    return flows.build_toolbox(log, gold, t.arrivals())


@query("add_gold_tools", f"WITH {EVERYTHING} SELECT * FROM tools")
def _(t):
    return _toolbox(t).tools


def tfidf_sql(fit, source, key, name):
    """Vocabulary of `fit` (text rows) and weights of `source` (key, text) as CTE `name`."""

    def terms(src, columns):
        return f"""SELECT {columns} unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM (SELECT {columns} regexp_extract_all(lower(text), '({WORD}{{2,}})', 1) AS w FROM {src})"""

    vocabulary = f"""fit_rows AS (SELECT row_number() OVER () AS d, text FROM ({fit})),
fit_terms AS (SELECT d, term, count(*) AS tf FROM ({terms("fit_rows", "d,")}) GROUP BY 1, 2),
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM fit_rows)) / (1 + count(*))) + 1 AS idf FROM fit_terms GROUP BY 1)"""
    weights = f"""{name}_raw AS (SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM (SELECT {key}, term, count(*) AS tf FROM ({terms(source, key + ",")}) GROUP BY 1, 2)
  JOIN vocab USING (term)),
{name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_raw)"""
    return vocabulary, weights


_VOCAB, _WEIGHTS = tfidf_sql("SELECT text FROM documents UNION ALL SELECT text FROM benchmark", "documents", "doc_id", "weights")


def _doc_vocabulary(t):
    docs = t.spread(t.table("documents")).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    items = t.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("doc_id"), "text")
    return tb.fit_vocabulary(docs.unionByName(items))


@query("fit_vocabulary", f"WITH {_VOCAB} SELECT term, round(idf, 6) AS idf FROM vocab")
def _(t):
    return _doc_vocabulary(t).select("term", F.round("idf", 6).alias("idf"))


@query("tfidf", f"WITH {_VOCAB}, {_WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def _(t):
    rows = tb.tfidf(t.table("documents"), _doc_vocabulary(t))
    return rows.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def match_sql(asked, tools):
    """`asked`: query_id, domain, g5, text; `tools`: tool_ord, g3, g4, g5, domain, text."""
    vocab, t_weights = tfidf_sql(f"SELECT text FROM {tools} UNION ALL SELECT text FROM fit_gold", tools, "tool_ord", "tw")
    _, q_weights = tfidf_sql("", asked, "query_id", "qw")
    return f"""{vocab}, {t_weights}, {q_weights},
cosines AS (SELECT query_id, tool_ord, sum(qw.weight * tw.weight) AS c FROM qw JOIN tw USING (term) GROUP BY 1, 2),
scores AS (SELECT a.query_id, t.tool_ord, round(coalesce(c, 0) * CASE WHEN t.domain = a.domain THEN 1.5 ELSE 1 END
  * CASE WHEN t.g5 = a.g5 THEN 1.3 ELSE 1 END, 9) AS score FROM {asked} a CROSS JOIN {tools} t LEFT JOIN cosines x ON x.query_id = a.query_id AND x.tool_ord = t.tool_ord),
best AS (SELECT query_id, tool_ord, score FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tool_ord) = 1),
pair_rows AS {PAIRS},
matched AS (SELECT query_id, coalesce(p.g1, 'activity') AS g1, coalesce(p.g2, 'general') AS g2, t.g3, t.g4, t.g5, t.domain, round(score, 6) AS score
  FROM best JOIN {tools} t USING (tool_ord) LEFT JOIN pair_rows p ON p.domain = t.domain)"""


MATCHED = f"""{EVERYTHING}, asked AS (SELECT query_id, vote.domain, features AS text, {SHAPE_V2_SQL} AS g5
  FROM (SELECT *, lower(query_sql) AS q FROM log) JOIN vote USING (query_id) JOIN features USING (query_id)),
fit_gold AS (SELECT features AS text FROM gold), {match_sql('asked', 'tools')}"""


@query("match_toolbox", f"WITH {MATCHED} SELECT * FROM matched")
def _(t):
    return flows.match_log(_toolbox(t)).withColumn("score", F.round("score", 6))


# Documents matched with benchmark items as tools.
DOC_ASKED = "SELECT doc_id AS query_id, source AS domain, lang AS g5, text FROM documents"
DOC_TOOLS = """SELECT item_id AS tool_ord, concat('item_', CAST(item_id AS VARCHAR(20))) AS g3, 'text' AS g4,
  CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS g5, CASE item_id % 2 WHEN 0 THEN 'web' ELSE 'news' END AS domain, text FROM benchmark"""
DOC_MATCHED = f"""asked AS ({DOC_ASKED}), tools AS ({DOC_TOOLS}), fit_gold AS (SELECT text FROM documents), {match_sql('asked', 'tools')}"""


def _doc_matches(t):
    queries = t.spread(t.sql(DOC_ASKED)).withColumnRenamed("text", "features")
    tools = t.sql(DOC_TOOLS)
    return tb.match_toolbox(queries, tools, _doc_vocabulary(t)), tools


@query("match_documents", f"WITH {DOC_MATCHED} SELECT * FROM matched")
def _(t):
    return _doc_matches(t)[0].withColumn("score", F.round("score", 6))


_EFFICIENT = "CASE WHEN {n} > 1 THEN 0.5 / log2({n}) ELSE 0 END"
_KEPT, _ALL_N = "(SELECT count(*) FROM kept)", "(SELECT count(*) FROM tools)"


@query(
    "prune_toolbox",
    f"""WITH {DOC_MATCHED}, labelled AS (SELECT g3 FROM matched WHERE query_id IN (SELECT doc_id FROM labels)),
kept AS (SELECT g3 FROM tools WHERE g3 IN (SELECT g3 FROM labelled UNION SELECT g3 FROM matched))
SELECT g3, tool_ord FROM tools WHERE g3 IN (SELECT g3 FROM kept) OR NOT ({_EFFICIENT.format(n=_KEPT)} >= {_EFFICIENT.format(n=_ALL_N)})""",
)
def _(t):
    matches, tools = _doc_matches(t)
    matches = held(matches)
    labelled = matches.join(t.table("labels").select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    return tb.prune_toolbox(tools, labelled, matches, F.lit(0.5)).select("g3", "tool_ord")


# --- nearest ----------------------------------------------------------------


@query(
    "vector_topk",
    """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id,
  round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS c FROM embeddings a CROSS JOIN embeddings b)
SELECT query_id, item_id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS rank
FROM p QUALIFY rank <= 10""",
)
def _(t):
    rows = t.table("embeddings")
    return sim.vector_topk(
        rows.select(F.col("vec_id").alias("query_id"), "embedding"),
        rows.select(F.col("vec_id").alias("item_id"), "embedding"),
        k=10,
    )


ASKED_LABELS = "SELECT DISTINCT concat(lower(p_type), '_', replace(p_name, ' ', '_'), '_', CAST(p_size AS VARCHAR(20))) AS label FROM part"
KNOWN_LABELS = """SELECT DISTINCT concat(replace(p_name, ' ', '_'), '_', CAST(p_size % 7 AS VARCHAR(20))) AS label FROM part
UNION SELECT DISTINCT concat(lower(p_type), '_systems') FROM part"""


def nearest_sql(asked, known):
    grams = "list_distinct(list_concat(string_split(label, '_'), list_transform(range(1, len(string_split(label, '_'))), lambda i: string_split(label, '_')[i] || '_' || string_split(label, '_')[i + 1])))"
    return f"""SELECT a.label, b.label AS nearest, round(s, 6) AS score FROM (
  SELECT a.label, b.label AS other, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS s
  FROM (SELECT label, {grams} AS g FROM {asked}) a CROSS JOIN (SELECT label, {grams} AS g FROM {known}) b
  QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY s DESC, b.label) = 1) a JOIN {known} b ON b.label = a.other"""


@query("nearest_label", f"WITH asked AS ({ASKED_LABELS}), known AS ({KNOWN_LABELS}) {nearest_sql('asked', 'known')}")
def _(t):
    return sim.nearest_label(t.sql(ASKED_LABELS), t.sql(KNOWN_LABELS))

