"""The operators put together: report, export, extraction round, classification.

Each flow is one chain of DataFrames.  State (registry, links, ledger) goes in
and comes out as DataFrames; the caller writes it where it wants.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as sx
from ..functions.ordering import dense_position
from ..operators import (
    cleaning,
    domains,
    incremental,
    packing,
    popularity,
    registry,
    replies,
    routing,
    toolbox,
)
from ..session import held, small_side
from ..sources import files

MODES = {"single": routing.route_single, "multi": routing.route_multi}


def popularity_report(log: DataFrame, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(cleaned log, tables with share, running share and tier)."""
    cleaned = cleaning.clean(log, pos)
    return cleaned, popularity.impact(popularity.popular_tables(cleaned))


def export_by_table(log: DataFrame, impact_rows: DataFrame, path: str, chunk_mb: float = 40.0) -> DataFrame:
    """Write the queries of each top table as INSERT files of at most `chunk_mb`
    below path/<mode>/full_name=…/file_name=…; returns rows and bytes per file.  Every
    row of the log counts, also without an id or with a repeated one."""
    top = held(popularity.top_tier(impact_rows))
    order, limit, reports = ["query_id", "row_no"], int(chunk_mb * 1_048_576), []
    for mode, route in MODES.items():
        # a query has another text here: its INSERT, which the packer measures
        rows = files.render_inserts(route(log, top)).select("full_name", "query_id", "statement")
        rows = held(rows.withColumn("row_no", F.monotonically_increasing_id()))
        chunks = held(packing.chunk_bytes(rows, limit, "full_name", order, "statement"))
        packing.write_chunks(rows, chunks, f"{path}/{mode}", "full_name", order, "statement")
        report = chunks.groupBy("full_name", "file_name").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes")
        )
        reports.append(report.withColumn("mode", F.lit(mode)))
    return reports[0].unionByName(reports[1])


class Toolbox(NamedTuple):
    queries: DataFrame  # query_id, features, domain, g5
    gold: DataFrame  # pos, g3, g4, g5, domain, features
    tools: DataFrame  # tool_ord, g3, g4, g5, domain, text


def build_toolbox(log: DataFrame, gold: DataFrame, *more_logs: DataFrame) -> Toolbox:
    """Learn the domain map from the logs, give each query features, a domain and a
    shape, and make the toolbox: templates of the active domains and the gold tools.

    `gold` has query_id, g3, g4, g5 of labelled queries of the log.
    """
    counts = popularity.prefix_counts(log, *more_logs)
    mapping = held(domains.domain_map(counts))
    voted = domains.with_votes(sx.add_shape_v2(toolbox.feature_text(log)))
    queries = held(domains.with_domain(voted.select("query_id", "features", "g5", "_votes"), mapping))
    labelled = gold.select("query_id", "g3", "g4", F.col("g5").alias("_g5")).join(queries, "query_id")
    labelled = dense_position(labelled, "query_id", name="pos").select(
        "pos", "g3", "g4", F.col("_g5").alias("g5"), "domain", "features"
    )
    made = toolbox.generate_toolbox(domains.domain_distribution(counts, mapping))
    return Toolbox(queries, labelled, held(toolbox.add_gold_tools(made, labelled)))


def match_log(box: Toolbox, max_features: int | None = None) -> DataFrame:
    """Best tool of every row; the vocabulary is fitted on tools and gold rows."""
    texts = box.tools.select(F.concat(F.lit("t"), "tool_ord").alias("doc_id"), "text").unionByName(
        box.gold.select(F.concat(F.lit("g"), "pos").alias("doc_id"), F.col("features").alias("text"))
    )
    vocabulary = held(toolbox.fit_vocabulary(texts, max_features))
    return toolbox.match_toolbox(box.queries, box.tools, vocabulary)


class Registry(NamedTuple):
    tools: DataFrame
    links: DataFrame
    ledger: DataFrame


def extract_round(
    log: DataFrame,
    impact_rows: DataFrame,
    state: Registry,
    model: Callable[[str], str],
    rows: int = 900,
    tokens: int = 800_000,
    max_len: int | None = None,
    ask: Ask | None = None,
) -> Registry:
    """One round over all queries of the top tables that are not seen yet: pack per
    table (single-table queries first), prompt, call the model, read its tools,
    merge them and mark the queries of every batch that gave tools.
    `ask` (prompts, known ids -> replies) makes the calls; by default `model` is called once for each prompt.

    A query goes to the model once, under the first of its tables by rank; rows without an id
    go too, but the ledger cannot name them.
    The replies are held: a model call is dear and must not be made again.
    """
    top = held(popularity.top_tier(impact_rows))
    seen = held(incremental.seen_ids(state.ledger, state.links))
    # a row has one mode, so mode and row number tell it apart
    numbered = log.withColumn("row_no", F.monotonically_increasing_id())
    parts = [
        route(numbered, top, max_len, seen).select(
            "full_name", F.lit(i).alias("mode_no"), F.col("query_id").cast("string").alias("query_id"), "row_no", "name", "query_sql"
        )
        for i, route in enumerate(MODES.values())
    ]
    every = held(parts[0].unionByName(parts[1]))
    order = ["mode_no", "query_id", "row_no"]
    ranked = every.select("mode_no", "row_no", "full_name").join(small_side(top.select("full_name", "rank")), "full_name")
    first = ranked.groupBy("mode_no", "row_no").agg(F.min_by("full_name", "rank").alias("full_name"))
    routed = held(every.join(first, ["mode_no", "row_no", "full_name"], "left_semi").select(*every.columns))
    packed = packing.pack_rows_tokens(routed, rows, tokens, "full_name", order)
    batch_id = F.concat_ws("#", "full_name", F.col("batch_no").cast("string"))
    placed = packed.select("full_name", "mode_no", "row_no", "batch_no")
    members = held(
        routed.join(placed, ["full_name", "mode_no", "row_no"]).select(
            batch_id.alias("batch_id"), F.struct(*order).alias("position"), "query_id", "name", "query_sql"
        )
    )
    return _merged(state, members, replies.build_prompts(members), ask or _calls(model))


#: Makes the model's calls: (prompts, text before each prompt) -> batch_id, reply_text, error.
Ask = Callable[[DataFrame, str], DataFrame]


def _calls(model: Callable[[str], str]) -> Ask:
    return lambda prompts, known: replies.infer_batches(prompts, model, known=known)


def _merged(state: Registry, members: DataFrame, prompts: DataFrame, ask: Ask) -> Registry:
    """The state after the replies to these prompts; members of batches that gave tools are seen."""
    told = held(ask(prompts, replies.known_block(state.tools)))
    found = held(replies.parse_tools_md(told.filter(F.col("error").isNull())))
    new = found.withColumns(
        {
            "pos": F.struct("batch_id", "section_no"),
            "returns": F.to_json("returns"),
            "inputs": F.to_json("inputs"),
        }
    )
    answered = members.join(found.select("batch_id").distinct(), "batch_id", "left_semi")
    ids = answered.where("query_id IS NOT NULL").select("query_id", F.current_timestamp().alias("seen_at"))
    return Registry(
        registry.merge_tools(state.tools, new),
        registry.merge_links(state.tools, state.links, new),
        incremental.mark_seen(state.ledger, ids),
    )


def composite_round(
    log: DataFrame,
    state: Registry,
    done: DataFrame,
    model: Callable[[str], str],
    groups: dict[str, list[tuple[str, str]]] = routing.COMPOSITE_GROUPS,
    k: int = 40,
    seed: str = "0",
    ask: Ask | None = None,
) -> tuple[Registry, DataFrame]:
    """One prompt for each group of tables that is not in `done` (group_name), with a sample of the
    unseen queries of its tables, each once; returns the state and the finished groups.

    A group is finished once its prompt was answered, or if it has no unseen query; one whose call
    failed stays open.
    """
    fresh = incremental.remaining(log.where("query_id IS NOT NULL"), incremental.seen_ids(state.ledger, state.links))
    members = routing.composite_members(log.sparkSession, groups)
    picked = held(routing.sample_composites(fresh, members, k, seed, done))
    texts = fresh.join(picked.select("query_id").distinct(), "query_id", "left_semi")
    texts = texts.groupBy("query_id").agg(F.min(F.struct("name", "query_sql")).alias("q"))  # an id may be repeated
    rows = held(
        picked.join(texts, "query_id").select(
            F.col("group_name").alias("batch_id"),
            F.struct("member_no", "query_id").alias("position"),
            F.col("query_id").cast("string").alias("query_id"),
            "q.name",
            "q.query_sql",
        )
    )
    told: list[DataFrame] = []

    def noted(prompts: DataFrame, known: str) -> DataFrame:
        told.append(held((ask or _calls(model))(prompts, known)))
        return told[0]

    after = _merged(state, rows, replies.build_prompts(rows, heading="Source queries"), noted)
    failed = told[0].where("error IS NOT NULL").select(F.col("batch_id").alias("group_name"))
    every = members.select("group_name").distinct().join(failed, "group_name", "left_anti")
    return after, held(done.select("group_name").union(every).distinct())


class Drained(NamedTuple):
    state: Registry
    tables: DataFrame  # full_name of the finished tables
    groups: DataFrame  # group_name of the finished composite groups
    rounds: int  # rounds that were committed, in this run and before
    open_tables: int


_PARTS = {"tables": "full_name string", "groups": "group_name string"}


def extract_drained(
    log: DataFrame,
    impact_rows: DataFrame,
    state: Registry,
    model: Callable[[str], str],
    path: str,
    *,
    rows: int = 900,
    tokens: int = 800_000,
    max_len: int | None = None,
    groups: dict[str, list[tuple[str, str]]] | None = routing.COMPOSITE_GROUPS,
    k: int = 40,
    max_rounds: int | None = None,
    **calls,
) -> Drained:
    """Rounds over the top tables until each is finished, then the composite pass.

    A table is finished when none of its queries is unseen; queries of failed calls are sent again in the next round.
    It ends when all tables are finished, or when a round finishes no table and marks no query
    (the model keeps failing), or after `max_rounds`.  Rows without an id go to the model in the first round
    only, since no ledger can name them.

    `path` keeps the state: each round writes all its tables below ``round=N`` and is then committed by one
    row in ``commits``.  A run that was killed goes on from the last committed round, and replies stand in
    ``replies``, so a repeated round neither asks nor enters anything twice.  `calls` goes to `infer_stored`.
    """
    spark = log.sparkSession
    top = held(popularity.top_tier(impact_rows))
    ask: Ask = lambda prompts, known: replies.infer_stored(prompts, model, f"{path}/replies", known=known, **calls)

    def load(n: int) -> tuple[Registry, DataFrame, DataFrame]:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/round={n}/{name}")
        kept = Registry(*[read(f, getattr(state, f).schema) for f in Registry._fields])
        return kept, *[read(name, schema) for name, schema in _PARTS.items()]

    def commit(n: int, kept: Registry, tables: DataFrame, finished_groups: DataFrame) -> tuple[Registry, DataFrame, DataFrame]:
        parts = {**kept._asdict(), "tables": tables, "groups": finished_groups}
        for name, part in parts.items():
            columns = getattr(state, name).columns if name in Registry._fields else part.columns
            part.select(*columns).write.mode("overwrite").parquet(f"{path}/round={n}/{name}")
        spark.createDataFrame([(n,)], "round int").coalesce(1).write.mode("append").parquet(f"{path}/commits")
        return load(n)

    last = replies.read_or_empty(spark, f"{path}/commits", "round int").agg(F.max("round")).first()[0]
    if last is None:
        empty = [spark.createDataFrame([], schema) for schema in _PARTS.values()]
        last, (now, finished, done) = 0, commit(0, state, *empty)
    else:
        now, finished, done = load(last)
    named = log.where("query_id IS NOT NULL")
    routed = [route(named, top, max_len).select("full_name", "query_id") for route in MODES.values()]
    routed = held(routed[0].unionByName(routed[1]).distinct())
    began = last

    def open_tables() -> DataFrame:
        return top.join(finished, "full_name", "left_anti")

    while max_rounds is None or last - began < max_rounds:
        pending = held(open_tables())
        if pending.isEmpty():
            break
        sent = named if last else log
        after = extract_round(sent, pending, now, model, rows, tokens, max_len, ask)
        ledger = held(after.ledger)
        drained = held(incremental.drained_tables(pending, routed, incremental.seen_ids(ledger, after.links), finished))
        if drained.isEmpty() and ledger.count() == now.ledger.count():
            break
        now, finished, done = commit(last + 1, after._replace(ledger=ledger), finished.unionByName(drained.select("full_name")), done)
        last += 1
    if groups and not routing.composite_members(spark, groups).join(done, "group_name", "left_anti").isEmpty():
        after, closed = composite_round(log, now, done, model, groups, k, ask=ask)
        now, finished, done = commit(last + 1, after, finished, closed)
        last += 1
    return Drained(now, finished, done, last, open_tables().count())
