"""The tool registry: tools (one row each) and links (one row per listed id).

A tool can be found in a third of all queries, so its id lists are not arrays in
one row but rows (tool_id, kind, value) with kind `source` or `combines`.  The
distinct union of two lists is then a distinct over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, slugify, strip

TOOL_FIELDS = ["g1", "g2", "g3", "g4", "g5", "description", "scope", "returns", "viz", "inputs"]
INPUT_SCHEMA = "array<struct<key:string,label:string,type:string,required:boolean,default:string>>"


def merge_tools(tools: DataFrame, new: DataFrame) -> DataFrame:
    """Tools keyed by (g1, g3): one that exists keeps its fields, a new one gets the
    id `g1.g3`; of equal new ones the first (by pos) counts.  Rows without g1 or g3
    are skipped."""
    fields = [c for c in tools.columns if c not in ("tool_id", "g1", "g3")]
    valid = _keyed(new)
    key_first = valid.groupBy("g1", "g3").agg(
        F.min_by(F.struct(*[F.col(c) for c in fields]), "pos").alias("_n")
    )
    old = tools.select("g1", "g3", F.struct("tool_id", *fields).alias("_o"))
    return old.join(key_first, ["g1", "g3"], "full_outer").select(
        F.coalesce("_o.tool_id", F.concat_ws(".", "g1", "g3")).alias("tool_id"),
        "g1",
        "g3",
        *[F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")).alias(c) for c in fields],
    )


def merge_links(tools: DataFrame, links: DataFrame, new: DataFrame) -> DataFrame:
    """Links after merge_tools; `new` has arrays source_query_ids and combines per row."""
    ids = tools.select("g1", "g3", "tool_id").distinct()  # a tool that is there twice must not repeat its rows
    rows = _keyed(new).join(ids, ["g1", "g3"], "left")
    target = F.coalesce("tool_id", F.concat_ws(".", "g1", "g3")).alias("tool_id")
    listed = lambda kind, column: F.transform(
        F.coalesce(column, F.array().cast("array<string>")),
        lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")),
    )
    both = F.concat(listed("source", "source_query_ids"), listed("combines", "combines"))
    return links.select("tool_id", "kind", "value").union(rows.select(target, F.inline(both))).distinct()


def _keyed(new: DataFrame) -> DataFrame:
    rows = new.withColumns({"g1": strip("g1"), "g3": strip("g3")})
    return rows.filter(~(blank("g1") | blank("g3")))


def upsert_by_g3(tools: DataFrame, new: DataFrame) -> DataFrame:
    """Tools keyed by g3 alone: a new one has the slug of g3 as its id and g5 as
    its description."""
    first = new.groupBy("g3").agg(F.min_by(F.struct("g1", "g2", "g4", "g5", "inputs"), "pos").alias("_n"))
    fields = ["g1", "g2", "g4", "g5", "inputs"]
    old = tools.select("g3", F.struct("tool_id", "description", *fields).alias("_o"))
    there = F.col("_o").isNotNull()
    return old.join(first, "g3", "full_outer").select(
        F.when(there, F.col("_o.tool_id")).otherwise(slugify("g3")).alias("tool_id"),
        "g3",
        *[F.when(there, F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")).alias(c) for c in fields],
        F.when(there, F.col("_o.description")).otherwise(F.col("_n.g5")).alias("description"),
    )


def upsert_links(tools: DataFrame, links: DataFrame, new: DataFrame) -> DataFrame:
    """Source links after upsert_by_g3: the query id is added to its tool once."""
    ids = tools.groupBy("g3").agg(F.min("tool_id").alias("tool_id"))
    rows = new.join(ids, "g3", "left").select(
        F.coalesce("tool_id", slugify("g3")).alias("tool_id"),
        F.lit("source").alias("kind"),
        F.col("query_id").cast("string").alias("value"),
    )
    return links.select("tool_id", "kind", "value").union(rows).distinct()


def _source_counts(links: DataFrame) -> DataFrame:
    rows = links.filter(F.col("kind") == "source")
    return rows.groupBy("tool_id").agg(F.count(F.lit(1)).alias("source_count"))


def registry_listing(tools: DataFrame, links: DataFrame) -> DataFrame:
    """tool_id, g3, g4, description, inputs, source_count and slim JSON, by g1, g2, g3."""
    counted = tools.join(_source_counts(links), "tool_id", "left")
    slim = F.to_json(F.struct("g3", "g4", "description"))
    return counted.orderBy("g1", "g2", "g3", "tool_id").select(
        "tool_id",
        "g3",
        "g4",
        "description",
        "inputs",
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        slim.alias("slim"),
    )


def find_by_g3(tools: DataFrame, g3: str) -> DataFrame:
    return tools.filter(F.col("g3") == g3).orderBy("tool_id").limit(1)


def domains_listing(domains: DataFrame) -> DataFrame:
    return domains.orderBy("domain_id").select("name", "description")


def apply_usage(tools: DataFrame, events: DataFrame) -> DataFrame:
    """Adds the events (tool_id, used_at) to usage_count and last_used_at."""
    used = events.groupBy("tool_id").agg(F.count(F.lit(1)).alias("_n"), F.max("used_at").alias("_last"))
    return (
        tools.join(used, "tool_id", "left")
        .withColumn("usage_count", F.col("usage_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("last_used_at", F.greatest("last_used_at", "_last"))
        .drop("_n", "_last")
    )


def popularity_score(usage: Column, sources: Column) -> Column:
    return F.log1p(usage) * 0.6 + F.log1p(sources) * 0.4


def popularity(tools: DataFrame, links: DataFrame) -> DataFrame:
    """(tool_id, popularity) from usage_count and the number of source queries."""
    counted = tools.join(_source_counts(links), "tool_id", "left")
    sources = F.coalesce("source_count", F.lit(0))
    return counted.select(
        "tool_id", F.round(popularity_score(F.col("usage_count"), sources), 6).alias("popularity")
    )


def tool_inputs(inputs: Column) -> Column:
    """JSON text of a tool's inputs -> typed array."""
    return F.from_json(inputs, INPUT_SCHEMA)


def add_source_query(source_queries: Column, query_id: Column) -> Column:
    """JSON list text with the id appended unless it is there."""
    ids = F.from_json(source_queries, "array<string>")
    return F.to_json(F.when(F.array_contains(ids, query_id), ids).otherwise(F.array_append(ids, query_id)))


def tool_json(tools: DataFrame) -> DataFrame:
    """(tool_id, node): JSON of tool_id, name = g3, description and typed inputs."""
    node = F.struct("tool_id", F.col("g3").alias("name"), "description", tool_inputs(F.col("inputs")).alias("inputs"))
    return tools.select("tool_id", F.to_json(node, {"ignoreNullFields": "false"}).alias("node"))
