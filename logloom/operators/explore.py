"""Exploring the five-level taxonomy g1 … g5: facets, tree, label graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

FACETS = ["g1", "g2", "g3", "g5"]
LAYERS = ["g1", "g2", "g3", "g4"]
PATH = ["g1", "g2", "g3", "g4", "g5"]


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumns({g: F.lower(strip(g)) for g in FACETS})


def _chosen(df: DataFrame, values: Sequence[str]) -> DataFrame:
    tests = [F.col(g) == F.lit(v) for g, v in zip(FACETS, values)]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def facet_options(df: DataFrame, path: Sequence[str] = ()) -> DataFrame:
    """Sorted values of the level after `path` (values of g1, g2, g3 in turn)."""
    level = FACETS[len(path)]
    rows = _chosen(_normal(df), path).filter(F.col(level).isNotNull())
    return rows.select(F.col(level).alias("option")).distinct().orderBy("option")


def drill_down(df: DataFrame, g1: str, g2: str, g3: str, g5: str) -> DataFrame:
    """Queries of one taxonomy cell; their number is `.count()`."""
    return _chosen(_normal(df), [g1, g2, g3, g5]).select("query_id", *FACETS)


def taxonomy_tree(df: DataFrame) -> DataFrame:
    """(depth, path, parent, name, value): a node per prefix of g1 … g5 and the root.

    value is the number of distinct full paths below, 1 for a leaf: the paths are
    made distinct first, and the rollup then counts them.
    """
    paths = df.select(*[F.coalesce(F.col(g), F.lit("")).alias(g) for g in PATH]).distinct()
    nodes = paths.rollup(*PATH).agg(F.count(F.lit(1)).alias("value"), F.grouping_id().alias("_gid"))
    # grouping_id has one bit per level rolled up: 31 is the root, 0 a leaf
    depth = F.lit(len(PATH)) - F.bit_count("_gid")
    steps = F.slice(F.array(*PATH), F.lit(1), depth)
    parent = F.when(depth > 0, F.concat_ws("/", F.lit("root"), F.slice(F.array(*PATH), F.lit(1), depth - 1)))
    return nodes.select(
        depth.cast("int").alias("depth"),
        F.concat_ws("/", F.lit("root"), steps).alias("path"),
        parent.alias("parent"),
        F.when(depth > 0, F.element_at(steps, -1)).otherwise("root").alias("name"),
        "value",
    ).orderBy("depth", "parent", F.desc("value"), "name")


def label_cooccurrence(df: DataFrame, layer: str = "all") -> DataFrame:
    """(label_a, label_b, count): queries per ordered pair of different labels; on
    the diagonal the occurrences of a label.

    Pairs are formed from the four labels inside a row, at most 16 per query.
    """
    if layer == "all":
        labels = F.array(*LAYERS)
    else:
        labels = F.array(f"g{layer}")
    rows = df.select(labels.alias("_l")).select("_l", F.posexplode("_l").alias("_i", "label_a"))
    rows = rows.select("_i", "label_a", F.posexplode("_l").alias("_j", "label_b"))
    rows = rows.filter((F.col("_i") == F.col("_j")) | (F.col("label_a") != F.col("label_b")))
    return rows.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("count"))


def label_edges(df: DataFrame) -> DataFrame:
    """(query_id, label): which query has which label, in long form."""
    return df.select("query_id", F.explode(F.array_distinct(F.array(*LAYERS))).alias("label")).filter(
        F.col("label").isNotNull()
    )


def label_index(df: DataFrame) -> DataFrame:
    """(label, n_queries).  The queries of a label are its rows in label_edges."""
    return label_edges(df).groupBy("label").agg(F.countDistinct("query_id").alias("n_queries"))


def label_nodes(df: DataFrame) -> DataFrame:
    """(id, kind): queries and labels as nodes of one graph; edges are label_edges."""
    queries = df.select(F.col("query_id").cast("string").alias("id"), F.lit("query").alias("kind")).distinct()
    labels = label_index(df).select(F.concat(F.lit("g_"), "label").alias("id"), F.lit("label").alias("kind"))
    return queries.union(labels)
