"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .corpus import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register `fn(inputs) -> DataFrame` under `name`; `check` is the same result
    as SQL over the given tables."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


GROUPS = [
    "ingesting",
    "texts",
    "popularity",
    "batching",
    "classifying",
    "matching",
    "registering",
    "replying",
    "evaluating",
]


def load_all() -> None:
    """Import every group of queries, which registers them."""
    for group in GROUPS:
        import_module(f"{__package__}.{group}")
