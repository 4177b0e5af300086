"""Every registered query against the same question in SQL, over whole tables."""

import math

import pandas as pd
import pytest

import __spark_entry__ as entry_points
from logloom.plans import catalog

from .conftest import SF_DIR

QUERIES = catalog.QUERIES
CHECKS = catalog.CHECKS
# answers that may be empty on the smallest data
MAY_BE_EMPTY = {"drill_down", "top_tier", "mentions_table", "page", "route_multi_unseen"}


def cell(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return f"{float(value):.9g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in MAY_BE_EMPTY


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns[:2] == ["rank", "namespace"]
    assert result.count() > 0
