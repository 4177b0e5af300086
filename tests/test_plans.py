"""Properties of physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry_points
from logloom.operators import cleaning, features, popularity, routing
from logloom.sources import log

from .conftest import SF_DIR

QUERIES = entry_points.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def query_log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    rows = [(i, i, "n", "d", "select 1 from dex.trades join prices.usd on 1=1", "o") for i in range(50)]
    schema = "query_id long, pos long, name string, description string, query_sql string, owner string"
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "name",
    ["route_multi", "query_domain", "popular_pairs", "top_pairs_uncapped", "match_toolbox", "prefix_domain", "vector_topk", "nearest_label", "admit_labels", "generate_toolbox", "token_cost", "label_cooccurrence"],
)
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    text = plan(QUERIES["scan_log"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_null_filter_reaches_the_scan(query_log):
    text = plan(cleaning.drop_short_sql(query_log))
    assert "PushedFilters: [IsNotNull(query_sql)]" in text


def test_routing_does_not_shuffle_the_log(spark, query_log):
    popular = spark.createDataFrame([("dex", "trades", "dex.trades")], "namespace string, `table` string, full_name string")
    text = plan(routing.route_multi(query_log, popular))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_texts_are_scanned_once(query_log):
    assert plan(popularity.query_tables(query_log)).count("regexp_extract_all") == 1
    # one pass for the two comment kinds, not one per flag
    text = plan(features.shape_v1(query_log).select("g5"))
    assert len(re.findall(r"--\[\^\\n\]", text)) == 1


def test_clean_decides_over_numbers(query_log):
    # positions, ids and hashes alone are aggregated, by hash; the log itself is neither sorted nor shuffled
    text = plan(cleaning._first_texts(cleaning._first_ids(cleaning._facts(query_log, "pos", 10))))
    assert text.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in text
    assert "ReadSchema: struct<query_id:bigint,pos:bigint,query_sql:string>" in text
    text = plan(cleaning.clean(query_log))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "Sort" not in text


@pytest.mark.parametrize("name", ["query_domain", "classify_rules", "vote_domain"])
def test_classification_stays_in_the_row(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "Generate" not in text and "Exchange hashpartitioning" not in text.split("Subquery")[0]


def test_page_sorts_ids_only(query_log):
    assert "ReadSchema: struct<query_id:bigint,name:string,query_sql:string>" in plan(log.page(query_log, 5, 5))
