"""The registry's links are made distinct in parts that follow their number."""

from logloom.operators import registry
from logloom.plans import corpus


def _tables(spark, path):
    supplier = [(i, f"Supplier#{i:03d}", i % 5) for i in range(20)] + [(None, "none", 1)]
    lineitem = [(i % 90 if i % 11 else None, i % 23) for i in range(1200)]
    spark.createDataFrame(supplier, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame(lineitem, "l_partkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")
    spark.range(5).selectExpr("cast(id AS int) AS n_nationkey").write.parquet(f"{path}/nation.parquet")
    spark.range(5).selectExpr("id AS p_partkey").write.parquet(f"{path}/part.parquet")
    return corpus.Inputs(spark, str(path))


def test_links_are_dealt_out_before_they_are_made_distinct(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "DISTINCT_ROWS", 500, raising=False)
    t = _tables(spark, tmp_path)
    links = t.links()
    assert links.rdd.getNumPartitions() == 3
    assert set(map(tuple, links.collect())) == set(map(tuple, t.sql(corpus.LINKS).collect()))
    assert links.count() == t.sql(corpus.LINKS).count()


def test_a_tool_that_is_there_twice_does_not_repeat_rows(spark):
    tools = spark.createDataFrame([("x", "g", "a")] * 30, "g1 string, g3 string, tool_id string").select("g1", "g3", "tool_id")
    links = spark.createDataFrame([], "tool_id string, kind string, value string")
    new = spark.createDataFrame([("x", "g", ["1", "2"], None)], "g1 string, g3 string, source_query_ids array<string>, combines array<string>")
    met, real = [], type(new).union

    def union(self, other):
        met.append(other.count())
        return real(self, other)

    type(new).union = union
    try:
        out = registry.merge_links(tools, links, new)
    finally:
        type(new).union = real
    assert met == [2]
    assert sorted(map(tuple, out.collect())) == [("a", "source", "1"), ("a", "source", "2")]
