"""Predictions against gold labels, and the size of the toolbox in use.

pred and gold have query_id and labels g1 … g5; gold is a small labelled set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ["g1", "g2", "g3", "g4", "g5"]


def _both(pred: DataFrame, gold: DataFrame, labels: Sequence[str]) -> DataFrame:
    want = gold.select("query_id", *[F.col(g).alias(f"{g}_actual") for g in labels])
    return want.join(pred.select("query_id", *labels), "query_id", "left")


def label_accuracy(pred: DataFrame, gold: DataFrame, labels: Sequence[str] = ("g3", "g4", "g5")) -> DataFrame:
    """(label, hits, total, accuracy), all labels in one pass."""
    hit = lambda g: F.count_if(F.col(g) == F.col(f"{g}_actual"))
    sums = _both(pred, gold, labels).agg(F.count(F.lit(1)).alias("total"), *[hit(g).alias(g) for g in labels])
    rows = F.array(*[F.struct(F.lit(g).alias("label"), F.col(g).alias("hits")) for g in labels])
    return sums.select(F.inline(rows), "total").withColumn(
        "accuracy", F.round(F.try_divide(F.col("hits"), F.col("total")), 6)
    )


def side_by_side(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold fields, gold labels as g*_actual, predicted labels as g*."""
    fields = [c for c in gold.columns if c not in LABELS]
    want = gold.select(*fields, *[F.col(g).alias(f"{g}_actual") for g in LABELS])
    return want.join(pred.select("query_id", *LABELS), "query_id", "left")


def _right() -> Column:
    both = (F.col("g3") == F.col("g3_actual")) & (F.col("g4") == F.col("g4_actual"))
    return F.coalesce(both, F.lit(False))


def coverage(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(hits, total, coverage): share of gold rows with g3 and g4 right."""
    rows = _both(pred, gold, ["g3", "g4"])
    out = rows.agg(F.count_if(_right()).alias("hits"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("coverage", F.round(F.try_divide(F.col("hits"), F.col("total")), 6))


def coverage_misses(pred: DataFrame, gold: DataFrame, order: str = "query_id", first: int | None = None) -> DataFrame:
    """The misses, or those among the first rows of the gold set."""
    head = gold if first is None else gold.orderBy(order).limit(first)
    return _both(pred, head, ["g3", "g4"]).filter(~_right())


def toolbox_efficiency(pred: DataFrame, covered: Column | None = None) -> DataFrame:
    """(toolbox_size, efficiency, weighted): distinct (g3, g4); 1 / log2(size); and
    coverage / log2(size) when the coverage is given."""
    size = pred.agg(F.countDistinct("g3", "g4").alias("toolbox_size"))
    bits = F.log2(F.greatest("toolbox_size", F.lit(2)))
    weighted = F.lit(0.0) if covered is None else F.when(F.col("toolbox_size") > 1, covered / bits).otherwise(0.0)
    return size.select("toolbox_size", F.round(1 / bits, 6).alias("efficiency"), F.round(weighted, 6).alias("weighted"))


def label_distribution(pred: DataFrame, label: str) -> DataFrame:
    """(label, count, pct) of one column."""
    total = pred.agg(F.count(F.lit(1))).scalar()
    counts = pred.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.round(F.col("count") / total * 100, 4))


def top_labels(pred: DataFrame, labels: Sequence[str], k: int) -> DataFrame:
    """The k most common label combinations."""
    counts = pred.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), *labels).limit(k)
