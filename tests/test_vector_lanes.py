"""Nearest vectors whose items pass by in several lanes: ties, ids that are null, vectors of two types."""

import numpy as np
import pytest

from logloom.operators import similarity


@pytest.mark.parametrize("lane_rows", [20, 1 << 17])
def test_ties_across_lanes(spark, lane_rows, monkeypatch):
    monkeypatch.setattr(similarity, "PENDING_ROWS", 50)
    monkeypatch.setattr(similarity, "PRODUCT_CELLS", 64)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 4))
    items = [(i if i else None, [float(x) for x in base[i % 40 if i % 3 else 0]]) for i in range(150)]  # a third is one vector
    queries = [(q, [float(np.float32(x)) for x in base[q] * (q + 1)]) for q in range(12)]
    queries.append((99, None))
    got = similarity.vector_topk(
        spark.createDataFrame(queries, "query_id long, embedding array<float>"),
        spark.createDataFrame(items, "item_id long, embedding array<double>"),
        k=5, pivots=6, item_rows=8, query_rows=4, lane_rows=lane_rows,
    )
    unit = lambda m: np.array(m) / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = np.round(unit([v for _, v in queries[:-1]]) @ unit([v for _, v in items]).T, 9)
    # the null id is the first row and comes before the other ids
    want = {(q, r + 1): items[i][0] for q in range(12) for r, i in enumerate(np.lexsort((np.arange(150), -cosine[q]))[:5])}
    assert {(r.query_id, r["rank"]): r.item_id for r in got.collect()} == want


def test_only_the_best_leave_a_task():
    """In 50 batches of items, a chunk of queries keeps k pairs a query and asks later equals to be better."""
    rng = np.random.default_rng(5)
    asked = similarity._unit(rng.normal(size=(20, 6)))
    nearest = similarity._Nearest(asked, np.full(20, -np.inf), 3)
    items = similarity._unit(rng.normal(size=(500, 6)))
    for low in range(0, 500, 10):
        nearest.add(items[low : low + 10], [(np.arange(20), np.arange(10))])
        assert len(nearest.row) == 60
    nearest.add(items[:10], [(np.arange(20), np.arange(10))])
    cosine = np.round(asked @ items.T, 9)
    want = [i for row in cosine for i in np.lexsort((np.arange(500), -row))[:3]]
    assert nearest.at.tolist() == want
