"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is run to a full result (every row and column is computed, nothing is
collected).  One untimed run of a query that is not listed starts the engine first.
"""

from __future__ import annotations

import json
import os
import time

from logloom.plans import catalog
from logloom.session import local_session

HEADLINE = [
    "impact",
    "clean",
    "clean_audit",
    "popular_pairs",
    "basket_pairs",
    "basket_top_triples",
    "route_multi",
    "pack_rows_tokens",
    "chunk_bytes",
    "query_domain",
    "classify_rules",
    "vote_domain",
    "tfidf",
    "match_toolbox",
    "match_documents",
    "vector_topk",
    "merge_links",
    "admit_labels",
    "parse_tools_md",
    "taxonomy_tree",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()

    def run(name: str) -> float:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("popular_tables")
    times = {name: round(run(name), 3) for name in HEADLINE}
    spark.stop()
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
