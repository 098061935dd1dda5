"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gleaner.plans.queries import QUERIES
from gleaner.session import session

#: Scan-shaped and kernel-shaped queries, one or two of each family.
HEADLINE = [
    "surprising_events",
    "surprise_scores",
    "complexity_profile",
    "cascade",
    "cosine_top",
    "similarity_graph",
    "semantic_drift",
    "window_drift",
    "purified_edges",
    "matrix_vector",
    "connected_components",
    "change_impact",
    "keyword_scores",
    "character_vectors",
    "count_min_estimates",
    "linear_selection",
    "solve_greedy",
    "solve_ising_sa",
    "rerank_diverse",
    "rerank_flow",
    "memory_search",
    "memory_recall",
    "prompt_context",
]


def main() -> None:
    where = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["surprising_events"](spark, where).collect()  # the JVM's first query
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(where.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
