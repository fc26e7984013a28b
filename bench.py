"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
Each query runs once to warm up and is then timed as a whole, its result written to a sink that
keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "importance_topk", "degree_counts", "edge_profile", "impact_radius", "call_chains_down", "containment_tree", "edge_resolution", "branch_expand", "relationship_groups", "directory_overview",
    "upsert_last_wins", "cascade_delete", "dangling_edges", "code_refs", "file_diff", "tokenize", "tfidf_top_terms", "bm25_search", "redact_documents", "vector_topk", "nearest_neighbors", "semantic_rank", "event_sessions",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from weftgraph.plans import registry

    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    total = round(sum(times.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
