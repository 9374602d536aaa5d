"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Each query runs once
to warm up the JVM and the Python workers, then twice; the better run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from dwellspark.plans.registered import QUERIES  # noqa: E402
from dwellspark.session import local_session  # noqa: E402

HEADLINE = [
    "knn_top10", "knn_batch", "knn_many_queries", "max_sim_batch", "fuse_max_sim_top10", "rank_all", "search_filtered", "search_text",
    "clean_text_documents", "clean_text_pages", "clean_listings", "structured_text", "payload_json", "hash_embed",
    "dedup_by_key", "upsert_listings", "upsert_vectors", "ingest", "compare_rankings", "compare_models", "display_card",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times = {}
    for name in HEADLINE:
        run(spark, name, folder)
        times[name] = round(min(run(spark, name, folder) for _ in range(2)), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
