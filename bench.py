"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# The first builds the keyword index that the searches after it read.
HEADLINE = (
    "keyword_index", "bm25_search", "phrase_search", "dense_search", "rrf_fusion", "hybrid_search", "page_dedup_topk",
    "admission_funnel", "sensitive_content", "page_text", "chunks", "vector_topk", "related_pages",
    "entity_frequency", "cooccurrence", "visit_changes", "page_upsert", "dwell_batch", "chat_queries",
    "context_blocks", "ingest_outcomes",
)


def main() -> None:
    from trailmark.session import build_session
    from workload.registry import ALL

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
        },
    )
    # Warm the JVM and the Python workers on the smallest tables, then time each query once.
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if os.path.isdir(warm_dir):
        for name in names:
            ALL[name][0](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        ALL[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "settings": "AQE on, shuffle.partitions = cpus, warmed up on sf0.001, then one timed run of each query",
    }))


if __name__ == "__main__":
    main()
