"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3; the median of the runs after one warm-up counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quillmesh import plans  # noqa: E402
from quillmesh.session import local_session  # noqa: E402

HEADLINE = [
    "privacy_sanitize",
    "privacy_pii_spans",
    "privacy_split_sentences",
    "chunk_tokens",
    "chunk_hierarchical",
    "search_knn_cosine",
    "search_bm25",
    "search_federated_bm25",
    "fuse_merge_rrf_worst",
    "fuse_rrf",
    "metric_retrieval_means",
    "metric_rouge_n",
    "metric_chrf",
    "split_iid",
    "split_dirichlet",
    "holdout_ordered_ts",
    "graph_profile",
    "params_weighted_com",
    "runs_smooth",
    "feature_series_windows",
    "feature_lm_sequences",
    "detect_map",
    "metric_link_ranking",
    "search_knn_cells",
    "search_bm25_join",
    "graph_split_communities",
    "fuse_auto_merge",
    "metric_meteor",
    "metric_rouge_lsum",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # Small inputs should still use every core after a shuffle.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    registered = plans.registered()
    chosen = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in chosen:
        seen = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            df = registered[name](spark, folder)
            df.write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen[1:] or seen), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
