"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracemill.session import local_session  # noqa: E402
from tracemill.workload import all_queries  # noqa: E402

HEADLINE = (
    "symbol_dictionary",
    "encode_traces",
    "supermax_repeats",
    "near_supermax_repeats",
    "repeat_occurrences",
    "tandem_primitive",
    "tandem_runs",
    "collapse_tandem",
    "prefix_similarity",
    "feature_matrix",
    "tree_grid_search",
    "tree_as_rules",
    "stream_detect",
    "word_dictionary",
    "substring_lookup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    timings: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
