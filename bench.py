"""Time the headline queries and print one JSON line.

Each query runs three times against a sink that discards its rows; the median
is reported. The first run of all warms up the JVM and is not counted.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradeframe.catalog import QUERIES
from gradeframe.session import local_session

HEADLINE = (
    "extract_answer", "extract_answer_documents", "strategy_histogram", "normalize_answer",
    "parse_number", "is_equiv", "example_scores", "passk_per_example", "passk_benchmark",
    "benchmark_summary", "passk_empty_examples", "predicted_answer_lists", "model_passk_curve",
    "crossover_k", "delta_vs_baseline", "choice_extract", "choice_extract_documents",
    "choice_accuracy", "majority_vote", "checkpoint_curve", "sampling_params", "generate_stub",
    "mixed_group", "group_advantage", "example_advantage", "score_scan_json", "log_tail",
)
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          memory="12g", name="gradeframe-bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("benchmark_summary")
    seconds = {name: round(statistics.median(run(name) for _ in range(REPEATS)), 3)
               for name in HEADLINE}
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
                      "cpus": cpus, "repeats": REPEATS}))


if __name__ == "__main__":
    main()
