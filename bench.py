"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default
8) the local cores, BENCH_RUNS (default 2) the runs per query, of which the best
counts; model fits, which take the full hyper-parameters, run once. Every result is
computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import queries  # noqa: E402
from sensorloom.session import build_session  # noqa: E402

HEADLINE = [
    "csv_roundtrip_train",
    "dataset_audit_tables",
    "null_counts",
    "mixed_user_sessions",
    "session_size_stats",
    "user_session_counts",
    "validation_summary",
    "session_sensor_features_all",
    "session_sensor_features_by_layout",
    "session_features_train",
    "aligned_train",
    "feature_job_train",
    "stratified_split",
    "dummy_stratified_scores",
    "macro_f1_scores",
    "scaler_stats",
    "score_summary",
    "wilcoxon_pair",
    "tuning_rank",
    "logistic_regression",
    "linear_svm",
    "random_forest",
    "boosted_trees",
    "model_comparison",
    "final_predictions",
]
FITS = {
    "logistic_regression",
    "linear_svm",
    "random_forest",
    "boosted_trees",
    "model_comparison",
    "final_predictions",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "sensorloom-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    registered = queries()
    times = {}
    for name in names:
        best = float("inf")
        for _ in range(1 if name in FITS else runs):
            start = time.perf_counter()
            result = registered[name](spark, sf_dir)
            result.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
