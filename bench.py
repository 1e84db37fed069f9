"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from foldwise.plans.catalog import QUERIES  # noqa: E402
from foldwise.session import local_session  # noqa: E402

HEADLINE = [
    "naive_mean_metrics",
    "downsample_b",
    "row_weights",
    "training_weights",
    "fold_stats",
    "pooled_metrics",
    "per_bin_metrics",
    "histogram",
    "kde_curve",
    "scale_standard",
    "scale_robust",
    "best_params",
    "grid_linear",
    "ols_multi",
    "wls_report",
    "alpha_sweep",
    "linear_grid_cv",
    "early_stop",
    "network_report",
    "svr_linear",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 4)
    spark = local_session(cores, partitions=cores, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small job starts the JVM paths every query shares.
    QUERIES["bin_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
