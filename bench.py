"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores; ``BENCH_QUERIES``
picks queries by name (``all`` for every one).  The first run of a query is its
cold time, the second its warm time, which is what counts.
"""

from __future__ import annotations

import json
import os
import time

from pulsegrid.session import build_session
from workload.queries import QUERIES

HEADLINE = [
    "catalog", "last_n_points", "fingerprint", "series_quantiles", "counter_delta", "resample_hourly_mean",
    "downsample_mean", "gaps_detected", "fill_linear", "fill_ffill_maxgap", "outliers_iqr", "outliers_mad",
    "replace_median", "norm_z", "moving_average_24", "period_estimate", "decompose_add", "detect_zscore",
    "detect_zscore_window", "detect_iqr", "detect_gesd", "detect_stl", "detect_centroid", "detect_knn",
    "detect_forecast_interval", "ensemble_majority", "detect_ensemble", "detect_default", "detect_context",
    "correlated_metrics", "forecast_points", "trend_summary", "alert_episodes", "alert_lifecycle",
    "maintenance_survivors", "prom_parse", "statsd_parse", "snmp_parse",
]


def run(spark, name: str, sf_dir: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begun, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if picked == "all" else picked.split(",") if picked else HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    cold, warm = {}, {}
    for name in names:
        cold[name] = run(spark, name, sf_dir)
        warm[name] = run(spark, name, sf_dir)
    print(json.dumps({
        "metric": "warm seconds over all headline queries", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
