"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the threads. Every query is run once, cold, on whole tables.
"""

from __future__ import annotations

import json
import os
import time

from duskline.plans.catalog import REGISTRY
from duskline.session import get_session

HEADLINE = (
    "city_night_dispersion", "station_night_panel", "city_night_table", "night_weather_regime", "quality_flag_audit", "station_coverage",
    "dusk_dispersion", "dusk_variants", "profile_scalars", "interpolated_grid", "reading_percentiles", "reading_ranks", "specification_curve",
    "observable_stability", "simpson_decomposition", "holdout_hypotheses", "calendar_block_bootstrap", "block_length_sensitivity",
    "block_bootstrap_curves", "block_bootstrap_regression", "functional_curve_bands", "stationary_bootstrap", "lag_scan", "cooling_delay_report",
    "two_way_effects", "nearest_station", "inverse_distance_field", "ridge_cross_validation", "decision_table", "selection_under_uncertainty",
    "tier_report", "claims_in_texts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "duskline-bench", spark__sql__shuffle__partitions=str(max(8, int(cpus))),
                        spark__driver__memory="12g", spark__ui__showConsoleProgress="false", spark__log__level="ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).collect()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
