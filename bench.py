"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS
(default 3; the median of the warm runs counts), BENCH_QUERIES (comma list, default the headline set).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "things_latest_readings", "src_02_traveltime", "flt_05_arithmetic", "flt_07_time_compare",
    "jn_03_multi_hop", "jn_06_expand_to_many", "jn_08_nested_expand", "agg_06_extents",
    "agg_10_area_hull", "srt_06_all_pages", "snk_02_data_array", "geo_07_within",
    "geo_12_area_relations", "win_02_rolling_mean", "win_05_neighbour_repair", "qc_05_chain",
    "qc_06_iqr_outliers", "ver_02_update_closes_and_opens", "mut_11_unique", "mut_16_json_patch",
    "mut_20_filtered_delete", "src_05_station_files", "src_08_messages", "ing_15_copy_series",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from sensorquery.plans import registry

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sensorquery-bench")
        .config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    def once(name: str) -> float:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    took = {}
    for name in names:
        once(name)
        took[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
        "cpus": cores, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
