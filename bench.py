"""Time the headline queries on local Spark and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query runs twice; the second, warm run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from kerbline.plans import QUERIES
from kerbline.plans.fixtures import Tables

#: The derived table whose rows a query works through, for rows per second.
READS = {
    "route_reconstruction": "signatures", "camera_match_matrix": "signatures", "watchlist_match": "signatures", "alert_fold": "alert_sightings",
    "track_building": "detections", "track_building_bulk": "bulk_detections", "gap_coverage_by_district": "cameras", "gap_summary": "cameras",
    "gap_unusable_cameras": "cameras", "frame_segments": "frames", "frame_grid_sampling": "frames", "roster_changes": "roster_new",
    "fingerprint_pair_distances": "fingerprints",
}
HEADLINE = [
    "route_reconstruction", "camera_match_matrix", "watchlist_match", "alert_fold", "track_building", "track_building_bulk",
    "search_page_newest_first", "search_total", "index_totals", "gap_coverage_by_district", "gap_summary", "gap_unusable_cameras",
    "gap_unverified_locations", "gap_unassigned_departments", "frame_segments", "frame_grid_sampling", "plate_normalize",
    "roster_changes", "fingerprint_pair_distances", "co_sightings_per_moment",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("kerbline-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    tables = Tables(spark, sf_dir)
    rows = {name: getattr(tables, READS[name]).count() for name in seconds if name in READS}
    print(json.dumps({
        "metric": "headline queries, warm run", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "rows_per_second": {name: round(n / seconds[name]) for name, n in rows.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
