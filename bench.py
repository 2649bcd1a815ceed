"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores, BENCH_RUNS the timed runs.
Derived tables are stored once before timing; each query is then run to a no-op sink, once to warm
up and BENCH_RUNS times for the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from acremark.session import local_session  # noqa: E402
from checks import derived, registry  # noqa: E402
from checks.catalog import Tables  # noqa: E402

HEADLINES = [
    "flagship_best_parcels",
    "uniform_grid_hotspots",
    "kernel_density_mesh",
    "quadtree_hotspots",
    "radius_thinning",
    "centroids_in_hotspot_boxes",
    "features_in_parcels",
    "radius_neighbours",
    "coverage_counters",
    "linked_parcels",
    "polygon_moments",
    "polygon_metrics",
    "zonal_pixel_statistics",
    "inflation_adjusted_prices",
    "price_stats_per_run",
    "price_scan_totals",
    "weighted_ranking",
    "ranking_funnel",
    "viewport_nearest_parcels",
    "hierarchy_groups",
    "admin_level_manifest",
    "map_parcels_with_figures",
    "keyed_upsert",
    "latest_artifacts",
    "connected_components",
]


def run(query, spark, sf_dir) -> float:
    started = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINES
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, sf_dir)
    for name in derived.TABLES:
        tables(name)
    times = {}
    for name in chosen:
        run(registry.QUERIES[name], spark, sf_dir)
        times[name] = round(statistics.median(run(registry.QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
