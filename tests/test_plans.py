"""Shapes of physical plans that matter at scale, with broadcasting by size switched off."""

import os

import pytest

import __spark_entry__ as entry_module
from acremark.bbox import BBox
from acremark.operators import presentation

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

JOINS = [
    "features_in_parcels", "centroids_in_hotspot_boxes", "radius_neighbours", "overlapping_box_pairs", "pixels_in_parcels",
    "positions_on_segments", "kernel_density_mesh", "candidate_price_summary", "price_stats_per_run", "price_scan_totals",
    "judged_samples_with_budget", "weighted_ranking", "map_parcels_with_figures", "keyed_upsert", "quadtree_visited_cells",
]


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    yield spark
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", JOINS)
def test_no_nested_loops(no_broadcast, name):
    text = plan(entry_module.queries()[name](no_broadcast, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["latest_artifacts", "ranked_candidates", "keyed_upsert"])
def test_first_row_per_key_is_cut_before_the_shuffle(no_broadcast, name):
    assert "WindowGroupLimit" in plan(entry_module.queries()[name](no_broadcast, SF))


def test_viewport_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "parcels")
    spark.range(10).selectExpr(
        "concat('P', id) AS parcel_id", "'x' AS voivodeship", "double(id) AS area_m2", "50.0D AS centroid_lat", "16.0D AS centroid_lon",
        "50.0D + id AS bbox_min_lat", "16.0D AS bbox_min_lon", "50.1D + id AS bbox_max_lat", "16.1D AS bbox_max_lon").write.parquet(path)
    matched = presentation.viewport_matches(spark.read.parquet(path), BBox(16.0, 50.0, 16.2, 50.2), 1.0).select("parcel_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(matched)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(bbox_max_lat,50.0)" in text and "GreaterThanOrEqual(area_m2,1.0)" in text
    assert "voivodeship" not in text.split("ReadSchema:")[1] and "centroid_lat" not in text.split("ReadSchema:")[1]
