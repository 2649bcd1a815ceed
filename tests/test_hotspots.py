import math
import random

import pytest

from acremark.bbox import BBox
from acremark.operators import filters, hotspots, ranking
from acremark.plans import analyses

FEATURE = ("osm_type string, osm_id long, tags_json string, center_lat double, center_lon double, bbox_min_lat double, "
           "bbox_min_lon double, bbox_max_lat double, bbox_max_lon double")
TYPES = [("amenity", "restaurant")]


def features(spark, spots):
    rows = [("node", i, '{"amenity":"restaurant"}', lat, lon, lat, lon, lat, lon) for i, lat, lon in spots]
    return spark.createDataFrame(rows, FEATURE)


def test_bbox_orders_agree_and_bad_boxes_fail():
    assert BBox.lat_first("50.0,16.0,51.0,17.0") == BBox.lon_first("16.0,50.0,17.0,51.0")
    with pytest.raises(ValueError):
        BBox.lon_first("16,50,16,51")


def test_mesh_of_four_points_equals_loop(spark):
    spots = [(i, 50 + i * 0.001, 16 + i * 0.001) for i in range(1, 5)]
    box = BBox(16.0, 50.0, 16.01, 50.01)
    cells = analyses.hotspot_mesh(features(spark, spots), box, TYPES, "run", nx=4).collect()
    ny = hotspots.mesh_rows(box, 4)
    assert len(cells) == 2 * 4 * ny
    scale = 111_320.0 * math.cos(math.radians(50.005))
    for c in cells:
        want = sum(
            math.exp(-(((lat - c.center_lat) * 111_320.0) ** 2 + ((lon - c.center_lon) * scale) ** 2) / (2 * 450.0**2))
            for _, lat, lon in spots
        )
        assert math.isclose(c.score, want, rel_tol=1e-9)
        assert c.source_point_count == 4
    assert sorted(c.cell_id for c in cells)[0] == "run_00001" and max(c.norm for c in cells) == 1.0


def greedy(points, radius, mid_lat):
    scale = 111_320.0 * math.cos(math.radians(mid_lat))
    kept = []
    for p in points:
        if not any(math.hypot((p[1] - k[1]) * 111_320.0, (p[2] - k[2]) * scale) <= radius for k in kept):
            kept.append(p)
    return {p[0] for p in kept}


def test_radius_thinning_equals_going_through_in_order(spark):
    rnd = random.Random(5)
    spots = [(i, 50 + rnd.random() * 0.004, 16 + rnd.random() * 0.006) for i in range(500)]
    spots += [(1000 + i, 50.002, 16.003) for i in range(300)]  # a crowd of copies
    spots += [(2000 + i, 50 + i * 0.0001, 16.02) for i in range(12)]  # a chain, each near the next
    frame = spark.createDataFrame([("c", *s) for s in spots], "category string, id long, lat double, lon double")
    for radius in (15.0, 40.0):
        got = {r.id for r in hotspots.thin_by_radius(frame, ["id"], ["category"], radius, 50.002).collect()}
        assert got == greedy(spots, radius, 50.002)
    assert hotspots.thin_by_radius(frame, ["id"], ["category"], 0.0, 50.0).count() == len(spots)


def quadtree_loop(spots, box, cfg):
    """Cells visited by splitting from the root: {(depth, bounds): count}."""
    out, queue = {}, [((box.min_lat, box.min_lon, box.max_lat, box.max_lon), 0, spots)]
    while queue:
        (s, w, n, e), depth, inside = queue.pop()
        out[(depth, s, w)] = len(inside)
        side = min((n - s) * 111_320.0, (e - w) * 111_320.0 * math.cos(math.radians((s + n) / 2)))
        if depth >= cfg.max_depth or side < cfg.min_cell_m or len(inside) < cfg.min_points:
            continue
        y, x = (s + n) / 2, (w + e) / 2
        for a, b, c, d in ((y, w, n, x), (y, x, n, e), (s, w, y, x), (s, x, y, e)):
            part = [p for p in inside if a <= p[1] <= c and b <= p[2] <= d]
            if part:
                queue.append(((a, b, c, d), depth + 1, part))
    return out


def test_quadtree_visits_the_same_cells_as_a_loop(spark):
    rnd = random.Random(8)
    box = BBox(16.0, 50.0, 16.04, 50.02)
    spots = [(i, 50 + abs(rnd.gauss(0, 0.004)) % 0.02, 16 + abs(rnd.gauss(0, 0.01)) % 0.04) for i in range(300)]
    spots += [(900, 50.01, 16.02), (901, 50.005, 16.03), (902, 50.02, 16.04)]  # on split lines and a corner
    rows = [("c", "k", "v", lat, lon) for _, lat, lon in spots]
    frame = spark.createDataFrame(rows, "category string, tag_key string, tag_value string, lat double, lon double")
    cfg = hotspots.QuadtreeConfig(max_depth=5, min_points=3, min_cell_m=60.0)
    got = {(r.depth, r.bbox_min_lat, r.bbox_min_lon): r.point_count for r in hotspots.quadtree_cells(frame, box, cfg).collect()}
    assert got == quadtree_loop(spots, box, cfg)


def test_overlap_suppression_equals_loop(spark):
    rnd = random.Random(2)
    cells = []
    for i in range(120):
        s, w = 50 + rnd.random() * 0.01, 16 + rnd.random() * 0.02
        h, v = rnd.choice([0.001, 0.004]), rnd.choice([0.002, 0.006])
        area = h * 111_320.0 * v * 111_320.0 * math.cos(math.radians(s + h / 2))
        cells.append((f"c{i:03d}", rnd.choice("ab"), float(rnd.randint(1, 40)), area, s, w, s + h, w + v))
    frame = spark.createDataFrame(
        cells, "id string, category string, score double, area_m2 double, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double")

    def ratio(a, b):
        s, w, n, e = max(a[4], b[4]), max(a[5], b[5]), min(a[6], b[6]), min(a[7], b[7])
        if s >= n or w >= e:
            return 0.0
        shared = (e - w) * 111_320.0 * math.cos(math.radians((s + n) / 2)) * (n - s) * 111_320.0
        return shared / min(a[3], b[3])

    for limit in (0.3, 0.7):
        kept = []
        for c in sorted(cells, key=lambda c: (-c[2], c[0])):
            if all(k[1] != c[1] or ratio(c, k) <= limit for k in kept):
                kept.append(c)
        got = {r.id for r in hotspots.suppress_overlaps(frame, limit).collect()}
        assert got == {k[0] for k in kept}


def test_ranking_funnel_and_top(spark):
    parcels = spark.createDataFrame(
        [(p, p, "Zawada", "Koninski", "Wielkopolskie", a, 51.3, 17.4, 51.29, 17.38, 51.31, 17.42)
         for p, a in (("olsza", 4200.0), ("brzoza", 61000.0), ("wierzba", 2750.0))],
        "parcel_id string, parcel_number string, commune string, county string, voivodeship string, area_m2 double, centroid_lat double, "
        "centroid_lon double, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double")
    links = spark.createDataFrame([("demo", p, i, "bbox") for i, p in enumerate(("olsza", "brzoza", "wierzba"))],
                                  "run_id string, parcel_id string, candidate_index int, source_bbox string")
    shape = spark.createDataFrame([("olsza", 4200.0, 0.55, 1.7, 3.0, 8.0), ("brzoza", 61000.0, 0.6, 1.4, 3.0, 5.0), ("wierzba", 2750.0, 0.18, 3.0, 1.0, 9.0)],
                                  "parcel_id string, area_m2 double, compactness double, elongation_ratio double, "
                                  "principal_moment_min_m4 double, principal_moment_max_m4 double")
    look = spark.createDataFrame([("olsza", 0.71, 0.12, 0.18, 0.33, 118.0), ("brzoza", 0.8, 0.2, 0.05, 0.1, 96.0), ("wierzba", 0.44, 0.1, 0.02, 0.15, 131.0)],
                                 "parcel_id string, green_pixel_ratio double, dark_pixel_ratio double, bright_pixel_ratio double, "
                                 "low_saturation_ratio double, brightness_mean double")
    gates = ranking.Gates(1800, 9000, 0.3, 6, True, 0.4, 0.25, 0.5, 150)
    top, funnel = analyses.rank_run(links, parcels, shape, look, "demo", gates, limit=10)
    steps = [(r.step, r["count"]) for r in funnel.orderBy("position").collect()]
    assert steps == [("layer2_parcels", 3), ("deduped_parcels", 3), ("with_geometry_features", 3), ("area_1800_9000", 2),
                     ("geometry_shape_filter", 1), ("with_visual_features", 1), ("visual_land_filter", 1), ("top_10", 1)]
    rows = top.collect()
    assert [r.parcel_id for r in rows] == ["olsza"]
    assert rows[0].map_link.endswith("query=51.3000000,17.4000000")
    # without feature tables nothing has geometry
    assert analyses.rank_run(links, parcels, None, None, "demo")[0].count() == 0


def test_probe_covers_rejects_and_finds(spark, vertices):
    def parcel(name, size):
        ring = [(17.2, 51.4), (17.2 + size, 51.4), (17.2 + size, 51.4 + size), (17.2, 51.4 + size), (17.2, 51.4)]
        frame = spark.createDataFrame([(name, "Zawada", 3e8 * size, 51.4, 17.2, 51.4 + size, 17.2 + size)],
                                      "parcel_id string, commune string, area_m2 double, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double")
        return frame, vertices({name: [[ring]]})

    frame, points = parcel("A", 0.07)
    _, counts = analyses.probe_area(spark, BBox(17.22, 51.42, 17.24, 51.44), 1000, frame, points)
    row = counts.first()
    assert row.uncovered == 0 and row.skipped_existing >= 1 and row.found_parcels == 1
    frame, points = parcel("B", 0.18)
    area = BBox(17.21, 51.41, 17.36, 51.56)
    samples, counts = analyses.probe_area(spark, area, 1000, frame, points, gates={"max_area_m2": 30_000.0})
    row = counts.first()
    assert row.uncovered == 0 and row.rejected == 1 and row.skipped_rejected_polygon >= 1 and row.found_parcels == 0
    assert {r.reason for r in samples.collect()} == {"too_large"}
    _, counts = analyses.probe_area(spark, area, 1000, frame, points, expected_commune="Lipowiec")
    assert counts.first().found_parcels == 0 and counts.first().out_of_scope > 0
    # a budget of uncovered points ends the walk
    used, _ = analyses.probe_area(spark, BBox(20.0, 50.0, 20.1, 50.1), 1000, frame, points, max_requests=5)
    assert used.count() == 5


def test_selection_and_tag_filters(spark):
    frame = features(spark, [(1, 50.0, 16.0), (2, 50.5, 16.5)])
    assert frame.where(filters.feature_overlaps_bbox(BBox(15.9, 49.9, 16.1, 50.1))).count() == 1
    assert filters.match_tags(frame, TYPES).count() == 2 and filters.match_tags(frame, [("amenity", "bar")]).count() == 0
    ids = spark.createDataFrame([(2,)], "osm_id long")
    assert filters.selected_only(frame, ids, "osm_id").count() == 1
    assert filters.selected_only(frame, ids.limit(0), "osm_id").count() == 2
