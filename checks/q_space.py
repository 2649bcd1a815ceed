"""Filters, spatial joins, geometry and imagery."""

from __future__ import annotations

from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.functions import geo, text
from acremark.operators import coverage, filters, geometry, imagery, spatial
from checks.catalog import query

VIEW = BBox(16.05, 50.01, 16.25, 50.06)
TYPES = [("amenity", "cafe"), ("tourism", "viewpoint"), ("shop", "supermarket")]
HAV = "CAST(2 AS DOUBLE) * CAST(6371000 AS DOUBLE) * asin(sqrt(power(sin(radians({0} - {2}) / CAST(2 AS DOUBLE)), 2) + cos(radians({0})) * cos(radians({2})) * power(sin(radians({1} - {3}) / CAST(2 AS DOUBLE)), 2)))"

FEATURE_OVERLAP = """
  CASE WHEN bbox_min_lat IS NOT NULL AND bbox_min_lon IS NOT NULL AND bbox_max_lat IS NOT NULL AND bbox_max_lon IS NOT NULL
    THEN bbox_max_lat >= CAST(50.01 AS DOUBLE) AND bbox_min_lat <= CAST(50.06 AS DOUBLE)
     AND bbox_max_lon >= CAST(16.05 AS DOUBLE) AND bbox_min_lon <= CAST(16.25 AS DOUBLE)
    ELSE center_lat BETWEEN CAST(50.01 AS DOUBLE) AND CAST(50.06 AS DOUBLE)
     AND center_lon BETWEEN CAST(16.05 AS DOUBLE) AND CAST(16.25 AS DOUBLE) END
"""
IN_VIEW = ("center_lat BETWEEN CAST(50.01 AS DOUBLE) AND CAST(50.06 AS DOUBLE) "
           "AND center_lon BETWEEN CAST(16.05 AS DOUBLE) AND CAST(16.25 AS DOUBLE)")
PARCEL_IN_VIEW = ("bbox_max_lat >= CAST(50.01 AS DOUBLE) AND bbox_min_lat <= CAST(50.06 AS DOUBLE) "
                  "AND bbox_max_lon >= CAST(16.05 AS DOUBLE) AND bbox_min_lon <= CAST(16.25 AS DOUBLE)")
# one row per feature and matching type
MATCHES = """
  matches AS (
    SELECT o.*, t.k AS m_key, t.v AS m_value, t.k || '_' || t.v AS category FROM fx_osm o
    JOIN (VALUES ('amenity', 'cafe'), ('tourism', 'viewpoint'), ('shop', 'supermarket')) AS t(k, v)
      ON (o.tag_key = t.k AND o.tag_value = t.v) OR (o.second_tag AND t.k = 'tourism' AND t.v = 'viewpoint'))
"""
# edges of all rings, closing duplicates harmless
EDGES = """
  edges AS (
    SELECT p.*, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon1, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat1,
           avg(lon) OVER (PARTITION BY parcel_id) AS ref_lon, avg(lat) OVER (PARTITION BY parcel_id) AS ref_lat,
           avg(lat) OVER (PARTITION BY parcel_id, polygon_index, ring_index) AS ring_lat,
           count(*) OVER (PARTITION BY parcel_id, polygon_index, ring_index) AS ring_points
    FROM fx_points p WINDOW w AS (PARTITION BY parcel_id, polygon_index, ring_index ORDER BY point_index))
"""


@query("features_overlapping_bbox", ["fx_osm"], f"SELECT osm_type, osm_id FROM fx_osm WHERE {FEATURE_OVERLAP}")
def _(t):
    return t("fx_osm").where(filters.feature_overlaps_bbox(VIEW)).select("osm_type", "osm_id")


@query("points_in_bbox_counts", ["fx_osm"], f"""
    SELECT tag_key, count(*) FILTER (WHERE {IN_VIEW}) AS inside, count(*) FILTER (WHERE NOT ({IN_VIEW})) AS outside
    FROM fx_osm GROUP BY tag_key""")
def _(t):
    return filters.in_bbox_counts(t("fx_osm"), VIEW, "center_lat", "center_lon", ["tag_key"])


@query("tag_match_fan_out", ["fx_osm"], f"""WITH {MATCHES}
    SELECT osm_type, osm_id, name, category, m_key AS tag_key, m_value AS tag_value FROM matches WHERE {FEATURE_OVERLAP}""")
def _(t):
    near = t("fx_osm").where(filters.feature_overlaps_bbox(VIEW))
    return filters.match_tags(near, TYPES).select("osm_type", "osm_id", "name", "category", "tag_key", "tag_value")


@query("tag_match_any", ["fx_osm"], f"""WITH {MATCHES} SELECT DISTINCT osm_type, osm_id FROM matches""")
def _(t):
    return t("fx_osm").where(filters.has_any_tag(F.col("tags_json"), TYPES)).select("osm_type", "osm_id")


@query("area_range_filter", ["fx_parcels"], "SELECT parcel_id, area_m2 FROM fx_parcels WHERE area_m2 >= 3000 AND area_m2 <= 6000")
def _(t):
    return t("fx_parcels").where(filters.area_between(F.col("area_m2"), 6000.0, 3000.0)).select("parcel_id", "area_m2")


@query("category_exclusion", ["fx_cells"], """SELECT cell_id, category FROM fx_cells
    WHERE category NOT IN ('amenity_school', 'shop_supermarket')""")
def _(t):
    return t("fx_cells").where(
        filters.not_in_categories(F.col("category"), ["amenity_school", "shop_supermarket"])
    ).select("cell_id", "category")


@query("commune_filter", ["fx_parcels"], "SELECT parcel_id FROM fx_parcels WHERE commune = 'NATION_3/3'")
def _(t):
    return t("fx_parcels").where(filters.commune_is(F.col("commune"), "NATION_3/3")).select("parcel_id")


@query("commune_normalised_match", ["fx_parcels"], "SELECT parcel_id FROM fx_parcels WHERE lower(commune) = 'nation_3/3'")
def _(t):
    return t("fx_parcels").where(text.commune_matches(F.col("commune"), "  nátion_3/3 ")).select("parcel_id")


@query("parcel_rejection_reasons", ["fx_parcels"], """
    SELECT parcel_id, CASE WHEN coalesce(area_m2, 0) < 2500 THEN 'too_small' WHEN coalesce(area_m2, 0) > 9000 THEN 'too_large'
      WHEN round(abs(bw * bh), 3) > 8000 THEN 'bbox_too_large' WHEN greatest(bw, bh) / greatest(CAST(0.001 AS DOUBLE), least(bw, bh)) > 3 THEN 'bbox_too_elongated' END AS reason
    FROM (SELECT *, abs((bbox_max_lon - bbox_min_lon) * CAST(111320 AS DOUBLE) * cos(radians((bbox_min_lat + bbox_max_lat) / CAST(2 AS DOUBLE)))) AS bw,
                 abs((bbox_max_lat - bbox_min_lat) * CAST(111320 AS DOUBLE)) AS bh FROM fx_parcels) q""")
def _(t):
    return t("fx_parcels").select("parcel_id", filters.rejection_reason(2500.0, 9000.0, 8000.0, 3.0).alias("reason"))


@query("fully_located_parcels", ["fx_parcels"], "SELECT parcel_id FROM fx_parcels WHERE centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL")
def _(t):
    return filters.fully_located(t("fx_parcels")).select("parcel_id")


@query("selected_ids_filter", ["fx_parcels", "fx_shape"], """
    SELECT parcel_id, county FROM fx_parcels WHERE parcel_id IN (SELECT parcel_id FROM fx_shape WHERE elongation_ratio > 2.5)""")
def _(t):
    chosen = t("fx_shape").where("elongation_ratio > 2.5")
    return filters.selected_only(t("fx_parcels"), chosen).select("parcel_id", "county")


@query("bbox_measures", ["fx_parcels"], """
    SELECT parcel_id, round((bbox_max_lat - bbox_min_lat) * CAST(111320 AS DOUBLE) * (bbox_max_lon - bbox_min_lon) * CAST(111320 AS DOUBLE) * cos(radians((bbox_min_lat + bbox_max_lat) / CAST(2 AS DOUBLE))), 2) AS area_m2,
      round(greatest(bw, bh) / least(bw, bh), 5) AS aspect, round(bw, 4) AS width_m, round(bh, 4) AS height_m
    FROM (SELECT *, (bbox_max_lon - bbox_min_lon) * CAST(111320 AS DOUBLE) * cos(radians((bbox_min_lat + bbox_max_lat) / CAST(2 AS DOUBLE))) AS bw,
                 (bbox_max_lat - bbox_min_lat) * CAST(111320 AS DOUBLE) AS bh FROM fx_parcels) q""")
def _(t):
    bounds = [F.col(b) for b in filters.BOUNDS]
    shape = geo.box_shape(*bounds)
    return t("fx_parcels").select(
        "parcel_id", F.round(geo.bbox_area_m2(*bounds), 2).alias("area_m2"), F.round(shape["aspect_ratio"], 5).alias("aspect"),
        F.round(shape["width_m"], 4).alias("width_m"), F.round(shape["height_m"], 4).alias("height_m"),
    )


@query("distances_to_view_centre", ["fx_osm"], f"""
    SELECT osm_type, osm_id, round({HAV.format('center_lat', 'center_lon', 'CAST(50.05 AS DOUBLE)', 'CAST(16.2 AS DOUBLE)')}, 3) AS sphere_m,
      round(sqrt(power((center_lat - CAST(50.05 AS DOUBLE)) * CAST(111320 AS DOUBLE), 2) + power((center_lon - CAST(16.2 AS DOUBLE)) * CAST(111320 AS DOUBLE) * cos(radians(CAST(50.05 AS DOUBLE))), 2)), 3) AS plane_m
    FROM fx_osm""")
def _(t):
    lat, lon = F.col("center_lat"), F.col("center_lon")
    return t("fx_osm").select(
        "osm_type", "osm_id", F.round(geo.haversine_m(lat, lon, 50.05, 16.2), 3).alias("sphere_m"),
        F.round(geo.planar_distance_m(lat, lon, 50.05, 16.2, 50.05), 3).alias("plane_m"),
    )


@query("square_boxes", ["fx_osm"], """
    SELECT osm_type, osm_id, round(center_lat - CAST(2500 AS DOUBLE) / CAST(111320 AS DOUBLE), 7) AS min_lat, round(center_lat + CAST(2500 AS DOUBLE) / CAST(111320 AS DOUBLE), 7) AS max_lat,
      round(center_lon - CAST(2500 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians(center_lat))), 7) AS min_lon, round(center_lon + CAST(2500 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians(center_lat))), 7) AS max_lon
    FROM fx_osm""")
def _(t):
    return t("fx_osm").select("osm_type", "osm_id", geo.square_box(F.col("center_lat"), F.col("center_lon"), 5.0).alias("b")).select(
        "osm_type", "osm_id", "b.*")


@query("epsg2180_round_trip", ["fx_osm"], "SELECT osm_type, osm_id, true AS returns, true AS in_grid FROM fx_osm")
def _(t):
    xy = t("fx_osm").select("osm_type", "osm_id", geo.to_epsg2180(F.col("center_lon"), F.col("center_lat")).alias("p"))
    back = geo.from_epsg2180(F.col("p.x"), F.col("p.y"))
    start = xy.join(t("fx_osm").select("osm_type", "osm_id", "center_lon", "center_lat"), ["osm_type", "osm_id"])
    close = (F.abs(F.col("b.lon") - F.col("center_lon")) < 1e-6) & (F.abs(F.col("b.lat") - F.col("center_lat")) < 1e-6)
    return start.withColumn("b", back).select(
        "osm_type", "osm_id", close.alias("returns"),
        (F.col("p.x").between(200_000.0, 300_000.0) & F.col("p.y").between(250_000.0, 350_000.0)).alias("in_grid"),
    )


GRS80 = """
    k AS (SELECT CAST(6378137 AS DOUBLE) AS a, f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS ep2 FROM (SELECT 1 / CAST(298.257222101 AS DOUBLE) AS f) z)
"""


@query("bbox_reprojection", ["fx_parcels"], f"""WITH {GRS80},
    corners AS (SELECT parcel_id, radians(lat) AS p, radians(lon) - radians(CAST(19 AS DOUBLE)) AS dl FROM (
      SELECT parcel_id, bbox_min_lon AS lon, bbox_min_lat AS lat FROM fx_parcels UNION ALL SELECT parcel_id, bbox_min_lon, bbox_max_lat FROM fx_parcels
      UNION ALL SELECT parcel_id, bbox_max_lon, bbox_min_lat FROM fx_parcels UNION ALL SELECT parcel_id, bbox_max_lon, bbox_max_lat FROM fx_parcels) c),
    s AS (SELECT parcel_id, p, a, e2, ep2, a / sqrt(1 - e2 * power(sin(p), 2)) AS n, power(tan(p), 2) AS t, ep2 * power(cos(p), 2) AS c, dl * cos(p) AS q FROM corners CROSS JOIN k),
    xy AS (SELECT parcel_id,
      CAST(-5300000 AS DOUBLE) + CAST(0.9993 AS DOUBLE) * (a * ((1 - e2 / 4 - 3 * power(e2, 2) / 64 - 5 * power(e2, 3) / 256) * p - (3 * e2 / 8 + 3 * power(e2, 2) / 32 + 45 * power(e2, 3) / 1024) * sin(2 * p)
          + (15 * power(e2, 2) / 256 + 45 * power(e2, 3) / 1024) * sin(4 * p) - 35 * power(e2, 3) / 3072 * sin(6 * p))
        + n * tan(p) * (power(q, 2) / 2 + (5 - t + 9 * c + 4 * power(c, 2)) * power(q, 4) / 24 + (61 - 58 * t + power(t, 2) + 600 * c - 330 * ep2) * power(q, 6) / 720)) AS x,
      CAST(500000 AS DOUBLE) + CAST(0.9993 AS DOUBLE) * n * (q + (1 - t + c) * power(q, 3) / 6 + (5 - 18 * t + power(t, 2) + 72 * c - 58 * ep2) * power(q, 5) / 120) AS y FROM s)
    SELECT parcel_id, round(min(x), 3) AS min_x, round(min(y), 3) AS min_y, round(max(x), 3) AS max_x, round(max(y), 3) AS max_y FROM xy GROUP BY parcel_id""")
def _(t):
    box = geo.reproject_box(*[F.col(f"bbox_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")], "EPSG:2180")
    return t("fx_parcels").select("parcel_id", box.alias("b")).select("parcel_id", "b.*")


@query("mercator_pixels", ["fx_osm"], """
    SELECT osm_type, osm_id, CAST(floor(px / 256) AS BIGINT) AS tile_x, CAST(floor(py / 256) AS BIGINT) AS tile_y, round(px, 3) AS x, round(py, 3) AS y
    FROM (SELECT osm_type, osm_id, (center_lon + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * CAST(67108864 AS DOUBLE) AS px,
      (CAST(0.5 AS DOUBLE) - ln((CAST(1 AS DOUBLE) + sin(radians(center_lat))) / (CAST(1 AS DOUBLE) - sin(radians(center_lat)))) / (CAST(4 AS DOUBLE) * pi())) * CAST(67108864 AS DOUBLE) AS py FROM fx_osm) q""")
def _(t):
    x, y = geo.world_pixel(F.col("center_lon"), F.col("center_lat"), 18)
    return t("fx_osm").select("osm_type", "osm_id", geo.tile_index(x).alias("tile_x"), geo.tile_index(y).alias("tile_y"),
                              F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("centroids_in_hotspot_boxes", ["fx_parcels", "fx_cells"], """
    WITH boxes AS (SELECT *, row_number() OVER (ORDER BY score DESC, cell_id) AS pos FROM (SELECT * FROM fx_cells WHERE run_id = 'r1'
      QUALIFY row_number() OVER (PARTITION BY bbox_min_lat, bbox_min_lon, bbox_max_lat, bbox_max_lon ORDER BY score DESC, cell_id) = 1) c),
    pairs AS (SELECT p.parcel_id, min(b.pos) AS pos FROM fx_parcels p JOIN boxes b
      ON p.centroid_lat BETWEEN b.bbox_min_lat AND b.bbox_max_lat AND p.centroid_lon BETWEEN b.bbox_min_lon AND b.bbox_max_lon GROUP BY p.parcel_id)
    SELECT parcel_id, pos, row_number() OVER (ORDER BY pos, parcel_id) AS ordinal FROM pairs""")
def _(t):
    from acremark.operators.ranking import ranked_candidates

    boxes = ranked_candidates(t("fx_cells"), "r1").withColumnRenamed("candidate_index", "pos")
    return coverage.parcels_in_boxes(t("fx_parcels"), boxes, "pos").select(
        "parcel_id", F.col("pos").cast("long").alias("pos"), F.col("ordinal").cast("long").alias("ordinal"))


@query("features_in_parcels", ["fx_osm", "fx_points"], f"""WITH {EDGES},
    outer_edges AS (SELECT * FROM edges WHERE ring_index = 0),
    rings AS (SELECT parcel_id, polygon_index, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM outer_edges GROUP BY parcel_id, polygon_index),
    near AS (SELECT o.osm_type, o.osm_id, o.center_lon AS x, o.center_lat AS y, r.parcel_id, r.polygon_index FROM fx_osm o JOIN rings r
      ON o.center_lon BETWEEN r.w AND r.e AND o.center_lat BETWEEN r.s AND r.n),
    hits AS (SELECT n.osm_type, n.osm_id, n.parcel_id, n.polygon_index FROM near n JOIN outer_edges g ON g.parcel_id = n.parcel_id AND g.polygon_index = n.polygon_index
      WHERE (g.lat1 > n.y) <> (g.lat > n.y) AND n.x < (g.lon1 - g.lon) * (n.y - g.lat) / (g.lat1 - g.lat) + g.lon
      GROUP BY n.osm_type, n.osm_id, n.parcel_id, n.polygon_index HAVING count(*) % 2 = 1)
    SELECT osm_type, osm_id, min(parcel_id) AS parcel_id FROM hits GROUP BY osm_type, osm_id""")
def _(t):
    spots = t("fx_osm").select("osm_type", "osm_id", F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat"))
    return geometry.first_parcel_at(spots, t("fx_points"), ["osm_type", "osm_id"]).where("parcel_id IS NOT NULL").select(
        "osm_type", "osm_id", "parcel_id")


@query("radius_neighbours", ["fx_osm"], """
    WITH spots AS (SELECT osm_type, osm_id, tag_value, center_lon * CAST(111320 AS DOUBLE) * cos(radians(CAST(50.055 AS DOUBLE))) AS x, center_lat * CAST(111320 AS DOUBLE) AS y FROM fx_osm)
    SELECT a.osm_type, a.osm_id, count(*) - 1 AS others, round(min(CASE WHEN a.x <> b.x OR a.y <> b.y THEN sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) END), 3) AS nearest_m
    FROM spots a JOIN spots b ON a.tag_value = b.tag_value AND a.x BETWEEN b.x - 150 AND b.x + 150 AND a.y BETWEEN b.y - 150 AND b.y + 150
    WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 150 GROUP BY a.osm_type, a.osm_id""")
def _(t):
    """All features: how many others of their kind lie within 150 m, and how near the nearest is."""
    spots = t("fx_osm").select(
        "osm_type", "osm_id", "tag_value", (F.col("center_lon") * geo.metres_per_lon_degree(50.055)).alias("x"),
        (F.col("center_lat") * geo.METRES_PER_DEGREE).alias("y"))
    near = spatial.neighbour_counts(spots, ("x", "y"), 150.0, ["tag_value"])
    return spots.join(near, ["tag_value", "x", "y"]).select("osm_type", "osm_id", "others", F.round("nearest", 3).alias("nearest_m"))


@query("overlapping_box_pairs", ["fx_osm"], """
    WITH b AS (SELECT osm_id, tag_value, bbox_min_lat - CAST(osm_id % 5 AS DOUBLE) * CAST(0.0003 AS DOUBLE) AS s, bbox_max_lat + CAST(osm_id % 5 AS DOUBLE) * CAST(0.0003 AS DOUBLE) AS n,
        bbox_min_lon - CAST(osm_id % 5 AS DOUBLE) * CAST(0.0003 AS DOUBLE) AS w, bbox_max_lon + CAST(osm_id % 5 AS DOUBLE) * CAST(0.0003 AS DOUBLE) AS e FROM fx_osm WHERE bbox_min_lat IS NOT NULL)
    SELECT least(p.osm_id, q.osm_id) AS first_id, greatest(p.osm_id, q.osm_id) AS second_id,
      round((least(p.n, q.n) - greatest(p.s, q.s)) * CAST(111320 AS DOUBLE) * (least(p.e, q.e) - greatest(p.w, q.w)) * CAST(111320 AS DOUBLE) * cos(radians((least(p.n, q.n) + greatest(p.s, q.s)) / CAST(2 AS DOUBLE))), 1) AS shared_m2
    FROM b p JOIN b q ON p.osm_id < q.osm_id AND p.tag_value = q.tag_value AND p.n > q.s AND p.s < q.n AND p.e > q.w AND p.w < q.e
    WHERE least(p.n, q.n) > greatest(p.s, q.s) AND least(p.e, q.e) > greatest(p.w, q.w)""")
def _(t):
    grow = F.col("osm_id") % 5 * F.lit(0.0003)
    boxes = t("fx_osm").where("bbox_min_lat IS NOT NULL").select(
        "osm_id", "tag_value", (F.col("bbox_min_lat") - grow).alias("min_lat"), (F.col("bbox_max_lat") + grow).alias("max_lat"),
        (F.col("bbox_min_lon") - grow).alias("min_lon"), (F.col("bbox_max_lon") + grow).alias("max_lon"))
    boxes = boxes.where("max_lat > min_lat AND max_lon > min_lon")  # a box without extent shares no area
    pairs = spatial.overlapping_boxes(boxes, "osm_id", ("min_lon", "min_lat", "max_lon", "max_lat"), ["tag_value"])
    sides = [{n: F.col(f"{p}_{n}") for n in ("min_lat", "min_lon", "max_lat", "max_lon")} for p in ("a", "b")]
    shared = geo.overlap_area_m2(*sides)
    return pairs.where(shared > 0).select(
        F.least("a_osm_id", "b_osm_id").alias("first_id"), F.greatest("a_osm_id", "b_osm_id").alias("second_id"), F.round(shared, 1).alias("shared_m2"))


@query("ring_edges_with_wrap", ["fx_points"], f"""WITH {EDGES}
    SELECT parcel_id, polygon_index, ring_index, point_index, lon1, lat1 FROM edges""")
def _(t):
    return geometry.ring_edges(t("fx_points")).select("parcel_id", "polygon_index", "ring_index", "point_index", "lon1", "lat1")


MOMENTS = f"""WITH {EDGES},
    xy AS (SELECT *, (lon - ref_lon) * mpl AS x0, (lat - ref_lat) * CAST(111320 AS DOUBLE) AS y0, (lon1 - ref_lon) * mpl AS x1, (lat1 - ref_lat) * CAST(111320 AS DOUBLE) AS y1
      FROM (SELECT *, CAST(111320 AS DOUBLE) * cos(radians(ref_lat)) AS mpl FROM edges) e),
    rings AS (SELECT parcel_id, polygon_index, ring_index, any_value(ref_lat) AS ref_lat, any_value(ref_lon) AS ref_lon, sum(x0 * y1 - x1 * y0) / 2 AS a,
        sum((x0 + x1) * (x0 * y1 - x1 * y0)) / 6 AS sx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / 6 AS sy,
        sum((y0 * y0 + y0 * y1 + y1 * y1) * (x0 * y1 - x1 * y0)) / 12 AS ixx, sum((x0 * x0 + x0 * x1 + x1 * x1) * (x0 * y1 - x1 * y0)) / 12 AS iyy,
        sum((2 * x0 * y0 + x0 * y1 + x1 * y0 + 2 * x1 * y1) * (x0 * y1 - x1 * y0)) / 24 AS ixy,
        sum(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))) AS per
      FROM xy GROUP BY parcel_id, polygon_index, ring_index),
    signed AS (SELECT *, CASE WHEN a > 0 THEN 1 WHEN a < 0 THEN -1 ELSE 0 END * CASE WHEN ring_index = 0 THEN 1 ELSE -1 END AS f FROM rings),
    tot AS (SELECT parcel_id, any_value(ref_lat) AS ref_lat, any_value(ref_lon) AS ref_lon, sum(a * f) AS a, sum(sx * f) AS sx, sum(sy * f) AS sy, sum(ixx * f) AS ixx, sum(iyy * f) AS iyy, sum(ixy * f) AS ixy, sum(per) AS per
      FROM signed GROUP BY parcel_id),
    c AS (SELECT *, ixx - sy * sy / a AS cxx, iyy - sx * sx / a AS cyy, ixy - sx * sy / a AS cxy FROM tot WHERE a > 0),
    p AS (SELECT *, greatest(CAST(0 AS DOUBLE), (cxx + cyy) / 2 - sqrt(power((cxx - cyy) / 2, 2) + cxy * cxy)) AS pmin, greatest(CAST(0 AS DOUBLE), (cxx + cyy) / 2 + sqrt(power((cxx - cyy) / 2, 2) + cxy * cxy)) AS pmax FROM c)
"""


@query("polygon_moments", ["fx_points"], MOMENTS + """
    SELECT parcel_id, round(a, 2) AS area_m2, round(ref_lat + sy / a / CAST(111320 AS DOUBLE), 7) AS centroid_lat,
      round(ref_lon + sx / a / (CAST(111320 AS DOUBLE) * cos(radians(ref_lat))), 7) AS centroid_lon, round(per, 3) AS perimeter_m,
      round(cxx / 1000, 1) AS ixx_k, round(cyy / 1000, 1) AS iyy_k, round((cxx + cyy) / 1000, 1) AS polar_k, round(pmin / 1000, 1) AS pmin_k, round(pmax / 1000, 1) AS pmax_k,
      round(sqrt(pmax / a), 3) AS rg_max_m, round(sqrt(pmax / a) / sqrt(pmin / a), 4) AS elongation_ratio, round(4 * pi() * a / (per * per), 5) AS compactness
    FROM p""")
def _(t):
    m = geometry.polygon_moments(t("fx_points")).where("error IS NULL")

    def k(column):
        return F.round(F.col(column) / 1000, 1)

    return m.select(
        "parcel_id", F.round("area_m2", 2).alias("area_m2"), F.round("centroid_lat", 7).alias("centroid_lat"),
        F.round("centroid_lon", 7).alias("centroid_lon"), F.round("perimeter_m", 3).alias("perimeter_m"),
        k("centroidal_ixx_m4").alias("ixx_k"), k("centroidal_iyy_m4").alias("iyy_k"), k("polar_moment_m4").alias("polar_k"),
        k("principal_moment_min_m4").alias("pmin_k"), k("principal_moment_max_m4").alias("pmax_k"),
        F.round("radius_gyration_max_m", 3).alias("rg_max_m"), F.round("elongation_ratio", 4).alias("elongation_ratio"),
        F.round("compactness", 5).alias("compactness"))


@query("polygon_metrics", ["fx_points", "fx_parcels"], f"""WITH {EDGES},
    xy AS (SELECT parcel_id, ring_points, (lon - ref_lon) * m AS x0, (lat - ref_lat) * CAST(111320 AS DOUBLE) AS y0, (lon1 - ref_lon) * m AS x1, (lat1 - ref_lat) * CAST(111320 AS DOUBLE) AS y1
      FROM (SELECT *, CAST(111320 AS DOUBLE) * cos(radians(ring_lat)) AS m FROM edges WHERE polygon_index = 0 AND ring_index = 0) e),
    f AS (SELECT parcel_id, abs(sum(x0 * y1 - x1 * y0)) / 2 AS a, sum(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))) AS per, max(x0) - min(x0) AS w, max(y0) - min(y0) AS h FROM xy GROUP BY parcel_id)
    SELECT p.parcel_id, round(f.a, 2) AS area_m2, round(f.per, 3) AS perimeter_m, round(4 * pi() * f.a / (f.per * f.per), 5) AS compactness,
      round(greatest(f.w, f.h) / greatest(CAST(0.000000001 AS DOUBLE), least(f.w, f.h)), 4) AS elongation_ratio
    FROM fx_parcels p JOIN f ON f.parcel_id = p.parcel_id""")
def _(t):
    m = geometry.polygon_metrics(t("fx_parcels"), t("fx_points"))
    return m.select("parcel_id", F.round("area_m2", 2).alias("area_m2"), F.round("perimeter_m", 3).alias("perimeter_m"),
                    F.round("compactness", 5).alias("compactness"), F.round("elongation_ratio", 4).alias("elongation_ratio"))


@query("ingest_geometry_stats", ["fx_points"], f"""WITH {EDGES},
    rings AS (SELECT parcel_id, polygon_index, ring_index, abs(sum((lon - ref_lon) * (lat1 - ref_lat) - (lon1 - ref_lon) * (lat - ref_lat))) / 2 * CAST(111320 AS DOUBLE) * CAST(111320 AS DOUBLE) * cos(radians(any_value(ring_lat))) AS a
      FROM edges WHERE ring_index = 0 GROUP BY parcel_id, polygon_index, ring_index),
    area AS (SELECT parcel_id, sum(a) AS a FROM rings GROUP BY parcel_id),
    box AS (SELECT parcel_id, avg(lat) AS lat, avg(lon) AS lon, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM fx_points GROUP BY parcel_id)
    SELECT parcel_id, round(a, 2) AS area_m2, round(lat, 7) AS centroid_lat, round(lon, 7) AS centroid_lon, round(s, 7) AS bbox_min_lat, round(w, 7) AS bbox_min_lon, round(n, 7) AS bbox_max_lat, round(e, 7) AS bbox_max_lon
    FROM area JOIN box USING (parcel_id)""")
def _(t):
    s = geometry.ingest_stats(t("fx_points"))
    return s.select("parcel_id", F.round("area_m2", 2).alias("area_m2"),
                    *[F.round(c, 7).alias(c) for c in ("centroid_lat", "centroid_lon", *filters.BOUNDS)])


@query("geometry_change_detection", ["fx_points"], "SELECT parcel_id, parcel_id IN (SELECT parcel_id FROM fx_points WHERE ring_index = 1) AS changed FROM fx_points GROUP BY parcel_id")
def _(t):
    # the same parcels delivered again, holes moved a little: exactly those digests change
    points = t("fx_points")
    again = points.withColumn("lat", F.when(F.col("ring_index") == 1, F.col("lat") + F.lit(1e-6)).otherwise(F.col("lat")))
    new = geometry.geometry_hash(again).withColumnRenamed("geometry_hash", "new_hash")
    return geometry.geometry_hash(points).join(new, "parcel_id").select("parcel_id", (F.col("geometry_hash") != F.col("new_hash")).alias("changed"))


@query("nested_ring_assembly", ["fx_points"], """
    WITH rings AS (SELECT parcel_id, polygon_index, ring_index, '[' || string_agg('[' || CAST(CAST(round(lat * 10000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(lon * 10000) AS BIGINT) AS VARCHAR) || ']', ',' ORDER BY point_index) || ']' AS r FROM fx_points GROUP BY parcel_id, polygon_index, ring_index),
    polys AS (SELECT parcel_id, polygon_index, '[' || string_agg(r, ',' ORDER BY ring_index) || ']' AS p FROM rings GROUP BY parcel_id, polygon_index)
    SELECT parcel_id, '[' || string_agg(p, ',' ORDER BY polygon_index) || ']' AS geometry FROM polys GROUP BY parcel_id""")
def _(t):
    whole = t("fx_points").withColumn("lat", F.round(F.col("lat") * 10000).cast("long")).withColumn("lon", F.round(F.col("lon") * 10000).cast("long"))
    nested = geometry.nested_geometry(whole, min_points=3, lat_first=True)
    return nested.select("parcel_id", F.to_json("polygons").alias("geometry"))


@query("sampling_lattice", ["fx_cells"], """
    WITH b AS (SELECT cell_id, bbox_min_lat AS s, bbox_min_lon AS w, bbox_max_lat AS n, bbox_max_lon AS e,
        greatest(1, CAST(ceil((bbox_max_lat - bbox_min_lat) / (CAST(200 AS DOUBLE) / CAST(111320 AS DOUBLE))) AS BIGINT)) AS r,
        greatest(1, CAST(ceil((bbox_max_lon - bbox_min_lon) / (CAST(200 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians((bbox_min_lat + bbox_max_lat) / CAST(2 AS DOUBLE)))))) AS BIGINT)) AS c
      FROM fx_cells),
    rr AS (SELECT b.*, unnest(range(r)) AS i FROM b), cc AS (SELECT rr.*, unnest(range(c)) AS j FROM rr)
    SELECT cell_id, CAST(i * c + j + 1 AS BIGINT) AS ordinal, round(s + (i + 0.5) * (n - s) / r, 8) AS lat, round(w + (j + 0.5) * (e - w) / c, 8) AS lon FROM cc""")
def _(t):
    return coverage.sampling_lattice(t("fx_cells"), 200.0, "cell_id").select(
        "cell_id", "ordinal", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


# --- imagery: 8 x 8 tiles; the view of the tiles is moved over the parcels' pixel range ---

def _tile_origin(t):
    """First tile column and row of the parcels' extent at zoom 18 with 8-pixel tiles."""
    x, y = geo.world_pixel(F.min("lon"), F.max("lat"), 18, 8)
    return t("fx_points").agg(F.floor(x / 8).alias("ox"), F.floor(y / 8).alias("oy"))


def _strips(t):
    """The pixel tiles, laid side by side from the north-west corner of the parcels."""
    origin = _tile_origin(t)
    moved = t("fx_pixels").withColumn("x", F.col("x") + origin.select("ox").scalar()).withColumn("y", F.col("y") + origin.select("oy").scalar())
    return imagery.strips_from_pixels(moved)


PIXEL_HITS = f"""WITH {EDGES},
    wp AS (SELECT *, (lon + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * CAST(2097152 AS DOUBLE) AS x0,
        (CAST(0.5 AS DOUBLE) - ln((CAST(1 AS DOUBLE) + sin(radians(lat))) / (CAST(1 AS DOUBLE) - sin(radians(lat)))) / (CAST(4 AS DOUBLE) * pi())) * CAST(2097152 AS DOUBLE) AS y0,
        (lon1 + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * CAST(2097152 AS DOUBLE) AS x1,
        (CAST(0.5 AS DOUBLE) - ln((CAST(1 AS DOUBLE) + sin(radians(lat1))) / (CAST(1 AS DOUBLE) - sin(radians(lat1)))) / (CAST(4 AS DOUBLE) * pi())) * CAST(2097152 AS DOUBLE) AS y1 FROM edges),
    corner AS (SELECT floor(min(x0) / 8) AS ox, floor(min(y0) / 8) AS oy FROM wp),
    cells AS (SELECT (p.x + ox) * 8 + p.px AS gx, (p.y + oy) * 8 + p.py AS gy, p.r, p.g, p.b FROM fx_pixels p CROSS JOIN corner),
    box AS (SELECT parcel_id, min(x0) AS w, max(x0) AS e, min(y0) AS s, max(y0) AS n FROM wp GROUP BY parcel_id),
    near AS (SELECT b.parcel_id, c.* FROM box b JOIN cells c ON c.gx + 0.5 BETWEEN b.w AND b.e AND c.gy + 0.5 BETWEEN b.s AND b.n),
    odd AS (SELECT n.parcel_id, w.polygon_index, n.gx, n.gy, any_value(n.r) AS r, any_value(n.g) AS g, any_value(n.b) AS b FROM near n JOIN wp w ON w.parcel_id = n.parcel_id
      WHERE (w.y1 > n.gy + 0.5) <> (w.y0 > n.gy + 0.5) AND n.gx + 0.5 < (w.x1 - w.x0) * (n.gy + 0.5 - w.y0) / (w.y1 - w.y0) + w.x0
      GROUP BY n.parcel_id, w.polygon_index, n.gx, n.gy HAVING count(*) % 2 = 1),
    inside AS (SELECT DISTINCT parcel_id, gx, gy, r, g, b FROM odd)
"""


@query("pixels_in_parcels", ["fx_points", "fx_pixels"], PIXEL_HITS + """
    SELECT parcel_id, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, r, g, b FROM inside""")
def _(t):
    hits = imagery.parcel_pixels(t("fx_points"), _strips(t), 18, 8)
    return hits.select("parcel_id", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "r", "g", "b")


@query("zonal_pixel_statistics", ["fx_points", "fx_pixels"], PIXEL_HITS + """
    SELECT parcel_id, count(*) AS masked_pixel_count, round(avg(r), 6) AS rgb_r_mean, round(avg(g), 6) AS rgb_g_mean, round(avg(b), 6) AS rgb_b_mean,
      round(stddev_pop(r), 6) AS rgb_r_std, round(stddev_pop(g), 6) AS rgb_g_std, round(stddev_pop(b), 6) AS rgb_b_std,
      round(avg((r + g + b) / CAST(3 AS DOUBLE)), 6) AS brightness_mean, round(stddev_pop((r + g + b) / CAST(3 AS DOUBLE)), 6) AS brightness_std,
      round(avg((g - r) / greatest(CAST(1 AS DOUBLE), CAST(g + r AS DOUBLE))), 6) AS green_index_mean, round(stddev_pop((g - r) / greatest(CAST(1 AS DOUBLE), CAST(g + r AS DOUBLE))), 6) AS green_index_std,
      round(count(*) FILTER (WHERE g > 60 AND g >= r * CAST(1.05 AS DOUBLE) AND g >= b * CAST(1.05 AS DOUBLE)) / CAST(count(*) AS DOUBLE), 6) AS green_pixel_ratio,
      round(count(*) FILTER (WHERE (r + g + b) / CAST(3 AS DOUBLE) < 70) / CAST(count(*) AS DOUBLE), 6) AS dark_pixel_ratio,
      round(count(*) FILTER (WHERE (r + g + b) / CAST(3 AS DOUBLE) > 190) / CAST(count(*) AS DOUBLE), 6) AS bright_pixel_ratio,
      round(count(*) FILTER (WHERE greatest(r, g, b) - least(r, g, b) < 25) / CAST(count(*) AS DOUBLE), 6) AS low_saturation_ratio
    FROM inside GROUP BY parcel_id""")
def _(t):
    stats = imagery.zonal_statistics(t("fx_points"), _strips(t), 18, 8)
    return stats.select("parcel_id", "masked_pixel_count", *[F.round(c, 6).alias(c) for c in stats.columns[2:]])


@query("tiles_to_fetch", ["fx_points"], """
    WITH wp AS (SELECT parcel_id, (lon + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * CAST(67108864 AS DOUBLE) AS x,
        (CAST(0.5 AS DOUBLE) - ln((CAST(1 AS DOUBLE) + sin(radians(lat))) / (CAST(1 AS DOUBLE) - sin(radians(lat)))) / (CAST(4 AS DOUBLE) * pi())) * CAST(67108864 AS DOUBLE) AS y FROM fx_points),
    box AS (SELECT parcel_id, CAST(floor(min(x) / 256) AS BIGINT) AS x0, CAST(floor(max(x) / 256) AS BIGINT) AS x1, CAST(floor(min(y) / 256) AS BIGINT) AS y0, CAST(floor(max(y) / 256) AS BIGINT) AS y1 FROM wp GROUP BY parcel_id),
    cols AS (SELECT parcel_id, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM box)
    SELECT DISTINCT x, unnest(range(y0, y1 + 1)) AS y FROM cols""")
def _(t):
    return imagery.parcel_tiles(t("fx_points"), 18).select("x", "y").distinct()


@query("geometry_features_summary", ["fx_points", "fx_links"], MOMENTS + """,
    ids AS (SELECT DISTINCT parcel_id FROM fx_links WHERE run_id = 'r1')
    SELECT count(*) AS requested, count(p.parcel_id) AS computed, count(*) FILTER (WHERE v.parcel_id IS NULL) AS skipped,
      count(*) FILTER (WHERE v.parcel_id IS NOT NULL AND p.parcel_id IS NULL) AS errors
    FROM ids LEFT JOIN p ON p.parcel_id = ids.parcel_id LEFT JOIN (SELECT DISTINCT parcel_id FROM fx_points) v ON v.parcel_id = ids.parcel_id""")
def _(t):
    """What became of the parcels of a run: requested, computed, skipped for want of vertices, failed."""
    from acremark.plans import analyses
    from acremark.streaming.incremental import pinned_ids

    ids = pinned_ids(t("fx_parcels"), t("fx_links"), "r1")
    return analyses.job_counters(analyses.job_states(ids, t("fx_points"), analyses.geometry_features(t("fx_points"), ids)))


STORED = PIXEL_HITS + """,
    tiles AS (SELECT parcel_id, CAST((floor(max(x0) / 8) - floor(min(x0) / 8) + 1) * (floor(max(y0) / 8) - floor(min(y0) / 8) + 1) AS BIGINT) AS tile_count FROM wp GROUP BY parcel_id),
    made AS (SELECT t.parcel_id, any_value(t.tile_count) AS tile_count, count(i.parcel_id) AS pixels, round(avg(i.g), 6) AS green FROM tiles t LEFT JOIN inside i ON t.parcel_id = i.parcel_id GROUP BY t.parcel_id)
"""


@query("visual_features_stored", ["fx_points", "fx_pixels"], STORED + """
    SELECT parcel_id, CASE WHEN pixels > 0 THEN pixels END AS masked_pixel_count, tile_count, green AS rgb_g_mean, CAST(18 AS INT) AS zoom, 'tiles' AS image_source, CAST(64 AS INT) AS digest_length,
      CASE WHEN pixels = 0 THEN 'parcel mask has no pixels' END AS error FROM made""")
def _(t):
    """A row of every parcel with vertices, with an error where no pixel lies inside."""
    from acremark.plans import analyses

    rows = analyses.visual_features(t("fx_points"), _strips(t), 18, "tiles", 8)
    return rows.select("parcel_id", "masked_pixel_count", "tile_count", F.round("rgb_g_mean", 6).alias("rgb_g_mean"), "zoom", "image_source",
                       F.length("source_geometry_hash").alias("digest_length"), "error")


@query("fill_missing_visual", ["fx_points", "fx_pixels", "fx_parcels", "fx_visual", "fx_links"], STORED + """,
    wanted AS (SELECT DISTINCT l.parcel_id FROM fx_links l JOIN fx_parcels p ON p.parcel_id = l.parcel_id WHERE l.run_id = 'r0' AND l.parcel_id NOT IN (SELECT parcel_id FROM fx_visual)),
    done AS (SELECT w.parcel_id, made.pixels, CASE WHEN made.parcel_id IS NULL THEN 'skipped' WHEN made.pixels = 0 THEN 'error' ELSE 'computed' END AS status FROM wanted w LEFT JOIN made ON made.parcel_id = w.parcel_id),
    sums AS (SELECT count(*) AS requested, count(*) FILTER (WHERE status = 'computed') AS computed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors,
      CAST(coalesce(sum(pixels), 0) AS BIGINT) AS pixels FROM done)
    SELECT 'first' AS job, requested, computed, skipped, errors, requested - computed AS missing_after, pixels + (SELECT CAST(sum(masked_pixel_count) AS BIGINT) FROM fx_visual) AS stored_pixels FROM sums
    UNION ALL SELECT 'again', 0, 0, 0, 0, requested - computed, pixels + (SELECT CAST(sum(masked_pixel_count) AS BIGINT) FROM fx_visual) FROM sums""")
def _(t):
    """Missing imagery figures of a run are filled in; the job run again finds nothing to do."""
    from acremark.plans import analyses
    from acremark.session import cut_lineage

    def job(stored, states):
        return analyses.fill_missing_visual(t("fx_parcels"), t("fx_points"), _strips(t), stored, 18, "tiles", t("fx_links"), "r0", states=states, tile_size=8)

    first = job(t("fx_visual"), None)
    again = job(cut_lineage(first["features"]), first["states"])
    out = None
    for name, done in (("first", first), ("again", again)):
        pixels = done["features"].agg(F.sum("masked_pixel_count").alias("stored_pixels"))
        row = done["report"].join(pixels, F.lit(True)).select(F.lit(name).alias("job"), "*")
        out = row if out is None else out.unionByName(row)
    return out
