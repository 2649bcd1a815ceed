"""Map and report tables, hierarchy, viewports, bundles, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.functions import text
from acremark.operators import geometry, presentation
from acremark.plans import analyses
from acremark.session import scratch_path
from acremark.sources import sinks
from checks.catalog import query
from checks.q_space import PARCEL_IN_VIEW, VIEW

ALL = BBox(15.9, 49.9, 16.5, 52.0)

VIEWER = """
  viewer AS (SELECT parcel_id, coalesce(nullif(parcel_number, ''), parcel_id) AS parcel_number, voivodeship, county, commune, coalesce(precinct, 'unknown') AS precinct,
      round(coalesce(area_m2, 0), 2) AS area_m2, round(coalesce(centroid_lat, (bbox_min_lat + bbox_max_lat) / 2), 7) AS center_lat, round(coalesce(centroid_lon, (bbox_min_lon + bbox_max_lon) / 2), 7) AS center_lon,
      round(bbox_min_lat, 7) AS bbox_min_lat, round(bbox_min_lon, 7) AS bbox_min_lon, round(bbox_max_lat, 7) AS bbox_max_lat, round(bbox_max_lon, 7) AS bbox_max_lon FROM fx_parcels)
"""
GROUPS = f"""WITH {VIEWER},
  sets AS (SELECT 'precinct' AS level, voivodeship || '|' || county || '|' || commune || '|' || precinct AS key, commune || ' / ' || precinct AS label, * FROM viewer
    UNION ALL SELECT 'commune', voivodeship || '|' || county || '|' || commune, county || ' / ' || commune, * FROM viewer
    UNION ALL SELECT 'county', voivodeship || '|' || county, voivodeship || ' / ' || county, * FROM viewer),
  groups AS (SELECT level, key, any_value(label) AS label, count(*) AS count, sum(area_m2) AS area, sum(greatest(0, area_m2) * center_lat) AS alat, sum(greatest(0, area_m2) * center_lon) AS alon, avg(center_lat) AS clat, avg(center_lon) AS clon,
    min(bbox_min_lat) AS min_lat, min(bbox_min_lon) AS min_lon, max(bbox_max_lat) AS max_lat, max(bbox_max_lon) AS max_lon FROM sets GROUP BY level, key)
"""


@query("admin_level_manifest", ["fx_parcels"], """
    WITH lv AS (SELECT 'precinct' AS level, coalesce(precinct, 'brak') AS label, * FROM fx_parcels UNION ALL SELECT 'commune', coalesce(commune, 'brak'), * FROM fx_parcels
      UNION ALL SELECT 'county', coalesce(county, 'brak'), * FROM fx_parcels UNION ALL SELECT 'voivodeship', coalesce(voivodeship, 'brak'), * FROM fx_parcels),
    g AS (SELECT level, label, count(*) AS count, min(bbox_min_lat) AS min_lat, min(bbox_min_lon) AS min_lon, max(bbox_max_lat) AS max_lat, max(bbox_max_lon) AS max_lon FROM lv GROUP BY level, label)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY level ORDER BY count DESC, label) AS INT) AS position FROM g) q WHERE position <= 250""")
def _(t):
    return presentation.admin_manifest(t("fx_parcels"), 250)


@query("manifest_totals", ["fx_parcels"], """
    SELECT count(*) AS parcel_count, min(bbox_min_lat) AS min_lat, min(bbox_min_lon) AS min_lon, max(bbox_max_lat) AS max_lat, max(bbox_max_lon) AS max_lon, min(area_m2) AS area_min_m2, max(area_m2) AS area_max_m2 FROM fx_parcels""")
def _(t):
    return presentation.manifest_totals(t("fx_parcels"))


@query("viewer_parcels", ["fx_parcels"], f"WITH {VIEWER} SELECT * FROM viewer")
def _(t):
    return presentation.viewer_parcels(t("fx_parcels"))


@query("hierarchy_groups", ["fx_parcels"], GROUPS + """
    SELECT level, key, label, count, round(area, 2) AS area_m2, min_lat, min_lon, max_lat, max_lon, round(CASE WHEN area > 0 THEN alat / area ELSE clat END, 7) AS center_lat, round(CASE WHEN area > 0 THEN alon / area ELSE clon END, 7) AS center_lon FROM groups""")
def _(t):
    return presentation.hierarchy_groups(presentation.viewer_parcels(t("fx_parcels"))).drop("voivodeship", "county", "commune", "precinct")


@query("densest_groups", ["fx_parcels"], GROUPS + """
    SELECT label, count, round(count / greatest(CAST(0.000001 AS DOUBLE), abs(max_lat - min_lat) * CAST(111.32 AS DOUBLE) * abs(max_lon - min_lon) * CAST(111.32 AS DOUBLE) * cos(radians((min_lat + max_lat) / 2))), 8) AS density
    FROM groups WHERE level = 'precinct' AND count >= 2 ORDER BY density DESC, label LIMIT 20""")
def _(t):
    groups = presentation.hierarchy_groups(presentation.viewer_parcels(t("fx_parcels"))).where("level = 'precinct'")
    return presentation.densest_groups(groups, limit=20).select("label", "count", F.round("density", 8).alias("density"))


@query("viewport_match_count", ["fx_parcels"], f"SELECT count(*) AS matched FROM fx_parcels WHERE {PARCEL_IN_VIEW} AND area_m2 >= 2000 AND area_m2 <= 8000")
def _(t):
    return presentation.viewport_matches(t("fx_parcels"), VIEW, 2000.0, 8000.0).agg(F.count("*").alias("matched"))


@query("viewport_nearest_parcels", ["fx_parcels", "fx_points", "fx_links"], f"""
    WITH near AS (SELECT *, power(coalesce(centroid_lat, 0) - (CAST(50.01 AS DOUBLE) + CAST(50.06 AS DOUBLE)) / 2, 2) + power(coalesce(centroid_lon, 0) - (CAST(16.05 AS DOUBLE) + CAST(16.25 AS DOUBLE)) / 2, 2) AS d2
      FROM fx_parcels WHERE {PARCEL_IN_VIEW} AND area_m2 >= 2000 AND parcel_id IN (SELECT parcel_id FROM fx_links WHERE run_id = 'r0') ORDER BY round(d2, 14), parcel_id LIMIT 300)
    SELECT n.parcel_id, n.area_m2, count(v.parcel_id) AS vertices, count(DISTINCT v.polygon_index) AS polygons FROM near n LEFT JOIN fx_points v ON v.parcel_id = n.parcel_id GROUP BY n.parcel_id, n.area_m2""")
def _(t):
    ids = t("fx_links").where("run_id = 'r0'")
    top = presentation.viewport(t("fx_parcels"), t("fx_points"), VIEW, 300, 2000.0, None, ids)
    per_ring = F.transform(F.flatten("polygons"), lambda r: F.size(r))
    return top.select("parcel_id", "area_m2", F.aggregate(per_ring, F.lit(0), lambda a, n: a + n).cast("long").alias("vertices"),
                      F.size("polygons").cast("long").alias("polygons"))


AWAY = "sqrt(power((CAST(16.15 AS DOUBLE) - center_lon) * CAST(111320 AS DOUBLE) * cos(radians(CAST(50.035 AS DOUBLE))), 2) + power((CAST(50.035 AS DOUBLE) - center_lat) * CAST(111320 AS DOUBLE), 2))"


@query("two_stage_viewport", ["fx_parcels"], GROUPS + f""",
    placed AS (SELECT *, round(CASE WHEN area > 0 THEN alat / area ELSE clat END, 7) AS center_lat, round(CASE WHEN area > 0 THEN alon / area ELSE clon END, 7) AS center_lon FROM groups WHERE level = 'precinct'),
    chosen AS (SELECT key FROM placed WHERE max_lat >= CAST(50.01 AS DOUBLE) AND min_lat <= CAST(50.06 AS DOUBLE) AND max_lon >= CAST(16.05 AS DOUBLE) AND min_lon <= CAST(16.25 AS DOUBLE) ORDER BY {AWAY}, key LIMIT 80)
    SELECT parcel_id, round({AWAY}, 3) AS distance_m FROM viewer WHERE {PARCEL_IN_VIEW} AND voivodeship || '|' || county || '|' || commune || '|' || precinct IN (SELECT key FROM chosen) ORDER BY distance_m, parcel_id LIMIT 120""")
def _(t):
    viewer = presentation.viewer_parcels(t("fx_parcels"))
    return presentation.two_stage_viewport(presentation.hierarchy_groups(viewer), viewer, VIEW, 80, 120).select("parcel_id", F.round("distance_m", 3).alias("distance_m"))


@query("run_summary_metrics", ["fx_osm", "fx_cells", "fx_links", "fx_prices", "fx_shape"], """
    SELECT 1 AS position, 'canon_osm_features' AS metric, CAST((SELECT count(*) FROM fx_osm) AS DOUBLE) AS value
    UNION ALL SELECT 2, 'mesh_cells', (SELECT count(*) FROM fx_cells WHERE run_id = 'r1') UNION ALL SELECT 3, 'mesh_categories', (SELECT count(DISTINCT category) FROM fx_cells WHERE run_id = 'r1')
    UNION ALL SELECT 4, 'max_mesh_score', (SELECT coalesce(max(score), 0) FROM fx_cells WHERE run_id = 'r1') UNION ALL SELECT 5, 'helper_layer2_run_parcels', (SELECT count(*) FROM fx_links WHERE run_id = 'r1')
    UNION ALL SELECT 6, 'canon_rcn_price_observations', (SELECT count(*) FROM fx_prices WHERE run_id = 'r1') UNION ALL SELECT 7, 'deriv_parcel_geometry_features', (SELECT count(*) FROM fx_shape g JOIN fx_links l ON l.parcel_id = g.parcel_id WHERE l.run_id = 'r1')
    UNION ALL SELECT 8, 'deriv_parcel_visual_features', 0""")
def _(t):
    return presentation.run_metrics(t("fx_osm"), t("fx_cells"), t("fx_links"), t("fx_prices"), t("fx_shape"), None, "r1")


@query("named_top_cells", ["fx_cells"], "SELECT cell_id, category, score, point_count FROM fx_cells WHERE run_id = 'r0' ORDER BY score DESC, cell_id LIMIT 20")
def _(t):
    return presentation.named_top_cells(t("fx_cells"), "r0", 20).select("cell_id", "category", "score", "point_count")


@query("named_run_parcels", ["fx_links", "fx_parcels"], """
    SELECT p.parcel_id, p.parcel_number, p.commune, l.candidate_index, l.source_bbox, round(p.bbox_min_lat, 7) AS bbox_min_lat FROM fx_links l JOIN fx_parcels p ON p.parcel_id = l.parcel_id WHERE l.run_id = 'r0' ORDER BY l.candidate_index, p.parcel_id LIMIT 200""")
def _(t):
    rows = presentation.named_parcels(t("fx_links"), t("fx_parcels"), "r0", 200)
    return rows.select("parcel_id", "parcel_number", "commune", "candidate_index", "source_bbox", F.round("bbox_min_lat", 7).alias("bbox_min_lat"))


@query("named_geometry_by_elongation", ["fx_links", "fx_shape"], """
    SELECT g.parcel_id, round(g.compactness, 4) AS compactness, round(g.elongation_ratio, 4) AS elongation_ratio FROM fx_shape g JOIN fx_links l ON l.parcel_id = g.parcel_id WHERE l.run_id = 'r2' ORDER BY g.elongation_ratio DESC, g.parcel_id LIMIT 100""")
def _(t):
    return presentation.named_geometry(t("fx_links"), t("fx_shape"), "r2", 100).select("parcel_id", "compactness", "elongation_ratio")


@query("named_visual_by_green", ["fx_links", "fx_visual"], """
    SELECT v.parcel_id, v.masked_pixel_count, v.tile_count, v.zoom, round(v.brightness_mean, 2) AS brightness_mean, round(v.green_index_mean, 4) AS green_index_mean, round(v.green_pixel_ratio, 4) AS green_pixel_ratio, round(v.dark_pixel_ratio, 4) AS dark_pixel_ratio,
      round(v.bright_pixel_ratio, 4) AS bright_pixel_ratio, round(v.low_saturation_ratio, 4) AS low_saturation_ratio FROM fx_visual v JOIN fx_links l ON l.parcel_id = v.parcel_id WHERE l.run_id = 'r2' ORDER BY v.green_pixel_ratio DESC, v.parcel_id LIMIT 100""")
def _(t):
    return presentation.named_visual(t("fx_links"), t("fx_visual"), "r2", 100)


RUN_POINTS = """
  shown AS (SELECT * FROM fx_cells WHERE run_id IN ('r0', 'r1')),
  around AS (SELECT min(bbox_min_lat) AS s, min(bbox_min_lon) AS w, max(bbox_max_lat) AS n, max(bbox_max_lon) AS e FROM shown),
  want AS (SELECT DISTINCT tag_key, tag_value, category, run_id FROM shown),
  tags AS (SELECT osm_type, osm_id, name, center_lat, center_lon, tag_key, tag_value FROM fx_osm
    UNION ALL SELECT osm_type, osm_id, name, center_lat, center_lon, 'tourism', 'viewpoint' FROM fx_osm WHERE second_tag AND tag_key <> 'tourism'),
  spots AS (SELECT osm_type, osm_id, any_value(name) AS name, category, arg_min(run_id, tag_key || '|' || tag_value || '|' || run_id) AS run_id
    FROM tags JOIN want USING (tag_key, tag_value) CROSS JOIN around WHERE center_lat BETWEEN s AND n AND center_lon BETWEEN w AND e GROUP BY osm_type, osm_id, category)
"""


@query("points_of_runs", ["fx_osm", "fx_cells"], f"WITH {RUN_POINTS} SELECT * FROM spots")
def _(t):
    shown = t("fx_cells").where("run_id IN ('r0', 'r1')")
    return presentation.points_of_runs(shown, t("fx_osm")).select("osm_type", "osm_id", "name", "category", "run_id")


@query("parcels_of_runs", ["fx_parcels", "fx_links"], "SELECT parcel_id FROM fx_parcels WHERE parcel_id IN (SELECT parcel_id FROM fx_links WHERE run_id IN ('r0', 'r2'))")
def _(t):
    return presentation.parcels_of_runs(t("fx_parcels"), t("fx_links"), ["r0", "r2"]).select("parcel_id")


@query("map_parcels_with_figures", ["fx_parcels", "fx_points", "fx_links", "fx_prices", "fx_shape", "fx_visual"], """
    WITH pr AS (SELECT parcel_id, count(*) AS c, round(avg(price_per_m2), 2) AS a FROM fx_prices WHERE run_id IN ('r0', 'r1') AND price_per_m2 IS NOT NULL GROUP BY parcel_id),
    pts AS (SELECT parcel_id, count(DISTINCT polygon_index) AS polygons FROM fx_points GROUP BY parcel_id)
    SELECT p.parcel_id, coalesce(pr.c, 0) AS rcn_records, pr.a AS avg_price_per_m2, g.compactness, v.green_pixel_ratio, round((p.bbox_min_lat + p.bbox_max_lat) / 2, 7) AS lat, pts.polygons
    FROM fx_parcels p JOIN pts ON pts.parcel_id = p.parcel_id LEFT JOIN pr ON pr.parcel_id = p.parcel_id LEFT JOIN fx_shape g ON g.parcel_id = p.parcel_id LEFT JOIN fx_visual v ON v.parcel_id = p.parcel_id
    WHERE p.parcel_id IN (SELECT parcel_id FROM fx_links WHERE run_id IN ('r0', 'r1'))""")
def _(t):
    rows = presentation.map_parcels(t("fx_parcels"), t("fx_points"), t("fx_links"), ["r0", "r1"], t("fx_prices"), t("fx_shape"), t("fx_visual"))
    return rows.select("parcel_id", "rcn_records", "avg_price_per_m2", "compactness", "green_pixel_ratio", F.round("lat", 7).alias("lat"),
                       F.size("polygons").cast("long").alias("polygons"))


@query("presentation_counts", ["fx_osm", "fx_cells", "fx_parcels", "fx_links", "fx_points"], f"""WITH {RUN_POINTS}
    SELECT 'mesh_cells' AS part, (SELECT count(*) FROM fx_cells WHERE run_id IN ('r0', 'r1')) AS n UNION ALL SELECT 'osm_points', (SELECT count(*) FROM spots)
    UNION ALL SELECT 'parcels', (SELECT count(*) FROM fx_parcels WHERE parcel_id IN (SELECT parcel_id FROM fx_links WHERE run_id IN ('r0', 'r1')))
    UNION ALL SELECT 'categories', (SELECT count(*) FROM (SELECT category FROM fx_cells WHERE run_id IN ('r0', 'r1') UNION SELECT category FROM spots) u)
    UNION ALL SELECT 'top_candidates', (SELECT least(10, count(*)) FROM (SELECT DISTINCT bbox_min_lat, bbox_min_lon FROM (SELECT * FROM fx_cells WHERE run_id IN ('r0', 'r1') ORDER BY score DESC, run_id, cell_id LIMIT 50) b) d)""")
def _(t):
    bundle = analyses.presentation_bundle(["r0", "r1"], t("fx_cells"), t("fx_osm"), t("fx_parcels"), t("fx_points"), t("fx_links"), None,
                                           None, None, scanned=50, kept=10)
    names = {"cells": "mesh_cells", "points": "osm_points", "parcels": "parcels", "categories": "categories", "top_candidates": "top_candidates"}
    parts = [bundle[k].agg(F.lit(n).alias("part"), F.count("*").alias("n")) for k, n in names.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("categories_union", ["fx_cells", "fx_osm"], "SELECT category FROM fx_cells WHERE run_id = 'r0' UNION SELECT tag_key || '_' || tag_value FROM fx_osm")
def _(t):
    points = t("fx_osm").select(F.concat_ws("_", "tag_key", "tag_value").alias("category"))
    return presentation.categories_union(t("fx_cells").where("run_id = 'r0'"), points)


@query("run_artifacts", ["fx_artifacts"], """
    SELECT id, producer, artifact_type, artifact_key, (SELECT count(*) FROM fx_artifacts WHERE run_id = 'u2') AS artifact_count FROM fx_artifacts WHERE run_id = 'u2'""")
def _(t):
    return presentation.run_artifacts(t("fx_artifacts"), "u2").select("id", "producer", "artifact_type", "artifact_key", "artifact_count")


@query("latest_artifacts", ["fx_artifacts"], """
    SELECT run_id, artifact_type, artifact_key, id, payload_json FROM (SELECT *, row_number() OVER (PARTITION BY run_id, artifact_type, artifact_key ORDER BY updated_at DESC, id DESC) AS rn FROM fx_artifacts) q WHERE rn = 1""")
def _(t):
    return presentation.latest_artifacts(t("fx_artifacts")).select("run_id", "artifact_type", "artifact_key", "id", "payload_json")


# --- sinks ---------------------------------------------------------------------------------


@query("geojson_cells", ["fx_cells"], """
    SELECT cell_id, score, CAST(CAST(round(bbox_min_lon * 1000000) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(bbox_max_lat * 1000000) AS BIGINT) AS VARCHAR) AS corners, CAST(5 AS INT) AS ring_points FROM fx_cells""")
def _(t):
    """Cells written as GeoJSON lines and read back with Spark's JSON source."""
    from acremark.functions.geo import closed_box_ring
    from acremark.operators.filters import BOUNDS

    path = scratch_path(t.spark, "geojson")
    ring = closed_box_ring(*[F.col(b) for b in BOUNDS])
    sinks.write_geojson(t("fx_cells"), sinks.ring_geometry_json(ring), ["cell_id", "score"], path)
    schema = "type string, properties struct<cell_id:string,score:double>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    back = t.spark.read.schema(schema).json(path).where("type = 'Feature' AND geometry.type = 'Polygon'")

    def micro(c):
        return F.round(c * 1_000_000).cast("long").cast("string")

    r = F.col("geometry.coordinates")[0]
    return back.select("properties.cell_id", "properties.score", F.concat_ws(" ", micro(r[0][0]), micro(r[2][1])).alias("corners"),
                       F.size(r).alias("ring_points"))


@query("geojson_parcels", ["fx_points"], """
    SELECT parcel_id, CASE WHEN count(DISTINCT polygon_index) = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind FROM fx_points GROUP BY parcel_id""")
def _(t):
    path = scratch_path(t.spark, "geojson-parcels")
    nested = geometry.nested_geometry(t("fx_points"))
    sinks.write_geojson(nested, geometry.geojson_geometry(F.col("polygons")), ["parcel_id"], path)
    back = t.spark.read.schema("properties struct<parcel_id:string>, geometry struct<type:string>").json(path)
    return back.select("properties.parcel_id", F.col("geometry.type").alias("kind"))


@query("json_rows_sink", ["fx_shape"], "SELECT 'shape' AS query_name, 'r0' AS run_id, count(*) AS row_count FROM fx_shape")
def _(t):
    return sinks.write_rows(t("fx_shape"), scratch_path(t.spark, "rows"), "shape", "r0")


@query("map_chunks", ["fx_parcels", "fx_points"], f"""WITH {VIEWER} SELECT v.voivodeship, v.county, v.commune, v.precinct, count(*) AS parcels, CAST(sum(c.n) AS BIGINT) AS polygons
    FROM viewer v JOIN (SELECT parcel_id, count(DISTINCT polygon_index) AS n FROM fx_points GROUP BY parcel_id) c ON c.parcel_id = v.parcel_id GROUP BY 1, 2, 3, 4""")
def _(t):
    """One directory per precinct with nested geometry, read back and counted."""
    path = scratch_path(t.spark, "chunks")
    viewer = presentation.viewer_parcels(t("fx_parcels"))
    sinks.write_chunks(viewer, geometry.nested_geometry(t("fx_points"), lat_first=True, digits=7), path)
    schema = "parcel_id string, polygons array<array<array<array<double>>>>, voivodeship string, county string, commune string, precinct string"
    back = t.spark.read.schema(schema).json(path)
    return back.groupBy("voivodeship", "county", "commune", "precinct").agg(
        F.count("*").alias("parcels"), F.sum(F.size("polygons")).alias("polygons"))


@query("slugs_and_labels", ["fx_parcels"], """
    SELECT parcel_id, trim(regexp_replace(regexp_replace(coalesce(precinct, ' '), '[^a-zA-Z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_') AS raw FROM fx_parcels WHERE precinct IS NOT NULL
    UNION ALL SELECT parcel_id, 'unknown' FROM fx_parcels WHERE precinct IS NULL""")
def _(t):
    return t("fx_parcels").select("parcel_id", text.slug(text.clean_part(F.col("precinct"))).alias("raw"))
