"""Trail network."""

from __future__ import annotations

from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.operators import filters, graph
from acremark.plans import analyses
from checks.catalog import query
from checks.q_space import HAV

NET = BBox(15.99, 49.99, 16.61, 50.41)
EASY = "highway IN ('path', 'track') AND sac_scale IN ('', 'T1')"
NODE = "(CAST(round((lat + 90) * 1000000) AS BIGINT) * 1000000000 + CAST(round((lon + 180) * 1000000) AS BIGINT))"
PAIRS = f"""
  easy AS (SELECT way_id, k, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fx_ways WHERE {EASY}),
  legs AS (SELECT way_id, {NODE} AS src, lat, lon, lead({NODE}) OVER w AS dst, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM easy WINDOW w AS (PARTITION BY way_id ORDER BY k)),
  one_way AS (SELECT *, {HAV.format('lat', 'lon', 'lat2', 'lon2')} AS distance FROM legs WHERE dst IS NOT NULL AND src <> dst),
  edges AS (SELECT src, dst, distance FROM one_way UNION ALL SELECT dst, src, distance FROM one_way)
"""


def _ways(t):
    """Ways with a point array, as the map service gives them."""
    spot = F.struct("k", F.struct("lat", "lon").alias("p"))
    return t("fx_ways").groupBy("way_id", "highway", "sac_scale").agg(
        F.transform(F.sort_array(F.collect_list(spot)), lambda s: s["p"]).alias("geometry")
    ).select(F.col("way_id").alias("id"), F.create_map(F.lit("highway"), "highway", F.lit("sac_scale"), "sac_scale").alias("tags"), "geometry")


def _edges(t):
    return graph.way_edges(filters.easy_trails(_ways(t)))


@query("easy_trail_ways", ["fx_ways"], f"SELECT way_id, 'way/' || CAST(way_id AS VARCHAR) AS name, CAST(count(*) AS INT) AS points FROM fx_ways WHERE {EASY} GROUP BY way_id HAVING count(*) >= 2")
def _(t):
    return filters.easy_trails(_ways(t)).select("way_id", "name", F.size("geometry").alias("points"))


@query("way_edges", ["fx_ways"], f"WITH {PAIRS} SELECT src, dst, round(distance, 3) AS distance FROM edges")
def _(t):
    return _edges(t).select("src", "dst", F.round("distance", 3).alias("distance"))


@query("edges_inside_margin", ["fx_ways"], f"""WITH {PAIRS},
    n AS (SELECT DISTINCT src AS node, round(floor(src / CAST(1000000000 AS DOUBLE)) / 1000000 - 90, 6) AS lat, round((src % 1000000000) / CAST(1000000 AS DOUBLE) - 180, 6) AS lon FROM edges),
    kept AS (SELECT node FROM n WHERE lat BETWEEN CAST(49.99 AS DOUBLE) + CAST(5000 AS DOUBLE) / CAST(111320 AS DOUBLE) AND CAST(50.41 AS DOUBLE) - CAST(5000 AS DOUBLE) / CAST(111320 AS DOUBLE)
      AND lon BETWEEN CAST(15.99 AS DOUBLE) + CAST(5000 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians(lat))) AND CAST(16.61 AS DOUBLE) - CAST(5000 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians(lat))))
    SELECT src, dst FROM edges WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)""")
def _(t):
    return graph.edges_inside(_edges(t), NET, 5.0).select("src", "dst")


@query("connected_components", ["fx_ways"], f"""WITH RECURSIVE {PAIRS},
    links AS (SELECT DISTINCT src, dst FROM edges),
    lab(node, label) USING KEY (node) AS (
      SELECT src, src FROM links GROUP BY src
      UNION SELECT e.dst, min(l.label) FROM lab l JOIN links e ON e.src = l.node JOIN recurring.lab r ON r.node = e.dst WHERE l.label < r.label GROUP BY e.dst)
    SELECT node, label AS component FROM lab""")
def _(t):
    return graph.connected_components(_edges(t))


@query("component_sizes_by_reach", ["fx_ways"], f"""WITH RECURSIVE {PAIRS},
    reach(node) AS (SELECT min(src) FROM edges UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.node)
    SELECT count(*) AS nodes, min(node) AS component FROM reach""")
def _(t):
    """Size of the component that holds the smallest node; SQL walks the same edges."""
    components = graph.connected_components(_edges(t))
    smallest = components.agg(F.min("node").alias("m")).scalar()
    return components.where(F.col("component") == smallest).groupBy("component").agg(F.count("*").alias("nodes"))


@query("single_source_distances", ["fx_ways"], f"""WITH RECURSIVE {PAIRS},
    links AS (SELECT src, dst, min(distance) AS distance FROM edges GROUP BY src, dst),
    paths(node, metres) USING KEY (node) AS (
      SELECT min(src), CAST(0 AS DOUBLE) FROM links
      UNION SELECT e.dst, min(p.metres + e.distance) FROM paths p JOIN links e ON e.src = p.node LEFT JOIN recurring.paths r ON r.node = e.dst WHERE r.node IS NULL OR p.metres + e.distance < r.metres GROUP BY e.dst)
    SELECT node, round(metres, 3) AS distance FROM paths""")
def _(t):
    edges = _edges(t)
    paths = graph.shortest_paths(edges, edges.agg(F.min("src").alias("node")))
    return paths.select("node", F.round("distance", 3).alias("distance"))


@query("running_distance", ["fx_ways"], f"""WITH legs AS (SELECT way_id, k, {HAV.format('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS leg FROM fx_ways WINDOW w AS (PARTITION BY way_id ORDER BY k))
    SELECT way_id, k, round(sum(coalesce(leg, 0)) OVER (PARTITION BY way_id ORDER BY k), 2) AS metres FROM legs""")
def _(t):
    return graph.running_distance(t("fx_ways"), ["way_id"], "k").select("way_id", "k", F.round("metres", 2).alias("metres"))


@query("positions_on_segments", ["fx_ways", "fx_osm"], f"""WITH line AS (SELECT k, lat, lon, coalesce(sum(leg) OVER (ORDER BY k), 0) AS m FROM (SELECT k, lat, lon, {HAV.format('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS leg FROM (SELECT k, lat, lon FROM fx_ways) a WINDOW w AS (ORDER BY k)) b),
    seg AS (SELECT m AS start_m, lead(m) OVER (ORDER BY k) AS end_m, lat, lon, lead(lat) OVER (ORDER BY k) AS lat2, lead(lon) OVER (ORDER BY k) AS lon2 FROM line),
    pos AS (SELECT osm_id, CAST(osm_id AS DOUBLE) * CAST(997.3 AS DOUBLE) + 1 AS metre FROM fx_osm)
    SELECT p.osm_id, round(s.lat + (s.lat2 - s.lat) * ((p.metre - s.start_m) / greatest(CAST(0.000000001 AS DOUBLE), s.end_m - s.start_m)), 7) AS lat, round(s.lon + (s.lon2 - s.lon) * ((p.metre - s.start_m) / greatest(CAST(0.000000001 AS DOUBLE), s.end_m - s.start_m)), 7) AS lon
    FROM pos p JOIN seg s ON p.metre > s.start_m AND p.metre <= s.end_m""")
def _(t):
    """One line through all way points in key order; features give positions along it."""
    from acremark.functions.geo import interpolate
    from acremark.operators.spatial import interval_locate

    one = t("fx_ways").select(F.lit(1).alias("line"), "k", "lat", "lon")
    segments = graph.line_segments(graph.running_distance(one, ["line"], "k"), ["line"], "k", "metres")
    spots = t("fx_osm").select("osm_id", (F.col("osm_id").cast("double") * 997.3 + 1).alias("metre"))
    hit = interval_locate(spots, segments, "metre", "start_m", "end_m", 5000.0)

    def at(a, b):
        return interpolate(F.col(a), F.col(b), F.col("start_m"), F.col("end_m"), F.col("metre")).alias(a)

    return hit.select("osm_id", at("lat", "lat2"), at("lon", "lon2"))


@query("trail_boxes", ["fx_ways"])
def _(t):
    return analyses.trail_boxes(_ways(t), NET, 0.0, 20, 10.0, 2.0)["boxes"]
