"""Hotspots, candidates, coverage, ranking and the flagship chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.functions.scoring import Weights
from acremark.operators import coverage, filters, geometry, hotspots, ranking
from acremark.plans import analyses
from checks.catalog import query
from checks.q_space import EDGES, MATCHES, MOMENTS, TYPES

AREA = BBox(16.0, 50.0, 16.4, 50.11)
NODE = [("amenity", "cafe"), ("tourism", "viewpoint")]

# --- uniform grid --------------------------------------------------------------------------

GRID = """
  grid AS (SELECT CAST(least(CAST(19 AS DOUBLE), greatest(CAST(0 AS DOUBLE), floor((center_lon - CAST(16 AS DOUBLE)) / (CAST(16.4 AS DOUBLE) - CAST(16 AS DOUBLE)) * 20))) AS INT) AS x,
                  CAST(least(CAST(19 AS DOUBLE), greatest(CAST(0 AS DOUBLE), floor((center_lat - CAST(50 AS DOUBLE)) / (CAST(50.11 AS DOUBLE) - CAST(50 AS DOUBLE)) * 20))) AS INT) AS y
           FROM (SELECT DISTINCT osm_type, osm_id, center_lat, center_lon FROM matches)
           WHERE center_lat BETWEEN CAST(50 AS DOUBLE) AND CAST(50.11 AS DOUBLE) AND center_lon BETWEEN CAST(16 AS DOUBLE) AND CAST(16.4 AS DOUBLE)),
  counts AS (SELECT x, y, count(*) AS score FROM grid GROUP BY x, y ORDER BY score DESC, x, y LIMIT 500)
"""


@query("uniform_grid_hotspots", ["fx_osm"], f"""WITH {MATCHES}, {GRID}
    SELECT 'osm_' || CAST(x AS VARCHAR) || '_' || CAST(y AS VARCHAR) AS candidate_id, score,
      round(CAST(16 AS DOUBLE) + (CAST(16.4 AS DOUBLE) - CAST(16 AS DOUBLE)) * (x + CAST(0.5 AS DOUBLE)) / 20, 8) AS center_lon,
      round(CAST(50 AS DOUBLE) + (CAST(50.11 AS DOUBLE) - CAST(50 AS DOUBLE)) * (y + CAST(0.5 AS DOUBLE)) / 20, 8) AS center_lat FROM counts""")
def _(t):
    grid = analyses.hotspot_grid(t("fx_osm"), AREA, TYPES, 20, 500)
    return grid.select("candidate_id", "score", F.round("center_lon", 8).alias("center_lon"), F.round("center_lat", 8).alias("center_lat"))


# --- kernel mesh ---------------------------------------------------------------------------

MESH_BOX = BBox(16.1, 50.02, 16.3, 50.09)
MESH_IN = """
  pts AS (SELECT category, center_lat AS lat, center_lon AS lon FROM matches WHERE CASE WHEN bbox_min_lat IS NOT NULL THEN bbox_max_lat >= CAST(50.02 AS DOUBLE) AND bbox_min_lat <= CAST(50.09 AS DOUBLE) AND bbox_max_lon >= CAST(16.1 AS DOUBLE) AND bbox_min_lon <= CAST(16.3 AS DOUBLE)
        ELSE center_lat BETWEEN CAST(50.02 AS DOUBLE) AND CAST(50.09 AS DOUBLE) AND center_lon BETWEEN CAST(16.1 AS DOUBLE) AND CAST(16.3 AS DOUBLE) END)
"""
MESH = f"""WITH {MATCHES}, {MESH_IN},
    ax AS (SELECT i AS x, CAST(16.1 AS DOUBLE) + (CAST(16.3 AS DOUBLE) - CAST(16.1 AS DOUBLE)) * i / 12 AS lon0, CAST(16.1 AS DOUBLE) + (CAST(16.3 AS DOUBLE) - CAST(16.1 AS DOUBLE)) * (i + 1) / 12 AS lon1 FROM range(12) r(i)),
    ay AS (SELECT i AS y, CAST(50.02 AS DOUBLE) + (CAST(50.09 AS DOUBLE) - CAST(50.02 AS DOUBLE)) * i / 7 AS lat0, CAST(50.02 AS DOUBLE) + (CAST(50.09 AS DOUBLE) - CAST(50.02 AS DOUBLE)) * (i + 1) / 7 AS lat1 FROM range(7) r(i)),
    tri AS (SELECT 0 AS t, y, x, (lat0 + lat1 + lat1) / 3 AS clat, (lon0 + lon0 + lon1) / 3 AS clon FROM ax CROSS JOIN ay
      UNION ALL SELECT 1, y, x, (lat0 + lat1 + lat0) / 3, (lon0 + lon1 + lon1) / 3 FROM ax CROSS JOIN ay),
    scored AS (SELECT p.category, t.t, t.y, t.x, any_value(clat) AS clat, any_value(clon) AS clon, count(*) AS n,
        sum(exp(-(power((p.lat - clat) * CAST(111320 AS DOUBLE), 2) + power((p.lon - clon) * CAST(111320 AS DOUBLE) * cos(radians((CAST(50.02 AS DOUBLE) + CAST(50.09 AS DOUBLE)) / 2)), 2)) / (CAST(2 AS DOUBLE) * 450 * 450))) AS score
      FROM pts p CROSS JOIN tri t GROUP BY p.category, t.t, t.y, t.x),
    normed AS (SELECT *, score / max(score) OVER (PARTITION BY category) AS norm FROM scored)
"""


@query("kernel_density_mesh", ["fx_osm"], MESH + """
    SELECT category, CAST(t AS INT) AS t, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(score, 7) AS score, round(norm, 7) AS norm, n AS source_point_count, round(clat, 8) AS center_lat, round(clon, 8) AS center_lon
    FROM normed WHERE norm >= CAST(0.2 AS DOUBLE)""")
def _(t):
    near = t("fx_osm").where(filters.feature_overlaps_bbox(MESH_BOX))
    mesh = hotspots.kernel_mesh(filters.match_tags(near, TYPES), MESH_BOX, 12, 450.0, 0.2, "center_lat", "center_lon")
    return mesh.select("category", "t", "y", "x", F.round("score", 7).alias("score"), F.round("norm", 7).alias("norm"),
                       "source_point_count", F.round("center_lat", 8).alias("center_lat"), F.round("center_lon", 8).alias("center_lon"))


@query("hotspot_mesh_run", ["fx_osm"], MESH + """
    SELECT 'run-a_' || lpad(CAST(row_number() OVER (ORDER BY score DESC, category, y, x, t) AS VARCHAR), 5, '0') AS cell_id, 'run-a' AS run_id, category, round(score, 7) AS score FROM normed""")
def _(t):
    cells = analyses.hotspot_mesh(t("fx_osm"), MESH_BOX, TYPES, "run-a", nx=12)
    return cells.select("cell_id", "run_id", "category", F.round("score", 7).alias("score"))


@query("mesh_category_stats", ["fx_osm"], MESH + """,
    wanted AS (SELECT * FROM (VALUES ('amenity_cafe'), ('tourism_viewpoint'), ('shop_supermarket'), ('amenity_bar')) AS w(category))
    SELECT w.category, coalesce(s.c, 0) AS stored_matching_points, coalesce(m.c, 0) AS mesh_triangles FROM wanted w
    LEFT JOIN (SELECT category, count(*) AS c FROM pts GROUP BY category) s ON s.category = w.category
    LEFT JOIN (SELECT category, count(*) AS c FROM normed GROUP BY category) m ON m.category = w.category""")
def _(t):
    types = [*TYPES, ("amenity", "bar")]
    cells = analyses.hotspot_mesh(t("fx_osm"), MESH_BOX, types, "run-a", nx=12)
    return analyses.mesh_category_stats(t("fx_osm"), cells, MESH_BOX, types)


# --- quadtree ------------------------------------------------------------------------------

QUAD_CFG = hotspots.QuadtreeConfig(max_depth=4, min_points=5, min_cell_m=300.0, hotspot_percentile=0.6, max_area_m2=30_000_000.0)


def _levels(depth: int) -> str:
    """Quadtree levels as a chain of CTEs; bounds by halving, edge points on both sides."""
    parts = ["""q0 AS (SELECT category, lat, lon, 0 AS depth, CAST(0 AS BIGINT) AS iy, CAST(0 AS BIGINT) AS ix, CAST(50 AS DOUBLE) AS s, CAST(50.11 AS DOUBLE) AS n, CAST(16 AS DOUBLE) AS w, CAST(16.4 AS DOUBLE) AS e FROM pts)"""]
    for d in range(1, depth + 1):
        parts.append(f"""q{d} AS (SELECT * FROM (SELECT category, lat, lon, {d} AS depth, iy * 2 + a AS iy, ix * 2 + b AS ix,
            CASE WHEN a = 1 THEN (s + n) / 2 ELSE s END AS s, CASE WHEN a = 1 THEN n ELSE (s + n) / 2 END AS n,
            CASE WHEN b = 1 THEN (w + e) / 2 ELSE w END AS w, CASE WHEN b = 1 THEN e ELSE (w + e) / 2 END AS e
          FROM q{d - 1} CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS h(a, b)) z WHERE lat BETWEEN s AND n AND lon BETWEEN w AND e)""")
    union = " UNION ALL ".join(f"SELECT * FROM q{d}" for d in range(depth + 1))
    parts.append(f"""cells AS (SELECT category, depth, iy, ix, s, n, w, e, count(*) AS c,
        (e - w) * CAST(111320 AS DOUBLE) * cos(radians((s + n) / 2)) * (n - s) * CAST(111320 AS DOUBLE) AS area,
        least((n - s) * CAST(111320 AS DOUBLE), (e - w) * CAST(111320 AS DOUBLE) * cos(radians((s + n) / 2))) AS side
      FROM ({union}) u GROUP BY category, depth, iy, ix, s, n, w, e)""")
    parts.append("""scored AS (SELECT *, c / (area / 1000000) AS density, c / (area / 1000000) * ln(1 + CAST(c AS DOUBLE)) AS score FROM cells)""")
    return ",\n".join(parts)


QUAD = f"""WITH {MATCHES},
    pts AS (SELECT category, center_lat AS lat, center_lon AS lon FROM matches),
    {_levels(4)},
    visited AS (SELECT k.* FROM scored k WHERE depth = 0 OR EXISTS (SELECT 1 FROM scored p WHERE p.category = k.category AND p.depth = k.depth - 1
        AND p.iy = k.iy // 2 AND p.ix = k.ix // 2 AND p.depth < 4 AND p.side >= 300 AND p.c >= 5))
"""
QUAD_HOT = QUAD + """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY density) AS rn, count(*) OVER (PARTITION BY category) AS m FROM visited),
    thr AS (SELECT category, density AS threshold FROM ranked WHERE rn - 1 = floor((m - 1) * CAST(0.6 AS DOUBLE))),
    hot AS (SELECT v.*, v.category || '_' || lpad(CAST(row_number() OVER (PARTITION BY v.category ORDER BY score DESC, depth, iy, ix) AS VARCHAR), 4, '0') AS id
      FROM visited v JOIN thr USING (category) WHERE c >= 5 AND area BETWEEN 10000 AND 30000000 AND density >= threshold)
"""


def _matched(t):
    return filters.match_tags(t("fx_osm"), TYPES)


@query("quadtree_visited_cells", ["fx_osm"], QUAD + """
    SELECT category, CAST(depth AS INT) AS depth, iy, ix, c AS point_count, round(area, 1) AS area_m2, round(density, 6) AS density_per_km2, round(score, 5) AS score FROM visited""")
def _(t):
    cells = hotspots.quadtree_cells(_matched(t), AREA, QUAD_CFG, None, "center_lat", "center_lon")
    return cells.select("category", "depth", "iy", "ix", "point_count", F.round("area_m2", 1).alias("area_m2"),
                        F.round("density_per_km2", 6).alias("density_per_km2"), F.round("score", 5).alias("score"))


@query("quadtree_hotspots", ["fx_osm"], QUAD_HOT + "SELECT id, category, c AS point_count, round(score, 5) AS score FROM hot")
def _(t):
    cells = hotspots.quadtree_hotspots(_matched(t), AREA, QUAD_CFG, None, "center_lat", "center_lon")
    return cells.select("id", "category", "point_count", F.round("score", 5).alias("score"))


@query("nearest_rank_percentile", ["fx_cells"], """
    WITH r AS (SELECT run_id, category, score, row_number() OVER (PARTITION BY run_id, category ORDER BY score) AS rn, count(*) OVER (PARTITION BY run_id, category) AS m FROM fx_cells)
    SELECT run_id, category, score AS threshold FROM r WHERE rn - 1 = floor((m - 1) * CAST(0.75 AS DOUBLE))""")
def _(t):
    return hotspots.nearest_rank(t("fx_cells"), "score", ["run_id", "category"], F.lit(0.75), "threshold")


SUPPRESSED = QUAD_HOT + """,
    -- a cell goes if a better kept cell of its category overlaps it: kept and dropped cells level by level
    pairs AS (SELECT a.id AS better, b.id AS worse FROM hot a JOIN hot b ON a.category = b.category AND a.id <> b.id
        AND a.s < b.n AND b.s < a.n AND a.w < b.e AND b.w < a.e AND (a.score > b.score OR (a.score = b.score AND a.id < b.id))),
    k1 AS (SELECT id FROM hot WHERE id NOT IN (SELECT worse FROM pairs)),
    d1 AS (SELECT DISTINCT worse AS id FROM pairs WHERE better IN (SELECT id FROM k1)),
    k2 AS (SELECT id FROM hot h WHERE id NOT IN (SELECT id FROM d1) AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.worse = h.id AND p.better NOT IN (SELECT id FROM d1))),
    d2 AS (SELECT DISTINCT worse AS id FROM pairs WHERE better IN (SELECT id FROM k2)),
    k3 AS (SELECT id FROM hot h WHERE id NOT IN (SELECT id FROM d2) AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.worse = h.id AND p.better NOT IN (SELECT id FROM d2)))
"""


@query("overlap_suppression", ["fx_osm"], SUPPRESSED + "SELECT h.id, h.category, round(h.score, 5) AS score FROM hot h WHERE h.id IN (SELECT id FROM k3)")
def _(t):
    cells = hotspots.quadtree_hotspots(_matched(t), AREA, QUAD_CFG, None, "center_lat", "center_lon")
    return hotspots.suppress_overlaps(cells, 0.7).select("id", "category", F.round("score", 5).alias("score"))


@query("quadtree_chain", ["fx_osm"], SUPPRESSED + """
    SELECT h.id, h.category, h.c AS point_count, round(h.score, 5) AS score, round(h.score / (SELECT max(score) FROM hot WHERE id IN (SELECT id FROM k3)), 7) AS norm FROM hot h WHERE h.id IN (SELECT id FROM k3)""")
def _(t):
    """The whole chain with thinning switched off, which SQL can follow."""
    cells = analyses.hotspot_quadtree(t("fx_osm"), AREA, TYPES, QUAD_CFG.override(dedupe_radius_m=0.0))
    return cells.select("id", "category", "point_count", F.round("score", 5).alias("score"), F.round("norm", 7).alias("norm"))


def thinned(radius: float, rounds: int = 16) -> str:
    """SQL of the points that stay when they are gone through in order: in each round those that no open earlier point is near to.

    The last round must leave none open, else the text raises.
    """
    parts = [MATCHES.strip(), f"""
    spot AS MATERIALIZED (SELECT row_number() OVER (ORDER BY category, osm_type, osm_id) AS id, category, osm_type, osm_id, center_lat, center_lon,
        center_lon * (CAST(111320 AS DOUBLE) * cos(radians(CAST({AREA.mid_lat} AS DOUBLE)))) AS x, center_lat * CAST(111320 AS DOUBLE) AS y FROM matches
      WHERE center_lat IS NOT NULL AND center_lon IS NOT NULL),
    near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM spot a JOIN spot b ON a.category = b.category AND a.id < b.id
      AND b.x BETWEEN a.x - {radius} AND a.x + {radius} AND b.y BETWEEN a.y - {radius} AND a.y + {radius} AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {radius}),
    o0 AS MATERIALIZED (SELECT id FROM spot)"""]
    for r in range(rounds):
        parts.append(f"""
    k{r} AS MATERIALIZED (SELECT id FROM o{r} WHERE id NOT IN (SELECT n.b FROM near n JOIN o{r} e ON e.id = n.a)),
    o{r + 1} AS MATERIALIZED (SELECT id FROM o{r} WHERE id NOT IN (SELECT id FROM k{r}) AND id NOT IN (SELECT n.b FROM near n JOIN k{r} k ON k.id = n.a))""")
    kept = " UNION ALL ".join(f"SELECT id FROM k{r}" for r in range(rounds))
    parts.append(f"""
    kept AS (SELECT spot.* FROM spot JOIN ({kept}) u ON u.id = spot.id
      WHERE CASE WHEN (SELECT count(*) FROM o{rounds}) > 0 THEN error('points are still open') ELSE true END)""")
    return "WITH " + ",".join(parts)


@query("radius_thinning", ["fx_osm"], thinned(120.0) + " SELECT osm_type, osm_id, category FROM kept")
def _(t):
    return hotspots.thin_by_radius(_matched(t), ["osm_type", "osm_id"], ["category"], 120.0, AREA.mid_lat, "center_lat", "center_lon").select(
        "osm_type", "osm_id", "category")


@query("quadtree_chain_thinned", ["fx_osm"])
def _(t):
    """Thinning on, with a category of its own settings; tested against loops."""
    return analyses.hotspot_quadtree(t("fx_osm"), AREA, TYPES, QUAD_CFG, {"amenity_cafe": QUAD_CFG.override(min_points=4)}).select(
        "id", "category", "point_count", "score", "norm")


@query("quadtree_category_stats", ["fx_osm"], thinned(25.0) + f""",
    inside AS (SELECT *, center_lat BETWEEN {AREA.min_lat} AND {AREA.max_lat} AND center_lon BETWEEN {AREA.min_lon} AND {AREA.max_lon} AS ok FROM spot)
    SELECT category, count(*) AS stored_matching_points, count(*) FILTER (WHERE ok) AS in_bbox_points, count(*) FILTER (WHERE NOT ok) AS outside_bbox_points,
      (SELECT count(*) FROM kept WHERE kept.category = inside.category) AS deduped_points FROM inside GROUP BY category""")
def _(t):
    """All features lie in the area, so thinning them all and thinning those inside is the same."""
    return analyses.quadtree_points(t("fx_osm"), AREA, TYPES)[1]


# --- candidates ----------------------------------------------------------------------------


@query("ranked_candidates", ["fx_cells"], """
    WITH usable AS (SELECT *, row_number() OVER (PARTITION BY bbox_min_lat, bbox_min_lon, bbox_max_lat, bbox_max_lon ORDER BY score DESC, cell_id) AS rn FROM fx_cells WHERE run_id = 'r0' AND category <> 'amenity_school'),
    top AS (SELECT *, row_number() OVER (ORDER BY score DESC, cell_id) AS pos FROM usable WHERE rn = 1)
    SELECT CAST(pos AS INT) AS candidate_index, cell_id, category, score, point_count FROM top WHERE pos <= 20""")
def _(t):
    return ranking.ranked_candidates(t("fx_cells"), "r0", 20, ["amenity_school"]).select(
        "candidate_index", "cell_id", "category", "score", "point_count")


@query("top_distinct_boxes", ["fx_cells"], """
    WITH best AS (SELECT * FROM fx_cells WHERE run_id IN ('r0', 'r1') ORDER BY score DESC, run_id, cell_id LIMIT 50),
    d AS (SELECT *, row_number() OVER (PARTITION BY bbox_min_lat, bbox_min_lon, bbox_max_lat, bbox_max_lon ORDER BY score DESC, run_id, cell_id) AS rn FROM best)
    SELECT cell_id, run_id, category, score FROM d WHERE rn = 1 ORDER BY score DESC, run_id, cell_id LIMIT 10""")
def _(t):
    return ranking.top_distinct_boxes(t("fx_cells"), ["r0", "r1"], 50, 10).select("cell_id", "run_id", "category", "score")


@query("multi_run_top_rows", ["fx_cells"], "SELECT cell_id, run_id, score FROM fx_cells WHERE run_id IN ('r1', 'r2') ORDER BY score DESC, run_id, cell_id LIMIT 40")
def _(t):
    return ranking.top_rows(t("fx_cells"), ["r1", "r2"], 40).select("cell_id", "run_id", "score")


@query("scores_over_group_maximum", ["fx_cells"], "SELECT cell_id, round(score / max(score) OVER (PARTITION BY run_id, category), 9) AS norm FROM fx_cells")
def _(t):
    return hotspots.normalise_by_max(t("fx_cells"), "score", ["run_id", "category"]).select("cell_id", F.round("norm", 9).alias("norm"))


# --- sampling and linking ------------------------------------------------------------------

PROBE = f"""WITH {EDGES},
    cand AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, cell_id) AS candidate_index FROM
      (SELECT *, row_number() OVER (PARTITION BY bbox_min_lat, bbox_min_lon, bbox_max_lat, bbox_max_lon ORDER BY score DESC, cell_id) AS rn FROM fx_cells WHERE run_id = 'r2') a WHERE rn = 1) b WHERE candidate_index <= 40),
    b AS (SELECT candidate_index, bbox_min_lat AS s, bbox_min_lon AS w, bbox_max_lat AS n, bbox_max_lon AS e,
        greatest(1, CAST(ceil((bbox_max_lat - bbox_min_lat) / (CAST(60 AS DOUBLE) / CAST(111320 AS DOUBLE))) AS BIGINT)) AS r,
        greatest(1, CAST(ceil((bbox_max_lon - bbox_min_lon) / (CAST(60 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians((bbox_min_lat + bbox_max_lat) / CAST(2 AS DOUBLE)))))) AS BIGINT)) AS c FROM cand),
    rr AS (SELECT b.*, unnest(range(r)) AS i FROM b), cc AS (SELECT rr.*, unnest(range(c)) AS j FROM rr),
    spots AS (SELECT candidate_index, CAST(i * c + j + 1 AS BIGINT) AS ordinal, s + (i + 0.5) * (n - s) / r AS y, w + (j + 0.5) * (e - w) / c AS x FROM cc),
    outer_edges AS (SELECT * FROM edges WHERE ring_index = 0),
    rings AS (SELECT parcel_id, polygon_index, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM outer_edges GROUP BY parcel_id, polygon_index),
    near AS (SELECT p.*, g.parcel_id, g.polygon_index FROM spots p JOIN rings g ON p.x BETWEEN g.w AND g.e AND p.y BETWEEN g.s AND g.n),
    hits AS (SELECT n.candidate_index, n.ordinal, n.parcel_id FROM near n JOIN outer_edges g ON g.parcel_id = n.parcel_id AND g.polygon_index = n.polygon_index
      WHERE (g.lat1 > n.y) <> (g.lat > n.y) AND n.x < (g.lon1 - g.lon) * (n.y - g.lat) / (g.lat1 - g.lat) + g.lon GROUP BY n.candidate_index, n.ordinal, n.parcel_id, n.polygon_index HAVING count(*) % 2 = 1),
    first_hit AS (SELECT candidate_index, ordinal, min(parcel_id) AS parcel_id FROM hits GROUP BY candidate_index, ordinal),
    judged AS (SELECT s.candidate_index, s.ordinal, h.parcel_id,
        CASE WHEN h.parcel_id IS NULL THEN 'uncovered' WHEN coalesce(p.area_m2, 0) < 1000 THEN 'rejected' ELSE 'found' END AS outcome
      FROM spots s LEFT JOIN first_hit h USING (candidate_index, ordinal) LEFT JOIN fx_parcels p ON p.parcel_id = h.parcel_id),
    sam AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'uncovered' THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_index ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS uncovered_before FROM judged)
"""
PROBE_READS = ["fx_points", "fx_cells", "fx_parcels"]


def _samples(t):
    cells = ranking.ranked_candidates(t("fx_cells"), "r2", 40)
    return coverage.judged_samples(cells, "candidate_index", 60.0, t("fx_parcels"), t("fx_points"), gates={"min_area_m2": 1000.0})


@query("judged_samples_with_budget", PROBE_READS, PROBE + """
    SELECT CAST(candidate_index AS INT) AS candidate_index, ordinal, parcel_id, outcome, CAST(uncovered_before AS BIGINT) AS uncovered_before FROM sam WHERE uncovered_before < 300""")
def _(t):
    return coverage.within_budget(_samples(t), 300).select("candidate_index", "ordinal", "parcel_id", "outcome", F.col("uncovered_before").cast("long").alias("uncovered_before"))


@query("coverage_counters", PROBE_READS, PROBE + """
    SELECT CAST(candidate_index AS INT) AS candidate_index, count(*) AS processed_points, count(*) FILTER (WHERE outcome = 'uncovered') AS uncovered,
      count(*) FILTER (WHERE outcome = 'found') + count(DISTINCT CASE WHEN outcome = 'rejected' THEN parcel_id END) AS skipped_existing,
      CAST(0 AS BIGINT) AS out_of_scope, count(DISTINCT CASE WHEN outcome = 'rejected' THEN parcel_id END) AS rejected,
      count(*) FILTER (WHERE outcome = 'rejected') - count(DISTINCT CASE WHEN outcome = 'rejected' THEN parcel_id END) AS skipped_rejected_polygon,
      count(DISTINCT CASE WHEN outcome = 'found' THEN parcel_id END) AS found_parcels
    FROM sam GROUP BY candidate_index""")
def _(t):
    return coverage.coverage_counts(_samples(t), "candidate_index")


@query("rejection_histogram", PROBE_READS, PROBE + """
    SELECT CAST(candidate_index AS INT) AS candidate_index, 'too_small' AS reason, count(DISTINCT parcel_id) AS parcels FROM sam WHERE outcome = 'rejected' GROUP BY candidate_index""")
def _(t):
    return coverage.rejection_histogram(_samples(t), "candidate_index")


@query("uncovered_points", PROBE_READS, PROBE + "SELECT CAST(candidate_index AS INT) AS candidate_index, ordinal FROM sam WHERE outcome = 'uncovered'")
def _(t):
    return coverage.uncovered_points(_samples(t), "candidate_index").select("candidate_index", "ordinal")


PROBE_BOX = BBox(16.0, 50.0, 16.024, 50.018)
_CANDIDATES = PROBE[PROBE.index("cand AS ("):PROBE.index("b AS (SELECT candidate_index")]
PROBE_AREA = PROBE.replace(_CANDIDATES, f"""cand AS (SELECT 0 AS candidate_index, CAST({PROBE_BOX.min_lat} AS DOUBLE) AS bbox_min_lat, CAST({PROBE_BOX.min_lon} AS DOUBLE) AS bbox_min_lon,
      CAST({PROBE_BOX.max_lat} AS DOUBLE) AS bbox_max_lat, CAST({PROBE_BOX.max_lon} AS DOUBLE) AS bbox_max_lon),
    """)


@query("probe_area", ["fx_points", "fx_parcels"], PROBE_AREA + """
    SELECT 'area' AS area_id, count(*) AS processed_points, count(*) FILTER (WHERE outcome = 'uncovered') AS uncovered,
      count(*) FILTER (WHERE outcome = 'found') + count(DISTINCT CASE WHEN outcome = 'rejected' THEN parcel_id END) AS skipped_existing,
      CAST(0 AS BIGINT) AS out_of_scope, count(DISTINCT CASE WHEN outcome = 'rejected' THEN parcel_id END) AS rejected,
      count(*) FILTER (WHERE outcome = 'rejected') - count(DISTINCT CASE WHEN outcome = 'rejected' THEN parcel_id END) AS skipped_rejected_polygon,
      count(DISTINCT CASE WHEN outcome = 'found' THEN parcel_id END) AS found_parcels
    FROM sam WHERE uncovered_before < 500""")
def _(t):
    """One area sampled within a budget of 500 uncovered points."""
    return analyses.probe_area(t.spark, PROBE_BOX, 60.0, t("fx_parcels"), t("fx_points"), 500, gates={"min_area_m2": 1000.0})[1]


LINK = PROBE + """,
    looks AS (SELECT candidate_index, count(*) FILTER (WHERE uncovered_before < 1 AND outcome = 'uncovered') AS u, count(*) FILTER (WHERE uncovered_before < 1 AND outcome = 'found') AS f FROM sam GROUP BY candidate_index),
    st AS (SELECT candidate_index, CASE WHEN u > 0 AND f = 0 THEN 'empty' ELSE 'probed' END AS status FROM looks),
    firsts AS (SELECT parcel_id, min(candidate_index) AS candidate_index FROM sam WHERE outcome = 'found' AND uncovered_before < 200 AND candidate_index IN (SELECT candidate_index FROM st WHERE status = 'probed') GROUP BY parcel_id),
    prog AS (SELECT st.candidate_index, st.status, count(f.parcel_id) AS new_parcels FROM st LEFT JOIN firsts f ON f.candidate_index = st.candidate_index GROUP BY st.candidate_index, st.status),
    run AS (SELECT *, coalesce(sum(new_parcels) OVER (ORDER BY candidate_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_me FROM prog),
    tested AS (SELECT * FROM run WHERE before_me < 90)
"""


def _linked(t):
    return analyses.link_candidates(t("fx_cells"), t("fx_parcels"), t("fx_points"), "r2", 40, 60.0, 200,
                                     gates={"min_area_m2": 1000.0}, target_parcels=90)


@query("linked_parcels", PROBE_READS, LINK + """
    SELECT 'r2' AS run_id, f.parcel_id, CAST(f.candidate_index AS INT) AS candidate_index FROM firsts f JOIN tested t ON t.candidate_index = f.candidate_index""")
def _(t):
    return _linked(t)[0].select("run_id", "parcel_id", "candidate_index")


@query("candidate_rollup", PROBE_READS, LINK + """
    SELECT count(*) AS tested_candidates, count(*) FILTER (WHERE status = 'empty') AS empty_candidates, CAST(0 AS BIGINT) AS out_of_scope_candidates, CAST(sum(new_parcels) AS BIGINT) AS linked_parcels,
      CAST(min(CASE WHEN new_parcels > 0 THEN candidate_index END) AS INT) AS selected_candidate, CASE WHEN sum(new_parcels) > 0 THEN 'ok' ELSE 'no_parcels_found' END AS status FROM tested""")
def _(t):
    return analyses.candidate_rollup(_linked(t)[1])


# --- ranking -------------------------------------------------------------------------------

GATES = ranking.Gates(1500.0, 12000.0, 0.4, 8.0, True, 0.2, 0.25, 0.5, 150.0)
RANK = """WITH
    rows AS (SELECT l.candidate_index, p.*, g.area_m2 AS garea, g.compactness, g.elongation_ratio, v.green_pixel_ratio AS green, v.dark_pixel_ratio AS dark, v.bright_pixel_ratio AS bright, v.low_saturation_ratio AS low_sat, v.brightness_mean
      FROM fx_links l JOIN fx_parcels p ON p.parcel_id = l.parcel_id LEFT JOIN fx_shape g ON g.parcel_id = p.parcel_id LEFT JOIN fx_visual v ON v.parcel_id = p.parcel_id WHERE l.run_id = 'r0'),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY candidate_index DESC) AS rn FROM rows) q WHERE rn = 1),
    s2 AS (SELECT *, coalesce(nullif(garea, 0), nullif(area_m2, 0), 0) AS a FROM one WHERE garea IS NOT NULL),
    s3 AS (SELECT * FROM s2 WHERE a BETWEEN 1500 AND 12000),
    s4 AS (SELECT * FROM s3 WHERE coalesce(compactness, 0) >= CAST(0.4 AS DOUBLE) AND coalesce(elongation_ratio, 0) <= 8),
    s5 AS (SELECT * FROM s4 WHERE green IS NOT NULL),
    s6 AS (SELECT * FROM s5 WHERE green >= CAST(0.2 AS DOUBLE) AND (bright IS NULL OR bright <= CAST(0.25 AS DOUBLE)) AND (low_sat IS NULL OR low_sat <= CAST(0.5 AS DOUBLE)) AND (brightness_mean IS NULL OR brightness_mean <= 150))
"""
RANK_READS = ["fx_links", "fx_parcels", "fx_shape", "fx_visual"]


@query("weighted_ranking", RANK_READS, RANK + """
    SELECT parcel_id, round(score, 4) AS score, round(a, 1) AS area_m2, commune, round(compactness, 4) AS compactness, round(elongation_ratio, 4) AS elongation_ratio, round(green, 4) AS green_pixel_ratio FROM (
      SELECT *, greatest(CAST(0 AS DOUBLE), 1 - abs(a - 5000) / CAST(5000 AS DOUBLE)) * 2 + least(compactness / CAST(0.35 AS DOUBLE), 1)
        + greatest(CAST(0 AS DOUBLE), 1 - abs(elongation_ratio - CAST(2.5 AS DOUBLE)) / 7) * CAST(0.8 AS DOUBLE) + green * CAST(1.4 AS DOUBLE)
        + greatest(CAST(0 AS DOUBLE), 1 - abs(dark - CAST(0.35 AS DOUBLE)) / CAST(0.35 AS DOUBLE)) * CAST(0.6 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - abs(bright - CAST(0.1 AS DOUBLE)) / CAST(0.2 AS DOUBLE)) * CAST(0.4 AS DOUBLE) AS score FROM s6) q
    ORDER BY round(score, 4) DESC, parcel_id LIMIT 50""")
def _(t):
    top, _ = analyses.rank_run(t("fx_links"), t("fx_parcels"), t("fx_shape"), t("fx_visual"), "r0", GATES, Weights(), 50)
    return top.select("parcel_id", "score", "area_m2", "commune", "compactness", "elongation_ratio", "green_pixel_ratio")


@query("ranking_map_links", RANK_READS, """
    SELECT p.parcel_id, 'https://www.google.com/maps/search/?api=1&query=' || printf('%.7f', coalesce(nullif(p.centroid_lat, 0), (p.bbox_min_lat + p.bbox_max_lat) / 2)) || ',' || printf('%.7f', coalesce(nullif(p.centroid_lon, 0), (p.bbox_min_lon + p.bbox_max_lon) / 2)) AS map_link
    FROM fx_parcels p JOIN (SELECT parcel_id, max(candidate_index) AS c FROM fx_links WHERE run_id = 'r1' GROUP BY parcel_id) l ON l.parcel_id = p.parcel_id JOIN fx_shape g ON g.parcel_id = p.parcel_id""")
def _(t):
    top, _ = analyses.rank_run(t("fx_links"), t("fx_parcels"), t("fx_shape"), None, "r1")
    return top.select("parcel_id", "map_link")


@query("ranking_funnel", RANK_READS, RANK + """
    SELECT 0 AS position, 'layer2_parcels' AS step, (SELECT count(*) FROM rows) AS count UNION ALL SELECT 1, 'deduped_parcels', (SELECT count(*) FROM one)
    UNION ALL SELECT 2, 'with_geometry_features', (SELECT count(*) FROM s2) UNION ALL SELECT 3, 'area_1500_12000', (SELECT count(*) FROM s3)
    UNION ALL SELECT 4, 'geometry_shape_filter', (SELECT count(*) FROM s4) UNION ALL SELECT 5, 'with_visual_features', (SELECT count(*) FROM s5)
    UNION ALL SELECT 6, 'visual_land_filter', (SELECT count(*) FROM s6) UNION ALL SELECT 7, 'top_50', least(50, (SELECT count(*) FROM s6))""")
def _(t):
    return analyses.rank_run(t("fx_links"), t("fx_parcels"), t("fx_shape"), t("fx_visual"), "r0", GATES, Weights(), 50)[1]


@query("simple_ranking", ["fx_parcels", "fx_shape"], """
    WITH j AS (SELECT p.parcel_id, p.parcel_number, coalesce(nullif(p.area_m2, 0), g.area_m2, 0) AS a, g.compactness AS c, g.elongation_ratio AS e FROM fx_parcels p LEFT JOIN fx_shape g ON g.parcel_id = p.parcel_id)
    SELECT parcel_id, round(least(a, 10000) / CAST(10000 AS DOUBLE) + coalesce(c, 0) + CASE WHEN coalesce(e, 0) <> 0 THEN greatest(CAST(0 AS DOUBLE), 1 - least(e, 10) / CAST(10 AS DOUBLE)) ELSE 0 END, 6) AS score
    FROM j ORDER BY score DESC, CAST(parcel_number AS BIGINT), parcel_id LIMIT 300""")
def _(t):
    candidates = t("fx_parcels").withColumn("ordinal", F.col("parcel_number").cast("long"))
    return ranking.simple_ranking(candidates, t("fx_shape"), 300).select("parcel_id", "score")


@query("flagship_best_parcels", ["fx_points", "fx_parcels", "fx_links"], MOMENTS + """,
    shape AS (SELECT parcel_id, round(a, 2) AS garea, round(4 * pi() * a / (per * per), 6) AS compactness, round(sqrt(pmax / a) / sqrt(pmin / a), 6) AS elongation FROM p),
    rows AS (SELECT q.parcel_id, q.commune, any_value(s.garea) AS garea, any_value(s.compactness) AS compactness, any_value(s.elongation) AS elongation
      FROM fx_links l JOIN fx_parcels q ON q.parcel_id = l.parcel_id JOIN shape s ON s.parcel_id = q.parcel_id WHERE l.run_id = 'r0' GROUP BY q.parcel_id, q.commune),
    gated AS (SELECT * FROM rows WHERE garea BETWEEN 1500 AND 9000 AND compactness >= CAST(0.5 AS DOUBLE) AND elongation <= 4)
    SELECT parcel_id, commune, round(garea, 1) AS area_m2, round(compactness, 4) AS compactness, round(elongation, 4) AS elongation_ratio,
      round(least(garea, 10000) / CAST(10000 AS DOUBLE) + compactness + greatest(CAST(0 AS DOUBLE), 1 - least(elongation, 10) / CAST(10 AS DOUBLE)), 4) AS score
    FROM gated ORDER BY score DESC, parcel_id LIMIT 20""")
def _(t):
    """Vertices to moments, joined to a run's parcels, gated by shape and ranked."""
    moments = geometry.polygon_moments(t("fx_points")).where("error IS NULL")
    shape = moments.select("parcel_id", F.round("area_m2", 2).alias("area_m2"), F.round("compactness", 6).alias("compactness"),
                           F.round("elongation_ratio", 6).alias("elongation_ratio"))
    in_run = t("fx_links").where("run_id = 'r0'").select("parcel_id").distinct()
    rows = shape.join(in_run, "parcel_id", "left_semi").join(t("fx_parcels").select("parcel_id", "commune"), "parcel_id")
    gated = rows.where(F.col("area_m2").between(1500, 9000) & filters.shape_gate(0.5, 4.0))
    from acremark.functions.scoring import simple_score

    score = F.round(simple_score(F.col("area_m2"), F.col("compactness"), F.col("elongation_ratio")), 4)
    return gated.select(
        "parcel_id", "commune", F.round("area_m2", 1).alias("area_m2"), F.round("compactness", 4).alias("compactness"),
        F.round("elongation_ratio", 4).alias("elongation_ratio"), score.alias("score"),
    ).orderBy(F.desc("score"), "parcel_id").limit(20)
