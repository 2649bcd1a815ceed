"""Parcel geometry: edges, moments, metrics, ring assembly, point in polygon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.functions.geo import METRES_PER_DEGREE, bbox_area_m2, ray_crosses
from acremark.operators.spatial import box_level, grid_levels, points_in_boxes

RING = ["parcel_id", "polygon_index", "ring_index"]
CHUNK = 1024  # vertices of one ring that are handled together
FINER = 4  # fixed value: vertices are dealt to this many times the session's partitions, as each task sorts its own


def _dealt(vertices: DataFrame, *keys: str) -> DataFrame:
    return vertices.repartition(FINER * int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ring_edges(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges of every ring, the last vertex joined to the first, with reference means.

    A closing duplicate only adds an edge of length zero. Rings are cut into chunks of vertices:
    a chunk finds its inner edges with ``lead``, and a directory of one row per chunk supplies the
    first vertex of the next chunk and the mean position of the ring and of the parcel. The vertex
    table is shuffled once, on (ring, chunk), so no ring however long sits in one task.
    """
    part = [*RING, "chunk"]
    vertices = points.select(
        *RING, "point_index", F.col("lon"), F.col("lat"), F.floor(F.col("point_index") / chunk).alias("chunk")
    )
    heads = vertices.groupBy(*part).agg(
        F.min_by("lon", "point_index").alias("head_lon"),
        F.min_by("lat", "point_index").alias("head_lat"),
        F.sum("lon").alias("sum_lon"),
        F.sum("lat").alias("sum_lat"),
        F.count("*").alias("n"),
    )
    ring = Window.partitionBy(*RING).orderBy("chunk")
    whole_ring = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole_parcel = Window.partitionBy("parcel_id")
    # clustered by parcel once; that serves the windows over rings and over the parcel alike
    directory = heads.repartition("parcel_id").select(
        *part,
        F.coalesce(F.lead("head_lon").over(ring), F.first("head_lon").over(whole_ring)).alias("next_lon"),
        F.coalesce(F.lead("head_lat").over(ring), F.first("head_lat").over(whole_ring)).alias("next_lat"),
        (F.sum("sum_lat").over(whole_ring) / F.sum("n").over(whole_ring)).alias("ring_lat"),
        F.sum("n").over(whole_ring).alias("ring_points"),
        (F.sum("sum_lon").over(whole_parcel) / F.sum("n").over(whole_parcel)).alias("ref_lon"),
        (F.sum("sum_lat").over(whole_parcel) / F.sum("n").over(whole_parcel)).alias("ref_lat"),
    )
    # the next vertex comes before the join, so that narrow rows are sorted once, for the window and the join alike
    inner = Window.partitionBy(*part).orderBy("point_index")
    followed = _dealt(vertices, *part).withColumn("_lon", F.lead("lon").over(inner)).withColumn("_lat", F.lead("lat").over(inner))
    return followed.join(directory, part).select(
        *part,
        "point_index",
        "ring_points",
        "ring_lat",
        "ref_lon",
        "ref_lat",
        F.col("lon").alias("lon0"),
        F.col("lat").alias("lat0"),
        F.coalesce("_lon", "next_lon").alias("lon1"),
        F.coalesce("_lat", "next_lat").alias("lat1"),
    )


def polygon_moments(points: DataFrame) -> DataFrame:
    """Area, centroid, second moments and shape figures per parcel; holes are subtracted.

    Parcels without positive area come out with ``error`` set and null figures.
    """
    mpl = F.cos(F.radians(F.col("ref_lat"))) * METRES_PER_DEGREE
    edges = ring_edges(points).select(
        *RING, "ref_lon", "ref_lat", "lon0", "lat0",
        ((F.col("lon0") - F.col("ref_lon")) * mpl).alias("x0"),
        ((F.col("lat0") - F.col("ref_lat")) * METRES_PER_DEGREE).alias("y0"),
        ((F.col("lon1") - F.col("ref_lon")) * mpl).alias("x1"),
        ((F.col("lat1") - F.col("ref_lat")) * METRES_PER_DEGREE).alias("y1"),
    )
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    cross = x0 * y1 - x1 * y0
    rings = edges.groupBy(*RING).agg(
        (F.sum(cross) / 2.0).alias("raw_area"),
        (F.sum((x0 + x1) * cross) / 6.0).alias("sx"),
        (F.sum((y0 + y1) * cross) / 6.0).alias("sy"),
        (F.sum((y0 * y0 + y0 * y1 + y1 * y1) * cross) / 12.0).alias("ixx"),
        (F.sum((x0 * x0 + x0 * x1 + x1 * x1) * cross) / 12.0).alias("iyy"),
        (F.sum((x0 * y0 * 2.0 + x0 * y1 + x1 * y0 + x1 * y1 * 2.0) * cross) / 24.0).alias("ixy"),
        F.sum(F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))).alias("perimeter"),
        F.min("lat0").alias("min_lat"),
        F.min("lon0").alias("min_lon"),
        F.max("lat0").alias("max_lat"),
        F.max("lon0").alias("max_lon"),
        F.first("ref_lon").alias("ref_lon"),
        F.first("ref_lat").alias("ref_lat"),
    )
    # the outer ring counts positive and holes negative, whichever way they were drawn
    wanted = F.when(F.col("ring_index") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    sign = F.signum("raw_area") * wanted
    parcels = rings.groupBy("parcel_id").agg(
        F.sum(F.col("raw_area") * sign).alias("area_m2"),
        *[F.sum(F.col(c) * sign).alias(c) for c in ("sx", "sy", "ixx", "iyy", "ixy")],
        F.sum("perimeter").alias("perimeter_m"),
        F.min("min_lat").alias("bbox_min_lat"),
        F.min("min_lon").alias("bbox_min_lon"),
        F.max("max_lat").alias("bbox_max_lat"),
        F.max("max_lon").alias("bbox_max_lon"),
        F.first("ref_lon").alias("ref_lon"),
        F.first("ref_lat").alias("ref_lat"),
        F.count("*").alias("ring_count"),
        F.countDistinct("polygon_index").alias("polygon_count"),
    )
    good = parcels.withColumn("ok", F.col("area_m2") > 0)
    # past this point a figure of a parcel without area is null
    area = F.when(F.col("ok"), F.col("area_m2"))
    cx, cy = F.col("sx") / area, F.col("sy") / area
    centred = good.select(
        "*",
        cx.alias("cx"),
        cy.alias("cy"),
        (F.col("ixx") - area * cy * cy).alias("cxx"),
        (F.col("iyy") - area * cx * cx).alias("cyy"),
        (F.col("ixy") - area * cx * cy).alias("cxy"),
    )
    trace = F.col("cxx") + F.col("cyy")
    half = (F.col("cxx") - F.col("cyy")) / 2.0
    root = F.sqrt(half * half + F.col("cxy") * F.col("cxy"))
    zero = F.lit(0.0)
    principal = centred.select(
        "*",
        F.greatest(zero, trace / 2.0 - root).alias("pmin"),
        F.greatest(zero, trace / 2.0 + root).alias("pmax"),
        F.when(trace != 0, F.degrees(F.atan2(F.col("cxy") * -2.0, F.col("cxx") - F.col("cyy"))) * 0.5)
        .otherwise(zero)
        .alias("angle"),
    )
    rg_min, rg_max = F.sqrt(F.col("pmin") / F.col("area_m2")), F.sqrt(F.col("pmax") / F.col("area_m2"))
    ok = F.col("ok")

    def if_ok(value: Column, name: str) -> Column:
        return F.when(ok, value).alias(name)

    scale = F.cos(F.radians(F.col("ref_lat"))) * METRES_PER_DEGREE
    perimeter = F.col("perimeter_m")
    return principal.select(
        "parcel_id",
        if_ok(F.col("area_m2"), "area_m2"),
        if_ok(F.col("ref_lat") + F.col("cy") / METRES_PER_DEGREE, "centroid_lat"),
        if_ok(F.col("ref_lon") + F.col("cx") / scale, "centroid_lon"),
        "perimeter_m",
        "bbox_min_lat", "bbox_min_lon", "bbox_max_lat", "bbox_max_lon",
        if_ok(F.col("ixx"), "moment_ixx_m4"),
        if_ok(F.col("iyy"), "moment_iyy_m4"),
        if_ok(F.col("ixy"), "moment_ixy_m4"),
        F.col("cxx").alias("centroidal_ixx_m4"),
        F.col("cyy").alias("centroidal_iyy_m4"),
        F.col("cxy").alias("centroidal_ixy_m4"),
        trace.alias("polar_moment_m4"),
        if_ok(F.col("pmin"), "principal_moment_min_m4"),
        if_ok(F.col("pmax"), "principal_moment_max_m4"),
        if_ok(F.col("angle"), "principal_axis_angle_deg"),
        if_ok(rg_min, "radius_gyration_min_m"),
        if_ok(rg_max, "radius_gyration_max_m"),
        if_ok(F.when(rg_min > 0, rg_max / rg_min).otherwise(zero), "elongation_ratio"),
        if_ok(F.when(perimeter > 0, F.col("area_m2") * (4.0 * math.pi) / (perimeter * perimeter)).otherwise(zero),
              "compactness"),
        F.col("ref_lon").alias("reference_lon"),
        F.col("ref_lat").alias("reference_lat"),
        "ring_count",
        "polygon_count",
        F.when(~ok, F.lit("non-positive polygon area")).alias("error"),
    )


def polygon_metrics(parcels: DataFrame, points: DataFrame) -> DataFrame:
    """Area, perimeter, compactness and box elongation of each parcel's first outer ring.

    Fewer than three vertices give zeros; no vertices give the parcel's own area and nulls.
    """
    outer = points.where("polygon_index = 0 AND ring_index = 0")
    mpl = F.cos(F.radians(F.col("ring_lat"))) * METRES_PER_DEGREE
    edges = ring_edges(outer).select(
        "parcel_id", "ring_points",
        *[((F.col(c) - F.col(o)) * m).alias(n) for n, c, o, m in (
            ("x0", "lon0", "ref_lon", mpl), ("y0", "lat0", "ref_lat", METRES_PER_DEGREE),
            ("x1", "lon1", "ref_lon", mpl), ("y1", "lat1", "ref_lat", METRES_PER_DEGREE))],
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    figures = edges.groupBy("parcel_id").agg(
        (F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))) / 2.0).alias("area"),
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter"),
        (F.max("x0") - F.min("x0")).alias("width"),
        (F.max("y0") - F.min("y0")).alias("height"),
        F.max("ring_points").alias("n"),
    )
    enough = F.col("n") >= 3
    zero = F.lit(0.0)
    small = F.greatest(F.lit(1e-9), F.least("width", "height"))
    shaped = figures.select(
        "parcel_id",
        F.when(enough, F.col("area")).otherwise(zero).alias("ring_area"),
        F.when(enough, F.col("perimeter")).otherwise(zero).alias("perimeter_m"),
        F.when(enough & (F.col("perimeter") > 0),
               F.col("area") * (4 * math.pi) / (F.col("perimeter") * F.col("perimeter")))
        .otherwise(zero).alias("compactness"),
        F.when(enough, F.greatest("width", "height") / small).otherwise(zero).alias("elongation_ratio"),
    )
    return parcels.select("parcel_id", "area_m2", "centroid_lat", "centroid_lon").join(
        shaped, "parcel_id", "left"
    ).select(
        "parcel_id",
        F.coalesce("ring_area", "area_m2", zero).alias("area_m2"),
        "perimeter_m", "compactness", "elongation_ratio", "centroid_lat", "centroid_lon",
    )


def ingest_stats(points: DataFrame) -> DataFrame:
    """What is known of a parcel on arrival: outer-ring area (holes kept), vertex mean, box, digest."""
    # the area does not depend on the origin; a near one keeps the digits
    x0, y0, x1, y1 = (F.col(c) - F.col(o) for c, o in (("lon0", "ref_lon"), ("lat0", "ref_lat"), ("lon1", "ref_lon"), ("lat1", "ref_lat")))
    cross = x0 * y1 - x1 * y0
    outer_cross = F.when((F.col("ring_index") == 0) & (F.col("ring_points") >= 3), cross).otherwise(F.lit(0.0))
    rings = ring_edges(points).groupBy(*RING).agg(
        F.sum(outer_cross).alias("cross"),
        F.first("ring_lat").alias("ring_lat"),
        F.first("ref_lon").alias("ref_lon"),
        F.first("ref_lat").alias("ref_lat"),
        F.min("lat0").alias("min_lat"), F.min("lon0").alias("min_lon"),
        F.max("lat0").alias("max_lat"), F.max("lon0").alias("max_lon"),
    )
    metres2 = F.cos(F.radians(F.col("ring_lat"))) * (METRES_PER_DEGREE * METRES_PER_DEGREE)
    stats = rings.groupBy("parcel_id").agg(
        F.sum(F.abs(F.col("cross")) / 2.0 * metres2).alias("area_m2"),
        F.first("ref_lat").alias("centroid_lat"),
        F.first("ref_lon").alias("centroid_lon"),
        F.min("min_lat").alias("bbox_min_lat"), F.min("min_lon").alias("bbox_min_lon"),
        F.max("max_lat").alias("bbox_max_lat"), F.max("max_lon").alias("bbox_max_lon"),
    )
    return stats.join(geometry_hash(points), "parcel_id")


def geometry_hash(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SHA-256 per parcel over chunk digests in order; equal geometry gives an equal digest."""
    spot = F.struct("point_index", "lon", "lat")
    chunks = (
        _dealt(points.select(*RING, "point_index", "lon", "lat", F.floor(F.col("point_index") / chunk).alias("chunk")), *RING, "chunk")
        .groupBy(*RING, "chunk")
        .agg(F.sha2(F.to_json(F.sort_array(F.collect_list(spot))), 256).alias("digest"))
    )
    piece = F.struct("polygon_index", "ring_index", "chunk", "digest")
    return chunks.groupBy("parcel_id").agg(
        F.sha2(F.to_json(F.sort_array(F.collect_list(piece))), 256).alias("geometry_hash")
    )


def nested_geometry(points: DataFrame, min_points: int = 1, lat_first: bool = False,
                    digits: int | None = None) -> DataFrame:
    """Polygons as nested arrays, polygon > ring > [x, y], in index order; one row per parcel.

    Rings with fewer than ``min_points`` vertices are left out.
    """
    lon, lat = F.col("lon"), F.col("lat")
    if digits is not None:
        lon, lat = F.round(lon, digits), F.round(lat, digits)
    pair = F.array(lat, lon) if lat_first else F.array(lon, lat)
    rings = points.groupBy(*RING).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("point_index", pair.alias("p")))), lambda s: s["p"]
        ).alias("ring")
    )
    indexed = F.struct("ring_index", "ring")
    polygons = rings.groupBy("parcel_id", "polygon_index").agg(
        F.transform(
            F.filter(F.sort_array(F.collect_list(indexed)), lambda s: F.size(s["ring"]) >= min_points),
            lambda s: s["ring"],
        ).alias("rings")
    )
    return polygons.groupBy("parcel_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("polygon_index", "rings"))), lambda s: s["rings"]
        ).alias("polygons")
    )


def geojson_geometry(polygons: Column) -> Column:
    """GeoJSON text: Polygon for one polygon, else MultiPolygon."""
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), polygons[0].alias("coordinates")))
    several = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")))
    return F.when(F.size(polygons) == 1, single).otherwise(several)


# --- Point in polygon ---------------------------------------------------------------------


def ring_pieces(points: DataFrame, outer_only: bool = True) -> DataFrame:
    """Rings as pieces of at most CHUNK edges, each with the box of points whose ray can meet it."""
    kept = points.where("ring_index = 0") if outer_only else points
    edges = ring_edges(kept)
    pieces = edges.groupBy(*RING, "chunk").agg(
        F.collect_list(F.struct("lon0", "lat0", "lon1", "lat1")).alias("edges"),
        F.min(F.least("lat0", "lat1")).alias("piece_min_lat"),
        F.max(F.greatest("lat0", "lat1")).alias("piece_max_lat"),
        F.min(F.least("lon0", "lon1")).alias("own_min_lon"),
        F.max(F.greatest("lon0", "lon1")).alias("piece_max_lon"),
    )
    # a ray runs east, so a piece also concerns points west of it, back to the edge of its ring;
    # pieces stand on the grid of their ring
    ring = Window.partitionBy(*RING)
    bounds = [f(c).over(ring).alias(n) for f, c, n in (
        (F.min, "own_min_lon", "piece_min_lon"), (F.max, "piece_max_lon", "_e"), (F.min, "piece_min_lat", "_s"), (F.max, "piece_max_lat", "_n"))]
    placed = pieces.select("*", *bounds)
    return placed.withColumn("_level", box_level("piece_min_lon", "_s", "_e", "_n")).drop("own_min_lon", "_e", "_s", "_n")


def ring_levels(points: DataFrame) -> Column:
    """Grids that the rings stand on, from one light aggregation of the vertices."""
    boxes = points.groupBy(*RING).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return grid_levels(boxes.select(box_level("w", "s", "e", "n").alias("_level")))


def points_in_polygons(points: DataFrame, vertices: DataFrame, point_key: list[str], lon: str = "lon",
                       lat: str = "lat") -> DataFrame:
    """(point, parcel) pairs with the point inside an outer ring, even-odd and half-open.

    Holes are ignored. Crossings are counted per piece and added up, so a long ring is shared out.
    """
    outer, spots = vertices.where("ring_index = 0"), points.select(*point_key, lon, lat)
    box, ring = ("_w", "_s", "_e", "_n"), ["hit_parcel_id", *RING[1:]]
    boxes = outer.groupBy(*RING).agg(*[f(c).alias(n) for f, c, n in zip((F.min, F.min, F.max, F.max), ("lon", "lat", "lon", "lat"), box)])
    west, south, east, north = (spots.agg(f(c)).scalar() for f, c in ((F.min, lon), (F.min, lat), (F.max, lon), (F.max, lat)))
    boxes = boxes.where((F.col("_e") >= west) & (F.col("_w") <= east) & (F.col("_n") >= south) & (F.col("_s") <= north))
    # points meet the boxes of rings first: only rings that have points in their box send their edges, once each
    near = points_in_boxes(spots, boxes.withColumnRenamed("parcel_id", "hit_parcel_id"), lon, lat, box, levels=ring_levels(outer)).drop(*box)
    hit = outer.join(near.select(*ring).distinct().withColumnRenamed("hit_parcel_id", "parcel_id"), RING, "left_semi")
    pieces = ring_pieces(hit).drop("_level").withColumnRenamed("parcel_id", "hit_parcel_id")
    reached = F.col(lat).between(F.col("piece_min_lat"), F.col("piece_max_lat")) & (F.col(lon) <= F.col("piece_max_lon"))
    pairs = near.join(pieces, ring).where(reached)
    crossings = F.size(
        F.filter("edges", lambda e: ray_crosses(F.col(lon), F.col(lat), e["lon0"], e["lat0"], e["lon1"], e["lat1"]))
    )
    per_ring = pairs.groupBy(*point_key, "hit_parcel_id", "polygon_index").agg(F.sum(crossings).alias("crossings"))
    return per_ring.where("crossings % 2 = 1").select(*point_key, F.col("hit_parcel_id").alias("parcel_id")).distinct()


def first_parcel_at(points: DataFrame, vertices: DataFrame, point_key: list[str], lon: str = "lon",
                    lat: str = "lat") -> DataFrame:
    """Each point with the smallest parcel id that contains it, null where none does."""
    hits = points_in_polygons(points, vertices, point_key, lon, lat)
    return points.join(hits.groupBy(*point_key).agg(F.min("parcel_id").alias("parcel_id")), point_key, "left")


def box_area(prefix: str = "bbox_") -> Column:
    return bbox_area_m2(*[F.col(prefix + c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")])
