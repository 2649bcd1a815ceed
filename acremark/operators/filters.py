"""Filters and predicates of the parcel pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.functions.geo import METRES_PER_DEGREE, box_shape, in_bbox
from acremark.functions.text import nonzero

BOUNDS = ("bbox_min_lat", "bbox_min_lon", "bbox_max_lat", "bbox_max_lon")

# Which mapped ways count as easy trails.
TRAIL_HIGHWAYS = ["path", "footway", "track", "pedestrian"]
EASY_SAC_SCALES = ["hiking", "T1"]

TYPES_SCHEMA = "tag_key string, tag_value string, category string"


def overlaps_bbox(box: BBox, bounds: tuple[str, str, str, str] = BOUNDS) -> Column:
    """Box against box, touching counts."""
    south, west, north, east = (F.col(c) for c in bounds)
    return (north >= box.min_lat) & (south <= box.max_lat) & (east >= box.min_lon) & (west <= box.max_lon)


def feature_overlaps_bbox(box: BBox) -> Column:
    """As ``overlaps_bbox``; a feature with any bound missing is judged by its centre."""
    known = F.col(BOUNDS[0]).isNotNull()
    for bound in BOUNDS[1:]:
        known = known & F.col(bound).isNotNull()
    return F.when(known, overlaps_bbox(box)).otherwise(
        F.coalesce(in_bbox(F.col("center_lat"), F.col("center_lon"), box), F.lit(False))
    )


def in_bbox_counts(points: DataFrame, box: BBox, lat: str, lon: str, keys: list[str]) -> DataFrame:
    inside = in_bbox(F.col(lat), F.col(lon), box)
    return points.groupBy(*keys).agg(
        F.count_if(inside).alias("inside"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside")
    )


def types_frame(spark, types: list[tuple[str, str]]) -> DataFrame:
    """The wanted (key, value) pairs, a short list the caller wrote down."""
    return spark.createDataFrame([(k, v, f"{k}_{v}") for k, v in types], TYPES_SCHEMA)


def _wanted(types: list[tuple[str, str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(k).alias("tag_key"), F.lit(v).alias("tag_value"), F.lit(f"{k}_{v}").alias("category"))
        for k, v in types
    ])


def tag_map(tags_json: Column) -> Column:
    return F.from_json(tags_json, "map<string,string>")


def match_tags(features: DataFrame, types: list[tuple[str, str]], tags_json: str = "tags_json") -> DataFrame:
    """One row per (feature, matching type), with the category; features without a centre are out.

    The types are literals inside the row expression, so the match is a narrow step.
    """
    located = features.where(F.col("center_lat").isNotNull() & F.col("center_lon").isNotNull())
    parsed = located.withColumn("_tags", tag_map(F.col(tags_json)))
    hit = F.explode(F.filter(_wanted(types), lambda t: F.element_at("_tags", t["tag_key"]) == t["tag_value"]))
    own = {"tag_key", "tag_value", "category", "name"}
    keep = [c for c in features.columns if c not in own]
    return (
        parsed.withColumn("_hit", hit)
        .select(*keep, F.coalesce(F.element_at("_tags", F.lit("name")), F.lit("")).alias("name"),
                "_hit.tag_key", "_hit.tag_value", "_hit.category")
    )


def has_any_tag(tags_json: Column, types: list[tuple[str, str]]) -> Column:
    """Any of the types; no types means everything; unreadable tags match nothing."""
    if not types:
        return F.lit(True)
    tags = tag_map(tags_json)
    return F.coalesce(
        F.exists(_wanted(types), lambda t: F.coalesce(F.element_at(tags, t["tag_key"]) == t["tag_value"], F.lit(False))),
        F.lit(False),
    )


def area_between(area: Column, low: float | None, high: float | None) -> Column:
    """Range with floors at zero and swapped ends put right; a missing area fails once a bound is set."""
    low = None if low is None else max(0.0, low)
    high = None if high is None else max(0.0, high)
    if low is not None and high is not None and low > high:
        low, high = high, low
    test = F.lit(True)
    if low is not None:
        test = test & (area >= low)
    if high is not None:
        test = test & (area <= high)
    return test


def not_in_categories(category: Column, excluded: list[str]) -> Column:
    return ~category.isin(list(excluded)) if excluded else F.lit(True)


def commune_is(commune: Column, expected: str | None, strict: bool = True) -> Column:
    return commune == expected if expected and strict else F.lit(True)


def rejection_reason(min_area_m2: float = 0.0, max_area_m2: float = 0.0, max_box_area_m2: float = 0.0,
                     max_aspect_ratio: float = 0.0, area: str = "area_m2") -> Column:
    """Name of the first gate a parcel fails, null if none. A gate set to zero is off."""
    size = F.coalesce(F.col(area), F.lit(0.0))
    shape = box_shape(*[F.col(b) for b in BOUNDS])
    reason = F.when(F.lit(False), F.lit(""))
    if min_area_m2:
        reason = reason.when(size < min_area_m2, F.lit("too_small"))
    if max_area_m2:
        reason = reason.when(size > max_area_m2, F.lit("too_large"))
    if max_box_area_m2:
        reason = reason.when(shape["area_m2"] > max_box_area_m2, F.lit("bbox_too_large"))
    if max_aspect_ratio:
        reason = reason.when(shape["aspect_ratio"] > max_aspect_ratio, F.lit("bbox_too_elongated"))
    return reason


def ranking_area() -> Column:
    """Geometry area, else parcel area, else zero; zero counts as missing."""
    return F.coalesce(nonzero(F.col("geometry_area_m2")), nonzero(F.col("parcel_area_m2")), F.lit(0.0))


def shape_gate(min_compactness: float = 0.0, max_elongation: float = 0.0) -> Column:
    test = F.lit(True)
    if min_compactness:
        test = test & (F.coalesce("compactness", F.lit(0.0)) >= min_compactness)
    if max_elongation:
        test = test & (F.coalesce("elongation_ratio", F.lit(0.0)) <= max_elongation)
    return test


def visual_gate(min_green: float = 0.0, max_bright: float = 0.0, max_low_saturation: float = 0.0,
                max_brightness: float = 0.0) -> Column:
    """Green is required when its gate is on; the other gates let missing figures pass."""
    test = F.lit(True)
    if min_green:
        test = test & (F.coalesce("green_pixel_ratio", F.lit(0.0)) >= min_green)
    for name, limit in (
        ("bright_pixel_ratio", max_bright),
        ("low_saturation_ratio", max_low_saturation),
        ("brightness_mean", max_brightness),
    ):
        if limit:
            test = test & (F.col(name).isNull() | (F.col(name) <= limit))
    return test


def fully_located(parcels: DataFrame) -> DataFrame:
    return parcels.dropna(subset=["centroid_lat", "centroid_lon", *BOUNDS])


def easy_trails(ways: DataFrame) -> DataFrame:
    """Easy trail ways: (way_id, name, geometry) from (id, tags map, geometry array of lat/lon)."""
    tags = F.col("tags")

    def tag(name: str) -> Column:
        return F.nullif(F.element_at(tags, F.lit(name)), F.lit(""))

    easy = tag("sac_scale").isNull() | tag("sac_scale").isin(EASY_SAC_SCALES)
    trail = F.coalesce(tag("highway").isin(TRAIL_HIGHWAYS), F.lit(False)) | F.coalesce(
        tag("route") == "hiking", F.lit(False)
    )
    label = F.concat(F.lit("way/"), F.col("id").cast("string"))
    return ways.where(trail & easy & (F.size("geometry") >= 2)).select(
        F.col("id").alias("way_id"),
        F.coalesce(tag("name"), tag("ref"), tag("osmc:symbol"), label).alias("name"),
        F.transform(
            "geometry", lambda p: F.struct(F.round(p["lat"], 6).alias("lat"), F.round(p["lon"], 6).alias("lon"))
        ).alias("geometry"),
    )


def inside_margin(lat: Column, lon: Column, box: BBox, margin_km: float) -> Column:
    if margin_km <= 0:
        return F.lit(True)
    d_lat = margin_km * 1000.0 / METRES_PER_DEGREE
    d_lon = F.lit(margin_km * 1000.0) / (F.greatest(F.lit(0.2), F.cos(F.radians(lat))) * METRES_PER_DEGREE)
    return lat.between(box.min_lat + d_lat, box.max_lat - d_lat) & lon.between(
        F.lit(box.min_lon) + d_lon, F.lit(box.max_lon) - d_lon
    )


def selected_only(frame: DataFrame, selected: DataFrame | None, key: str = "parcel_id") -> DataFrame:
    """Rows whose key is in the selection; an empty or absent selection lets all pass."""
    if selected is None:
        return frame
    ids = selected.select(key).distinct()
    none_selected = ids.agg((F.count("*") == 0).alias("none")).scalar()
    marked = frame.join(ids.withColumn("_selected", F.lit(True)), key, "left")
    return marked.where(F.col("_selected") | none_selected).select(*frame.columns)
