"""Landed map-service responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acremark.functions.text import canonical_map_json, content_hash, repair_mojibake, repair_tags

POINT = "struct<lat:double,lon:double>"
RESPONSE = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,"
    f"center:{POINT},bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>,"
    f"geometry:array<{POINT}>,nodes:array<bigint>,"
    "members:array<struct<type:string,ref:bigint,role:string>>,tags:map<string,string>>>"
)


def scan_osm_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of the landed responses (``{"elements": [...]}``, one response a file)."""
    return spark.read.schema(RESPONSE).json(path, multiLine=True).select(F.inline("elements"))


def _both(lat: Column, lon: Column, value: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), value)


def _bounds_known() -> Column:
    known = F.col("bounds.minlat").isNotNull()
    for part in ("minlon", "maxlat", "maxlon"):
        known = known & F.col(f"bounds.{part}").isNotNull()
    return known


def normalize_elements(elements: DataFrame, geometry_fallback: bool = True, keep_anonymous: bool = False) -> DataFrame:
    """Elements as map features: centre, box, repaired tags, geometry text and digest.

    The centre is the element's own position, else ``center``, else the middle of ``bounds``, else
    (``geometry_fallback``) the mean of its geometry. Elements without type or id are dropped, or
    kept as ("unknown", 0) with ``keep_anonymous``.
    """
    lats = F.filter(F.transform("geometry", lambda p: p["lat"]), lambda v: v.isNotNull())
    lons = F.filter(F.transform("geometry", lambda p: p["lon"]), lambda v: v.isNotNull())
    drawn = (F.coalesce(F.size(lats), F.lit(0)) > 0) & (F.coalesce(F.size(lons), F.lit(0)) > 0)

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)

    own, centre = (F.col("lat"), F.col("lon")), (F.col("center.lat"), F.col("center.lon"))
    mid = {"lat": (F.col("bounds.minlat") + F.col("bounds.maxlat")) / 2.0,
           "lon": (F.col("bounds.minlon") + F.col("bounds.maxlon")) / 2.0}

    def centre_of(axis: str, i: int, values: Column) -> Column:
        options = [_both(*own, own[i]), _both(*centre, centre[i]), F.when(_bounds_known(), mid[axis])]
        if geometry_fallback:
            options.append(F.when(drawn, mean(values)))
        return F.coalesce(*options)

    def bound(part: str, pick, values: Column, centre_name: str) -> Column:
        options = [F.when(_bounds_known(), F.col(f"bounds.{part}"))]
        if geometry_fallback:
            options.append(F.when(drawn, pick(values)))
        options.append(_both(F.col("center_lat"), F.col("center_lon"), F.col(centre_name)))
        return F.coalesce(*options)

    if keep_anonymous:
        named = elements.withColumn("type", F.coalesce("type", F.lit("unknown"))).withColumn("id", F.coalesce("id", F.lit(0)))
    else:
        named = elements.where((F.coalesce("type", F.lit("")) != "") & F.col("id").isNotNull())
    located = named.withColumn("center_lat", centre_of("lat", 0, lats)).withColumn("center_lon", centre_of("lon", 1, lons))
    has_shape = F.lit(False)
    for part in ("geometry", "center", "bounds", "nodes", "members"):
        has_shape = has_shape | F.col(part).isNotNull()
    # fields in name order, absent ones left out
    shape = F.when(has_shape, F.to_json(F.struct("bounds", "center", "geometry", "members", "nodes")))
    tags = F.coalesce(repair_tags(F.col("tags")), F.create_map().cast("map<string,string>"))
    return located.select(
        F.col("type").alias("osm_type"),
        F.col("id").alias("osm_id"),
        canonical_map_json(tags).alias("tags_json"),
        shape.alias("geometry_json"),
        "center_lat", "center_lon",
        bound("minlat", F.array_min, lats, "center_lat").alias("bbox_min_lat"),
        bound("minlon", F.array_min, lons, "center_lon").alias("bbox_min_lon"),
        bound("maxlat", F.array_max, lats, "center_lat").alias("bbox_max_lat"),
        bound("maxlon", F.array_max, lons, "center_lon").alias("bbox_max_lon"),
        content_hash(shape).alias("geometry_hash"),
        F.to_json(F.struct(*elements.columns)).alias("raw_json"),
    )


def preview_elements(elements: DataFrame) -> DataFrame:
    """Type, id, position (own or centre), name and tags, repaired."""
    tags = F.coalesce(repair_tags(F.col("tags")), F.create_map().cast("map<string,string>"))
    return elements.select(
        F.coalesce("type", F.lit("")).alias("type"), "id",
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"),
        repair_mojibake(F.coalesce(F.element_at(tags, F.lit("name")), F.lit(""))).alias("name"),
        tags.alias("tags"),
    )
