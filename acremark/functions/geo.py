"""Geometry as Column expressions over doubles; nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acremark.bbox import BBox

# Metres per degree, mean Earth radius, Web-Mercator latitude limit.
METRES_PER_DEGREE = 111_320.0
EARTH_RADIUS_M = 6_371_000.0
MERCATOR_MAX_LAT = 85.05112878

# GRS80 ellipsoid and the EPSG:2180 projection.
GRS80_A = 6378137.0
GRS80_INV_F = 298.257222101
TM_LON0_DEG = 19.0
TM_K0 = 0.9993
TM_FALSE_NORTHING = -5300000.0
TM_FALSE_EASTING = 500000.0


def num(value) -> Column:
    """A Column, or a literal that is certainly a DOUBLE."""
    return value if isinstance(value, Column) else F.lit(float(value))


def metres_per_lon_degree(lat, floor: float = 1e-6) -> Column:
    return F.greatest(F.lit(METRES_PER_DEGREE) * F.cos(F.radians(num(lat))), F.lit(floor))


def bbox_area_m2(min_lat, min_lon, max_lat, max_lon) -> Column:
    south, west, north, east = map(num, (min_lat, min_lon, max_lat, max_lon))
    width = (east - west) * metres_per_lon_degree((south + north) / 2.0)
    height = (north - south) * METRES_PER_DEGREE
    return F.greatest(width * height, F.lit(0.0))


def planar_distance_m(lat1, lon1, lat2, lon2, mid_lat) -> Column:
    dx = (num(lon2) - num(lon1)) * metres_per_lon_degree(mid_lat)
    dy = (num(lat2) - num(lat1)) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def overlap_area_m2(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area shared by two boxes given as dicts of the four bound columns."""
    south = F.greatest(a["min_lat"], b["min_lat"])
    west = F.greatest(a["min_lon"], b["min_lon"])
    north = F.least(a["max_lat"], b["max_lat"])
    east = F.least(a["max_lon"], b["max_lon"])
    apart = (south >= north) | (west >= east)
    return F.when(apart, F.lit(0.0)).otherwise(bbox_area_m2(south, west, north, east))


def overlap_ratio(overlap: Column, area_a: Column, area_b: Column) -> Column:
    smaller = F.least(area_a, area_b)
    return F.when(smaller > 0, overlap / smaller).otherwise(F.lit(0.0))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(num(lat1)), F.radians(num(lat2))
    half_phi = F.radians(num(lat2) - num(lat1)) / 2
    half_lam = F.radians(num(lon2) - num(lon1)) / 2
    h = F.sin(half_phi) * F.sin(half_phi) + F.cos(p1) * F.cos(p2) * F.sin(half_lam) * F.sin(half_lam)
    return F.asin(F.sqrt(h)) * (2 * EARTH_RADIUS_M)


def margin_degrees(margin_m: float, lat) -> tuple[Column, Column]:
    """Metres as (longitude degrees, latitude degrees)."""
    return num(margin_m) / metres_per_lon_degree(lat, floor=1.0), num(margin_m) / METRES_PER_DEGREE


def square_box(lat: Column, lon: Column, size_km: float) -> Column:
    """Struct of four bounds of a square of ``size_km`` around a centre, 7 decimals."""
    half_m = size_km * 500.0
    d_lat = F.lit(half_m / METRES_PER_DEGREE)
    d_lon = F.lit(half_m) / (F.greatest(F.lit(0.2), F.cos(F.radians(lat))) * METRES_PER_DEGREE)
    return F.struct(
        F.round(lat - d_lat, 7).alias("min_lat"),
        F.round(lon - d_lon, 7).alias("min_lon"),
        F.round(lat + d_lat, 7).alias("max_lat"),
        F.round(lon + d_lon, 7).alias("max_lon"),
    )


def box_shape(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """Struct width_m, height_m, area_m2, aspect_ratio of a box."""
    # no floor on the longitude scale here, only on the shortest side
    width = F.abs((max_lon - min_lon) * METRES_PER_DEGREE * F.cos(F.radians((min_lat + max_lat) / 2.0)))
    height = F.abs((max_lat - min_lat) * METRES_PER_DEGREE)
    aspect = F.greatest(width, height) / F.greatest(F.lit(0.001), F.least(width, height))
    return F.struct(
        width.alias("width_m"),
        height.alias("height_m"),
        (width * height).alias("area_m2"),
        aspect.alias("aspect_ratio"),
    )


# --- Coordinate systems -------------------------------------------------------------------

_F = 1.0 / GRS80_INV_F
_E2 = 2.0 * _F - _F * _F
_EP2 = _E2 / (1.0 - _E2)


def _poly(x: Column, coefficients: list) -> Column:
    """Horner form of c0 + c1 x + c2 x^2 + ..."""
    total = num(coefficients[-1])
    for coefficient in reversed(coefficients[:-1]):
        total = total * x + num(coefficient)
    return total


def _sine_series(angle: Column, coefficients: list[float]) -> Column:
    """c1 sin(2a) + c2 sin(4a) + ..."""
    terms = [F.sin(angle * (2.0 * k)) * c for k, c in enumerate(coefficients, start=1)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


_MERIDIAN_SCALE = 1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256
_MERIDIAN_SINES = [
    -(3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024),
    15 * _E2**2 / 256 + 45 * _E2**3 / 1024,
    -(35 * _E2**3 / 3072),
]
_E1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
_FOOTPOINT_SINES = [
    3 * _E1 / 2 - 27 * _E1**3 / 32,
    21 * _E1**2 / 16 - 55 * _E1**4 / 32,
    151 * _E1**3 / 96,
    1097 * _E1**4 / 512,
]


def to_epsg2180(lon, lat) -> Column:
    """Struct (x = northing, y = easting): transverse Mercator series on GRS80."""
    phi = F.radians(num(lat))
    t = F.tan(phi) * F.tan(phi)
    c = F.cos(phi) * F.cos(phi) * _EP2
    prime_vertical = F.lit(GRS80_A) / F.sqrt(F.lit(1.0) - F.sin(phi) * F.sin(phi) * _E2)
    a = (F.radians(num(lon)) - math.radians(TM_LON0_DEG)) * F.cos(phi)
    a2 = a * a
    meridian = (phi * _MERIDIAN_SCALE + _sine_series(phi, _MERIDIAN_SINES)) * GRS80_A
    north = _poly(
        a2,
        [
            0.0,
            0.5,
            _poly(c, [5.0 - t, 9.0, 4.0]) / 24.0,
            (_poly(t, [61.0 - 330.0 * _EP2, -58.0, 1.0]) + c * 600.0) / 720.0,
        ],
    )
    east = a * _poly(
        a2,
        [1.0, (c - t + 1.0) / 6.0, (_poly(t, [5.0 - 58.0 * _EP2, -18.0, 1.0]) + c * 72.0) / 120.0],
    )
    return F.struct(
        ((meridian + prime_vertical * F.tan(phi) * north) * TM_K0 + TM_FALSE_NORTHING).alias("x"),
        (prime_vertical * east * TM_K0 + TM_FALSE_EASTING).alias("y"),
    )


def _footpoint(x) -> Column:
    mu = (num(x) - TM_FALSE_NORTHING) / (TM_K0 * GRS80_A * _MERIDIAN_SCALE)
    return mu + _sine_series(mu, _FOOTPOINT_SINES)


def _at_footpoint(foot: Column) -> Column:
    """What the inverse series needs at the footpoint latitude."""
    w = F.lit(1.0) - F.sin(foot) * F.sin(foot) * _E2
    return F.struct(
        foot.alias("foot"),
        (F.lit(GRS80_A) / F.sqrt(w)).alias("prime_vertical"),
        (F.lit(GRS80_A * (1 - _E2)) / (w * F.sqrt(w))).alias("radius"),
        (F.tan(foot) * F.tan(foot)).alias("t"),
        (F.cos(foot) * F.cos(foot) * _EP2).alias("c"),
    )


def _off_footpoint(at: Column, y) -> Column:
    foot, prime_vertical, t, c = at["foot"], at["prime_vertical"], at["t"], at["c"]
    d = (num(y) - TM_FALSE_EASTING) / (prime_vertical * TM_K0)
    d2 = d * d
    drop = _poly(
        d2,
        [
            0.0,
            0.5,
            -(_poly(c, [5.0 - 9.0 * _EP2, 10.0, -4.0]) + t * 3.0) / 24.0,
            (_poly(t, [61.0 - 252.0 * _EP2, 90.0, 45.0]) + _poly(c, [0.0, 298.0, -3.0])) / 720.0,
        ],
    )
    side = d * _poly(
        d2,
        [
            1.0,
            -(t * 2.0 + c + 1.0) / 6.0,
            (_poly(t, [5.0 + 8.0 * _EP2, 28.0, 24.0]) + _poly(c, [0.0, -2.0, -3.0])) / 120.0,
        ],
    )
    return F.struct(
        (F.degrees(side / F.cos(foot)) + TM_LON0_DEG).alias("lon"),
        F.degrees(foot - prime_vertical * F.tan(foot) / at["radius"] * drop).alias("lat"),
    )


def from_epsg2180(x, y) -> Column:
    """Struct (lon, lat): the inverse series, from the footpoint latitude."""
    return _off_footpoint(_at_footpoint(_footpoint(x)), y)


def srs_family(srs: Column) -> Column:
    """'2180', '4326' or 'CRS84', null for anything else."""
    name = F.upper(srs)
    return (
        F.when(name.endswith("2180"), F.lit("2180"))
        .when(name.endswith("CRS84"), F.lit("CRS84"))
        .when(name.endswith("4326"), F.lit("4326"))
    )


def with_lonlat(frame: DataFrame, first: Column, second: Column, srs: str, axis_order: str = "auto") -> DataFrame:
    """Add ``lon`` and ``lat`` of coordinate pairs in the system named by column ``srs``.

    The steps of the inverse projection are columns of their own, so each is computed once and the
    generated code stays small. An unknown system is an error.
    """
    family = srs_family(F.col(srs))
    swapped = family == "4326" if axis_order == "auto" else F.lit(axis_order == "yx")
    unknown = F.raise_error(F.concat(F.lit("no conversion from "), F.col(srs))).cast("double")

    def pick(part: str, plain: str) -> Column:
        return (
            F.when(F.col("_family") == "2180", F.col("_off")[part]).when(F.col("_family").isNotNull(), F.col(plain))
            .otherwise(unknown)
        )

    steps = (
        frame.withColumn("_family", family)
        .withColumn("_x", F.when(swapped, second).otherwise(first))
        .withColumn("_y", F.when(swapped, first).otherwise(second))
        .withColumn("_foot", _footpoint(F.col("_x")))
        .withColumn("_at", _at_footpoint(F.col("_foot")))
        .withColumn("_off", _off_footpoint(F.col("_at"), F.col("_y")))
    )
    return steps.withColumn("lon", pick("lon", "_x")).withColumn("lat", pick("lat", "_y")).drop(
        "_family", "_x", "_y", "_foot", "_at", "_off"
    )


def reproject_box(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, srs: str) -> Column:
    """Struct of four bounds of a WGS84 box in the target system, from its four corners."""
    name = srs.upper()
    if name.endswith("4326") or name.endswith("CRS84"):
        parts = [min_lon, min_lat, max_lon, max_lat]
    elif name.endswith("2180"):
        corners = F.array(*[to_epsg2180(lon, lat) for lon in (min_lon, max_lon) for lat in (min_lat, max_lat)])
        xs = F.transform(corners, lambda p: p["x"])
        ys = F.transform(corners, lambda p: p["y"])
        parts = [F.round(f(v), 3) for f, v in ((F.array_min, xs), (F.array_min, ys), (F.array_max, xs), (F.array_max, ys))]
    else:
        raise ValueError(f"no conversion to {srs}")
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("min_x", "min_y", "max_x", "max_y"))])


def world_pixel(lon: Column, lat: Column, zoom: int, tile_size: int = 256) -> tuple[Column, Column]:
    """Web-Mercator pixel position (x, y) at a zoom level."""
    scale = float(tile_size * 2**zoom)
    limited = F.greatest(F.lit(-MERCATOR_MAX_LAT), F.least(F.lit(MERCATOR_MAX_LAT), lat))
    s = F.sin(F.radians(limited))
    x = (lon + 180.0) / 360.0 * scale
    y = (F.lit(0.5) - F.log((s + 1.0) / (F.lit(1.0) - s)) / (4.0 * math.pi)) * scale
    return x, y


def tile_index(pixel: Column, tile_size: int = 256) -> Column:
    return F.greatest(F.floor(pixel / float(tile_size)), F.lit(0)).cast("long")


# --- Predicates and small helpers ---------------------------------------------------------


def ray_crosses(lon: Column, lat: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does the eastward ray from (lon, lat) cross the edge: half-open in latitude."""
    rise = F.when(y1 == y0, F.lit(1e-12)).otherwise(y1 - y0)
    straddles = (y1 > lat) != (y0 > lat)
    return straddles & (lon < (x1 - x0) * (lat - y0) / rise + x0)


def interpolate(start: Column, end: Column, from_m: Column, to_m: Column, at_m: Column) -> Column:
    span = F.greatest(F.lit(1e-9), to_m - from_m)
    return F.round(start + (end - start) * ((at_m - from_m) / span), 7)


def closed_box_ring(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """Closed [lon, lat] ring of a box as nested arrays."""
    return F.array(
        F.array(min_lon, min_lat),
        F.array(max_lon, min_lat),
        F.array(max_lon, max_lat),
        F.array(min_lon, max_lat),
        F.array(min_lon, min_lat),
    )


def in_bbox(lat: Column, lon: Column, box: BBox) -> Column:
    return lat.between(box.min_lat, box.max_lat) & lon.between(box.min_lon, box.max_lon)
