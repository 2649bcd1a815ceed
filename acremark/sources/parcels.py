"""Landed cadastral data: GML features, point-lookup texts, well-known text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acremark.functions.geo import with_lonlat

# Element names of the usual parcel service, by stored column.
FIELD_MAP = {
    "parcel_id": "ID_DZIALKI",
    "parcel_number": "NUMER_DZIALKI",
    "voivodeship": None,
    "county": None,
    "commune": "NAZWA_GMINY",
    "precinct": "NAZWA_OBREBU",
    "precinct_code": "NUMER_OBREBU",
}

_RING = ("struct<LinearRing:struct<_srsName:string,posList:struct<_VALUE:string,_srsDimension:int>,coordinates:string>>")
_POLYGON = f"struct<_srsName:string,_srsDimension:int,exterior:{_RING},interior:array<{_RING}>>"


def scan_parcel_gml(spark: SparkSession, path: str, field_map: dict[str, str | None] = FIELD_MAP,
                    geometry_field: str = "msGeometry", row_tag: str = "dzialki") -> DataFrame:
    """One row per feature with its named fields and its polygons; features without id are dropped.

    Spark's XML source streams a file row tag by row tag, so a large response is never held whole.
    """
    names = sorted({n for n in field_map.values() if n})
    geometry = (
        f"struct<Polygon:array<{_POLYGON}>,"
        f"MultiPolygon:struct<polygonMember:array<struct<Polygon:{_POLYGON}>>>,"
        f"MultiSurface:struct<surfaceMember:array<struct<Polygon:{_POLYGON}>>>>"
    )
    schema = ", ".join([f"{n} string" for n in names] + [f"{geometry_field} {geometry}"])
    raw = (
        spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)
    )

    def field(column: str) -> Column:
        source = field_map.get(column)
        return F.nullif(F.trim(F.col(source)), F.lit("")) if source else F.lit(None).cast("string")

    shape = F.col(geometry_field)
    empty = F.array().cast(f"array<{_POLYGON}>")
    polygons = F.concat(
        F.coalesce(shape["Polygon"], empty),
        F.coalesce(shape["MultiPolygon"]["polygonMember"]["Polygon"], empty),
        F.coalesce(shape["MultiSurface"]["surfaceMember"]["Polygon"], empty),
    )
    plain = [c for c in FIELD_MAP if c not in ("precinct", "precinct_code")]
    return raw.select(
        *[field(c).alias(c) for c in plain],
        F.coalesce(field("precinct"), field("precinct_code")).alias("precinct"),
        polygons.alias("polygons"),
    ).where(F.col("parcel_id").isNotNull())


def gml_ring_points(features: DataFrame, default_srs: str, axis_order: str = "auto") -> DataFrame:
    """Vertices of the scanned polygons as (parcel_id, polygon, ring, point, lon, lat) rows."""
    polygons = features.select("parcel_id", F.posexplode("polygons").alias("polygon_index", "polygon"))
    outer = F.array(F.col("polygon.exterior"))
    rings = F.filter(F.concat(outer, F.coalesce(F.col("polygon.interior"), F.expr("slice(array(polygon.exterior), 1, 0)"))),
                     lambda r: r["LinearRing"].isNotNull())
    each = polygons.select(
        "parcel_id", "polygon_index", "polygon._srsName", "polygon._srsDimension", F.posexplode(rings).alias("ring_index", "r")
    )
    ring = F.col("r.LinearRing")
    srs = F.coalesce(ring["_srsName"], F.col("_srsName"), F.lit(default_srs))
    # the texts are split in a step of their own: inside of the transform below they would be split anew for every vertex
    listed = each.select(
        "parcel_id", "polygon_index", "ring_index", srs.alias("srs"),
        F.filter(F.split(F.trim(ring["posList"]["_VALUE"]), r"\s+"), lambda w: w != "").alias("words"),
        F.coalesce(ring["posList"]["_srsDimension"], F.col("_srsDimension"), F.lit(2)).alias("size"),
        F.filter(F.split(F.trim(ring["coordinates"]), r"\s+"), lambda w: w != "").alias("pairs"),
    )
    words, size = F.col("words"), F.col("size")
    uneven = F.raise_error(F.lit("posList length is not a multiple of its dimension")).cast("array<struct<a:double,b:double>>")
    from_list = F.when(
        F.size(words) % size == 0,
        F.transform(
            F.sequence(F.lit(0), F.floor(F.size(words) / size).cast("int") - 1),
            lambda i: F.struct(
                F.element_at(words, i * size + 1).cast("double").alias("a"), F.element_at(words, i * size + 2).cast("double").alias("b")
            ),
        ),
    ).otherwise(uneven)
    from_pairs = F.transform("pairs", lambda w: F.struct(
        F.split(w, ",")[0].cast("double").alias("a"), F.split(w, ",")[1].cast("double").alias("b")))
    vertices = listed.select(
        "parcel_id", "polygon_index", "ring_index", "srs",
        F.posexplode(F.when(F.size(words) > 0, from_list).otherwise(from_pairs)).alias("point_index", "p"),
    )
    placed = with_lonlat(vertices, F.col("p.a"), F.col("p.b"), "srs", axis_order)
    return placed.select("parcel_id", "polygon_index", "ring_index", "point_index", "lon", "lat")


LOOKUP_FIELDS = ["parcel_id", "parcel_number", "commune", "county", "voivodeship", "datasource", "wkt"]


def scan_lookup_texts(spark: SparkSession, path: str) -> DataFrame:
    """Landed point-lookup answers, one a file: parcel fields and WKT, or an empty or error status."""
    return parse_lookup(spark.read.text(path, wholetext=True).withColumnRenamed("value", "answer"))


def parse_lookup(answers: DataFrame, text: str = "answer") -> DataFrame:
    lines = F.filter(F.transform(F.split(F.col(text), r"\r?\n|\r"), lambda s: F.trim(s)), lambda s: s != "")
    first = F.get(lines, F.lit(0))
    fields = F.split(F.get(lines, F.lit(1)), r"\|", 7)
    nothing = (F.size(lines) == 0) | (
        first.startswith("-1") & F.exists(lines, lambda s: F.lower(s).contains("brak wynik"))
    )
    status = (
        F.when(nothing, "empty").when((first != "0") | (F.size(lines) < 2), "error: unexpected answer")
        .when(F.size(fields) < 7, "error: too few fields").otherwise("ok")
    )
    rest = [c for c in answers.columns if c != text]
    return answers.withColumn("status", status).withColumn("_f", F.when(F.col("status") == "ok", fields)).select(
        *rest, "status", *[F.col("_f")[i].alias(n) for i, n in enumerate(LOOKUP_FIELDS)]
    )


def wkt_to_rings(wkt: Column) -> Column:
    """POLYGON or MULTIPOLYGON text as polygon > ring > (lon, lat); further ordinates are dropped.

    Other geometry is an error.
    """
    clean = F.regexp_replace(F.trim(wkt), r"(?i)^SRID=[^;]*;\s*", "")
    upper = F.upper(clean)
    # a polygon is "(ring),(ring)..." with rings free of brackets; matches also the single POLYGON
    bodies = F.regexp_extract_all(clean, F.lit(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"), F.lit(1))

    def ring_points(ring: Column) -> Column:
        def point(pair: Column) -> Column:
            words = F.split(F.trim(pair), r"\s+")
            return F.struct(words[0].cast("double").alias("lon"), words[1].cast("double").alias("lat"))

        return F.transform(F.split(ring, ","), point)

    def rings_of(body: Column) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(r"\(([^()]*)\)"), F.lit(1)), ring_points)

    unsupported = F.raise_error(F.concat(F.lit("unsupported geometry: "), F.substring(clean, 1, 32))).cast(
        "array<array<array<struct<lon:double,lat:double>>>>"
    )
    return F.when(upper.startswith("POLYGON") | upper.startswith("MULTIPOLYGON"), F.transform(bodies, rings_of)).otherwise(
        F.when(wkt.isNotNull(), unsupported)
    )


def ring_rows(frame: DataFrame, rings: str = "rings", key: str = "parcel_id") -> DataFrame:
    """Nested rings as vertex rows."""
    polygons = frame.select(key, F.posexplode(rings).alias("polygon_index", "_polygon"))
    each = polygons.select(key, "polygon_index", F.posexplode("_polygon").alias("ring_index", "_ring"))
    return each.select(key, "polygon_index", "ring_index", F.posexplode("_ring").alias("point_index", "_p")).select(
        key, "polygon_index", "ring_index", "point_index", "_p.lon", "_p.lat"
    )
