"""Files for maps and reports, written by the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def geojson_features(frame: DataFrame, geometry_json: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature per row in a ``value`` column; the geometry is given as JSON text."""
    shown = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return frame.select(
        F.concat(F.lit('{"type":"Feature","properties":'), shown, F.lit(',"geometry":'), geometry_json, F.lit("}")).alias("value")
    )


def ring_geometry_json(ring: Column) -> Column:
    """Polygon geometry text of one closed [lon, lat] ring."""
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def write_geojson(frame: DataFrame, geometry_json: Column, properties: list[str], path: str) -> None:
    """Newline-delimited GeoJSON: one feature a line, so files split and append."""
    geojson_features(frame, geometry_json, properties).write.mode("overwrite").text(path)


def write_rows(frame: DataFrame, path: str, name: str, run_id: str) -> DataFrame:
    """Rows as JSON lines; returns a one-row description with the row count."""
    frame.write.mode("overwrite").json(path)
    stored = frame.sparkSession.read.schema(frame.schema).json(path)
    return stored.agg(F.lit(name).alias("query_name"), F.lit(run_id).alias("run_id"), F.count("*").alias("row_count"))


def write_chunks(viewer: DataFrame, geometry: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Viewer parcels with geometry, one directory per precinct.

    A precinct above ``rows_per_file`` parcels is split by a salt into as many parts as it needs, so
    that no task and no file holds more than about that many rows; all others make one file.
    """
    keys = ["voivodeship", "county", "commune", "precinct"]
    parts = viewer.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_file).alias("_parts"))
    joined = viewer.join(geometry, "parcel_id", "left").join(parts, keys)
    salted = joined.withColumn("_salt", F.pmod(F.xxhash64("parcel_id"), F.col("_parts"))).drop("_parts")
    salted.repartition(*keys, "_salt").drop("_salt").write.mode("overwrite").partitionBy(*keys).json(path)
