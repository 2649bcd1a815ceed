"""Checks of stored tables, as rows instead of exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What each stored table must have. stage None means always checked.
CONTRACTS = {
    "canon_osm_features": {"stage": None, "key": ["osm_type", "osm_id"], "columns": ["osm_type", "osm_id"]},
    "helper_osm_hotspot_mesh_cells": {"stage": None, "columns": ["run_id"], "filled": "run_id"},
    "canon_parcels": {
        "stage": "links", "key": ["parcel_id"],
        "columns": ["parcel_id", "bbox_min_lat", "bbox_min_lon", "bbox_max_lat", "bbox_max_lon", "geometry_hash"],
    },
    "canon_parcel_polygon_points": {"stage": "links", "columns": []},
    "helper_layer2_run_parcels": {
        "stage": "links", "columns": ["run_id", "parcel_id", "candidate_index", "source_bbox"],
        "parent": ("canon_parcels", "parcel_id"),
    },
    "canon_rcn_price_observations": {
        "stage": "prices", "key": ["source", "source_record_id", "run_id"],
        "columns": ["source", "source_record_id", "run_id", "raw_json", "price_per_m2", "inflation_reference_year",
                    "inflation_factor", "inflation_adjusted_price_pln", "inflation_adjusted_price_per_m2"],
    },
    "deriv_parcel_geometry_features": {
        "stage": "geometry", "key": ["parcel_id"],
        "columns": ["parcel_id", "area_m2", "centroidal_ixx_m4", "centroidal_iyy_m4", "centroidal_ixy_m4",
                    "principal_moment_min_m4", "principal_moment_max_m4", "elongation_ratio", "compactness"],
        "parent": ("canon_parcels", "parcel_id"),
    },
    "deriv_parcel_visual_features": {
        "stage": "visual", "key": ["parcel_id"],
        "columns": ["parcel_id", "source_geometry_hash", "image_source", "zoom", "algorithm_version", "masked_pixel_count",
                    "tile_count", "rgb_r_mean", "rgb_g_mean", "rgb_b_mean", "brightness_mean", "green_index_mean",
                    "green_pixel_ratio", "dark_pixel_ratio", "bright_pixel_ratio", "low_saturation_ratio"],
        "forbidden": ["area_m2"], "parent": ("canon_parcels", "parcel_id"),
    },
}
# Table names without a class prefix, left over from older workspaces.
UNPREFIXED = ["osm_features", "osm_hotspot_mesh_cells", "parcels", "parcel_polygon_points", "layer2_run_parcels",
              "parcel_geometry_features", "parcel_visual_features", "parcel_railway_features", "rcn_price_observations"]

REPORT = "table string, check string, detail string, breaches long"


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def missing_or_empty(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.count_if(F.col(column).isNull() | (F.col(column) == "")).alias("breaches"))


def missing_names(required: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    return required.select(name).subtract(present.select(name))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [f.agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n, f in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate(spark: SparkSession, tables: dict[str, DataFrame], stages: set[str] = frozenset(),
             contracts: dict = CONTRACTS) -> DataFrame:
    """One row per breach: missing tables and columns, duplicate keys, orphans, rows without a run.

    ``stages`` switches on the checks of "links", "prices", "geometry" and "visual". Schema breaches
    are known from the schemas; the counts stay lazy.
    """
    known: list[tuple] = [(t, "unprefixed", "old table remains", 1) for t in UNPREFIXED if t in tables]
    counted: list[DataFrame] = []

    def add(frame: DataFrame, table: str, check: str, detail: str) -> None:
        counted.append(
            frame.agg(F.count("*").alias("breaches")).select(
                F.lit(table).alias("table"), F.lit(check).alias("check"), F.lit(detail).alias("detail"), "breaches"
            )
        )

    for table, contract in contracts.items():
        if contract["stage"] and contract["stage"] not in stages:
            continue
        if table not in tables:
            known.append((table, "missing_table", table, 1))
            continue
        frame = tables[table]
        absent = [c for c in contract["columns"] if c not in frame.columns]
        known += [(table, "missing_column", c, 1) for c in absent]
        known += [(table, "forbidden_column", c, 1) for c in contract.get("forbidden", []) if c in frame.columns]
        key = contract.get("key", [])
        if key and all(k in frame.columns for k in key):
            add(duplicate_keys(frame, key), table, "duplicate_key", ",".join(key))
        if "parent" in contract:
            parent, column = contract["parent"]
            if parent in tables and column in frame.columns:
                add(orphans(frame, tables[parent], column), table, "orphan", parent)
        filled = contract.get("filled")
        if filled and filled in frame.columns:
            add(frame.where(F.col(filled).isNull() | (F.col(filled) == "")), table, "empty_value", filled)
    report = spark.createDataFrame(known, REPORT)
    for part in counted:
        report = report.unionByName(part)
    return report.where("breaches > 0")


def validation_status(report: DataFrame) -> DataFrame:
    return report.agg(
        F.when(F.count("*") == 0, "ok").otherwise("schema_error").alias("status"), F.count("*").alias("failed_checks")
    )
