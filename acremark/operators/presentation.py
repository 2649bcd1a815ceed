"""Tables behind maps and reports: viewports, manifests, hierarchy groups, named top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.functions.geo import planar_distance_m
from acremark.functions.text import clean_part
from acremark.operators.filters import BOUNDS, area_between, tag_map, overlaps_bbox
from acremark.operators.geometry import nested_geometry
from acremark.operators.ordering import first_per_key
from acremark.session import cut_lineage

LEVELS = ["precinct", "commune", "county", "voivodeship"]


def admin_manifest(parcels: DataFrame, per_level: int | None = None) -> DataFrame:
    """For each of the four admin levels, its labels with parcel count and box, largest first; all or ``per_level``."""
    levels = F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.coalesce(F.col(level), F.lit("brak")).alias("label")) for level in LEVELS
    ]))
    groups = (
        parcels.select(levels.alias("g"), *BOUNDS)
        .groupBy("g.level", "g.label")
        .agg(F.count("*").alias("count"), F.min("bbox_min_lat").alias("min_lat"), F.min("bbox_min_lon").alias("min_lon"),
             F.max("bbox_max_lat").alias("max_lat"), F.max("bbox_max_lon").alias("max_lon"))
        .where("min_lat IS NOT NULL")
    )
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("count"), "label"))
    placed = groups.withColumn("position", rank)
    return placed if per_level is None else placed.where(F.col("position") <= per_level)


def manifest_totals(parcels: DataFrame) -> DataFrame:
    located = parcels.where("bbox_min_lat IS NOT NULL AND bbox_min_lon IS NOT NULL")
    return located.agg(
        F.count("*").alias("parcel_count"),
        F.min("bbox_min_lat").alias("min_lat"), F.min("bbox_min_lon").alias("min_lon"),
        F.max("bbox_max_lat").alias("max_lat"), F.max("bbox_max_lon").alias("max_lon"),
        F.coalesce(F.min("area_m2"), F.lit(0.0)).alias("area_min_m2"),
        F.coalesce(F.max("area_m2"), F.lit(0.0)).alias("area_max_m2"),
    )


def viewer_parcels(parcels: DataFrame) -> DataFrame:
    """Parcels as the static map shows them: blanks named, numbers rounded, centre filled in."""
    south, west, north, east = (F.round(b, 7) for b in BOUNDS)
    return parcels.dropna(subset=list(BOUNDS)).select(
        "parcel_id",
        F.coalesce(F.nullif(F.col("parcel_number"), F.lit("")), F.col("parcel_id")).alias("parcel_number"),
        *[clean_part(F.col(level)).alias(level) for level in reversed(LEVELS)],
        F.round(F.coalesce("area_m2", F.lit(0.0)), 2).alias("area_m2"),
        F.round(F.coalesce("centroid_lat", (south + north) / 2.0), 7).alias("center_lat"),
        F.round(F.coalesce("centroid_lon", (west + east) / 2.0), 7).alias("center_lon"),
        *[v.alias(b) for v, b in zip((south, west, north, east), BOUNDS)],
    )


def hierarchy_groups(viewer: DataFrame) -> DataFrame:
    """County, commune and precinct groups in one pass: count, area, box, area-weighted centre."""
    area = F.greatest(F.lit(0.0), F.col("area_m2"))
    weighed = viewer.withColumn("_a", area).withColumn("_alat", area * F.col("center_lat")).withColumn(
        "_alon", area * F.col("center_lon")
    )
    names = ["voivodeship", "county", "commune", "precinct"]
    sets = [names[:2], names[:3], names]
    grouped = weighed.groupingSets([[F.col(n) for n in s] for s in sets], *[F.col(n) for n in names]).agg(
        F.grouping_id(*[F.col(n) for n in names]).alias("_gid"),
        F.count("*").alias("count"),
        F.round(F.sum("area_m2"), 2).alias("area_m2"),
        F.min("bbox_min_lat").alias("min_lat"), F.min("bbox_min_lon").alias("min_lon"),
        F.max("bbox_max_lat").alias("max_lat"), F.max("bbox_max_lon").alias("max_lon"),
        F.sum("_a").alias("_a"), F.sum("_alat").alias("_alat"), F.sum("_alon").alias("_alon"),
        F.avg("center_lat").alias("_lat"), F.avg("center_lon").alias("_lon"),
    )
    level = F.when(F.col("_gid") == 3, "county").when(F.col("_gid") == 1, "commune").otherwise("precinct")
    return grouped.select(
        level.alias("level"),
        F.concat_ws("|", *names).alias("key"),
        *names,
        F.when(F.col("_gid") == 3, F.concat_ws(" / ", "voivodeship", "county"))
        .when(F.col("_gid") == 1, F.concat_ws(" / ", "county", "commune"))
        .otherwise(F.concat_ws(" / ", "commune", "precinct")).alias("label"),
        "count", "area_m2", "min_lat", "min_lon", "max_lat", "max_lon",
        F.round(F.when(F.col("_a") > 0, F.col("_alat") / F.col("_a")).otherwise(F.col("_lat")), 7).alias("center_lat"),
        F.round(F.when(F.col("_a") > 0, F.col("_alon") / F.col("_a")).otherwise(F.col("_lon")), 7).alias("center_lon"),
    )


def densest_groups(groups: DataFrame, min_count: int = 2, limit: int | None = None) -> DataFrame:
    """Groups by parcels per square kilometre of their box: all, or the ``limit`` densest in order."""
    km = 111.32  # fixed value: kilometres per degree
    middle = (F.col("min_lat") + F.col("max_lat")) / 2
    height = F.abs(F.col("max_lat") - F.col("min_lat")) * km
    width = F.abs(F.col("max_lon") - F.col("min_lon")) * km * F.cos(F.radians(middle))
    density = F.col("count") / F.greatest(F.lit(0.000001), width * height)
    found = groups.where(F.col("count") >= min_count).withColumn("density", density)
    return found if limit is None else found.orderBy(F.desc("density"), "label").limit(limit)


def viewport_matches(parcels: DataFrame, box: BBox, min_area: float | None = None, max_area: float | None = None,
                     ids: DataFrame | None = None) -> DataFrame:
    """All parcels that overlap the view and pass the area range and the id list."""
    hit = parcels.where(overlaps_bbox(box) & area_between(F.col("area_m2"), min_area, max_area))
    # no hint: whether the id list is small enough to broadcast is Spark's own size check
    return hit if ids is None else hit.join(ids.select("parcel_id"), "parcel_id", "left_semi")


def viewport(parcels: DataFrame, points: DataFrame | None, box: BBox, limit: int | None = None,
             min_area: float | None = None, max_area: float | None = None, ids: DataFrame | None = None) -> DataFrame:
    """All matches, or the ``limit`` nearest the middle of the view. Geometry is fetched for those only."""
    d_lat = F.coalesce("centroid_lat", F.lit(0.0)) - box.mid_lat
    d_lon = F.coalesce("centroid_lon", F.lit(0.0)) - box.mid_lon
    nearest = (
        viewport_matches(parcels, box, min_area, max_area, ids)
        .withColumn("distance2", d_lat * d_lat + d_lon * d_lon)
    )
    if limit is not None:
        nearest = nearest.orderBy("distance2", "parcel_id").limit(limit)
    if points is None:
        return nearest
    nearest = cut_lineage(nearest)
    wanted = points.join(nearest.select("parcel_id"), "parcel_id", "left_semi")
    return nearest.join(nested_geometry(wanted, min_points=3, lat_first=True), "parcel_id", "left")


def two_stage_viewport(groups: DataFrame, viewer: DataFrame, box: BBox, max_groups: int | None = None, limit: int | None = None) -> DataFrame:
    """Nearest precinct groups in view first, then their parcels in view by distance; all where no number is given.

    With the viewer table partitioned by its admin columns, the group keys prune its partitions.
    """
    bounds = ("min_lat", "min_lon", "max_lat", "max_lon")

    def away() -> Column:
        return planar_distance_m(F.col("center_lat"), F.col("center_lon"), box.mid_lat, box.mid_lon, box.mid_lat)

    keys = ["voivodeship", "county", "commune", "precinct"]
    chosen = (
        groups.where((F.col("level") == "precinct") & overlaps_bbox(box, bounds))
        .withColumn("_d", away())
    )
    chosen = (chosen if max_groups is None else chosen.orderBy("_d", "key").limit(max_groups)).select(*keys)
    found = viewer.join(chosen, keys, "left_semi").where(overlaps_bbox(box)).withColumn("distance_m", away())
    return found if limit is None else found.orderBy("distance_m", "parcel_id").limit(limit)


def run_metrics(features: DataFrame, cells: DataFrame, links: DataFrame | None, prices: DataFrame | None,
                geometry: DataFrame | None, visual: DataFrame | None, run_id: str) -> DataFrame:
    """The run summary as (position, metric, value) rows; an absent table counts zero."""
    own = F.col("run_id") == run_id
    zero = F.lit(0).cast("double")

    def rows(frame: DataFrame) -> Column:
        return frame.agg(F.count("*").cast("double").alias("n")).scalar()

    of_run = cells.where(own)
    linked = None if links is None else links.where(own).select("parcel_id")

    def featured(frame: DataFrame | None) -> Column:
        return zero if frame is None or linked is None else rows(frame.select("parcel_id").join(linked, "parcel_id"))

    metrics = [
        ("canon_osm_features", rows(features)),
        ("mesh_cells", rows(of_run)),
        ("mesh_categories", of_run.agg(F.countDistinct("category").cast("double").alias("n")).scalar()),
        ("max_mesh_score", of_run.agg(F.coalesce(F.max("score"), F.lit(0)).cast("double").alias("n")).scalar()),
        ("helper_layer2_run_parcels", zero if linked is None else rows(linked)),
        ("canon_rcn_price_observations", zero if prices is None else rows(prices.where(own))),
        ("deriv_parcel_geometry_features", featured(geometry)),
        ("deriv_parcel_visual_features", featured(visual)),
    ]
    row = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(metrics, 1)
    ])
    return features.sparkSession.range(1).select(F.inline(row))


TOP_CELL_COLUMNS = ["cell_id", "category", "tag_key", "tag_value", "score", "point_count", *BOUNDS]


def named_top_cells(cells: DataFrame, run_id: str, limit: int) -> DataFrame:
    return cells.where(F.col("run_id") == run_id).orderBy(F.desc("score"), "cell_id").limit(limit).select(*TOP_CELL_COLUMNS)


def named_parcels(links: DataFrame, parcels: DataFrame, run_id: str, limit: int) -> DataFrame:
    return (
        links.where(F.col("run_id") == run_id).select("parcel_id", "candidate_index", "source_bbox").join(parcels, "parcel_id")
        .select("parcel_id", "parcel_number", "commune", "county", "voivodeship", F.round("area_m2", 1).alias("area_m2"),
                *BOUNDS, "candidate_index", "source_bbox")
        .orderBy("candidate_index", "parcel_id").limit(limit)
    )


def named_geometry(links: DataFrame, geometry: DataFrame, run_id: str, limit: int) -> DataFrame:
    """Parcels of a run by falling elongation, figures rounded."""
    digits = {"area_m2": 1, "perimeter_m": 1, "compactness": 4, "elongation_ratio": 4, "centroidal_ixx_m4": 3,
              "centroidal_iyy_m4": 3, "centroidal_ixy_m4": 3, "principal_moment_min_m4": 3, "principal_moment_max_m4": 3}
    shown = [F.round(c, d).alias(c) for c, d in digits.items() if c in geometry.columns]
    own = links.where(F.col("run_id") == run_id).select("parcel_id")
    return (
        geometry.join(own, "parcel_id").orderBy(F.desc("elongation_ratio"), "parcel_id").limit(limit)
        .select("parcel_id", *shown)
    )


def named_visual(links: DataFrame, visual: DataFrame, run_id: str, limit: int) -> DataFrame:
    """Parcels of a run by falling green share, figures rounded."""
    digits = {"brightness_mean": 2, "green_index_mean": 4, "green_pixel_ratio": 4, "dark_pixel_ratio": 4,
              "bright_pixel_ratio": 4, "low_saturation_ratio": 4}
    own = links.where(F.col("run_id") == run_id).select("parcel_id")
    return (
        visual.join(own, "parcel_id").orderBy(F.desc("green_pixel_ratio"), "parcel_id").limit(limit)
        .select("parcel_id", "masked_pixel_count", "tile_count", "zoom", *[F.round(c, d).alias(c) for c, d in digits.items()])
    )


def points_of_runs(cells: DataFrame, features: DataFrame) -> DataFrame:
    """Features inside the box around all cells that have a tag of theirs, each once per category.

    Of several tags or runs that give a feature the same category the first counts, by key, value and run. Cells without a
    tag ask for nothing.
    """
    bounds = cells.agg(F.struct(*[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOUNDS)])).scalar()
    wanted = cells.where((F.col("tag_key") != "") & (F.col("tag_value") != "")).groupBy("tag_key", "tag_value", "category").agg(F.min("run_id").alias("run_id"))
    south, west, north, east = (bounds[c] for c in BOUNDS)
    inside = features.where(F.col("center_lat").between(south, north) & F.col("center_lon").between(west, east))
    own = [c for c in features.columns if c not in {"tag_key", "tag_value", "category", "name", "run_id"}]
    tagged = inside.withColumn("_tags", tag_map(F.col("tags_json"))).select(
        *own, F.coalesce(F.element_at("_tags", F.lit("name")), F.lit("")).alias("name"), F.explode("_tags").alias("tag_key", "tag_value"))
    found = tagged.join(wanted, ["tag_key", "tag_value"])
    return first_per_key(found, ["osm_type", "osm_id", "category"], [F.col("tag_key"), F.col("tag_value"), F.col("run_id")])


def parcels_of_runs(parcels: DataFrame, links: DataFrame, runs: list[str]) -> DataFrame:
    return parcels.join(links.where(F.col("run_id").isin(list(runs))).select("parcel_id"), "parcel_id", "left_semi")


def map_parcels(parcels: DataFrame, points: DataFrame, links: DataFrame, runs: list[str], prices: DataFrame | None,
                geometry: DataFrame | None, visual: DataFrame | None) -> DataFrame:
    """Every parcel of the runs with price, shape and imagery figures and its nested geometry.

    An absent table gives no records and null figures.
    """
    from acremark.operators.prices import map_price_stats
    from acremark.operators.ranking import optional_columns

    chosen = parcels_of_runs(parcels, links, runs).withColumn(
        "lat", (F.col("bbox_min_lat") + F.col("bbox_max_lat")) / 2.0
    ).withColumn("lon", (F.col("bbox_min_lon") + F.col("bbox_max_lon")) / 2.0)
    paid = {c: c for c in ("avg_price_per_m2", "avg_inflation_adjusted_price_per_m2", "inflation_reference_year")}
    stats = None if prices is None else map_price_stats(prices, runs)
    chosen = optional_columns(chosen, stats, {"rcn_records": "rcn_records", **paid})
    chosen = chosen.withColumn("rcn_records", F.coalesce(F.col("rcn_records").cast("long"), F.lit(0).cast("long")))
    shape = ["compactness", "elongation_ratio", "principal_moment_min_m4", "principal_moment_max_m4"]
    chosen = optional_columns(chosen, geometry, {"area_m2": "shape_area_m2", **{c: c for c in shape}})
    look = ["green_pixel_ratio", "dark_pixel_ratio", "bright_pixel_ratio", "low_saturation_ratio", "brightness_mean",
            "masked_pixel_count"]
    chosen = optional_columns(chosen, visual, {c: c for c in look})
    wanted = points.join(chosen.select("parcel_id"), "parcel_id", "left_semi")
    return chosen.join(nested_geometry(wanted), "parcel_id")


def categories_union(cells: DataFrame, points: DataFrame) -> DataFrame:
    return cells.select("category").union(points.select("category")).distinct()


def run_artifacts(artifacts: DataFrame, run_id: str) -> DataFrame:
    """Artifacts of a run in id order, without payload, with their number."""
    own = artifacts.where(F.col("run_id") == run_id)
    total = own.agg(F.count("*").alias("n")).scalar()
    return own.drop("payload_json").withColumn("artifact_count", total).orderBy("id")


def latest_artifacts(artifacts: DataFrame, keys: tuple[str, ...] = ("run_id", "artifact_type", "artifact_key")) -> DataFrame:
    return first_per_key(artifacts, list(keys), [F.desc("updated_at"), F.desc("id")])
