"""Whole analyses, from stored tables to the table a user asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.functions.scoring import Weights
from acremark.operators import coverage, filters, geometry, graph, hotspots, imagery, presentation, prices, ranking
from acremark.operators.filters import BOUNDS
from acremark.operators.upsert import insert_if_absent, upsert
from acremark.session import cut_lineage
from acremark.streaming.incremental import missing_features


def hotspot_mesh(features: DataFrame, box: BBox, types: list[tuple[str, str]], run_id: str, nx: int = 28,
                 kernel_m: float = 450.0, min_norm: float = 0.0) -> DataFrame:
    """Kernel mesh of every category, numbered by score over all of them."""
    points = filters.match_tags(features.where(filters.feature_overlaps_bbox(box)), types)
    mesh = hotspots.kernel_mesh(points, box, nx, kernel_m, min_norm, "center_lat", "center_lon")
    return hotspots.number_cells(mesh, run_id, ["category", "y", "x", "t"])


def mesh_category_stats(features: DataFrame, cells: DataFrame, box: BBox, types: list[tuple[str, str]]) -> DataFrame:
    """Per requested category: stored points and mesh triangles, zeros included."""
    points = filters.match_tags(features.where(filters.feature_overlaps_bbox(box)), types)
    wanted = filters.types_frame(features.sparkSession, types).select("category")
    stored = points.groupBy("category").agg(F.count("*").alias("stored_matching_points"))
    made = cells.groupBy("category").agg(F.count("*").alias("mesh_triangles"))
    return wanted.join(stored, "category", "left").join(made, "category", "left").fillna(0)


def quadtree_points(features: DataFrame, box: BBox, types: list[tuple[str, str]],
                    default: hotspots.QuadtreeConfig = hotspots.QuadtreeConfig(),
                    per_category: dict[str, hotspots.QuadtreeConfig] | None = None) -> tuple[DataFrame, DataFrame]:
    """(thinned points inside the box, per-category counts of each step)."""
    from acremark.functions.geo import in_bbox

    matched = filters.match_tags(features.where(filters.feature_overlaps_bbox(box)), types)
    inside = in_bbox(F.col("center_lat"), F.col("center_lon"), box)
    radius = hotspots._setting("dedupe_radius_m", default, per_category or {})
    thinned = hotspots.thin_by_radius(
        matched.where(inside), ["osm_type", "osm_id"], ["category"], radius, box.mid_lat, "center_lat", "center_lon"
    )
    wanted = filters.types_frame(features.sparkSession, types).select("category")
    counts = matched.groupBy("category").agg(
        F.count("*").alias("stored_matching_points"), F.count_if(inside).alias("in_bbox_points"),
        F.count_if(~inside).alias("outside_bbox_points"),
    )
    kept = thinned.groupBy("category").agg(F.count("*").alias("deduped_points"))
    stats = wanted.join(counts, "category", "left").join(kept, "category", "left").fillna(0)
    return thinned, stats


def hotspot_quadtree(features: DataFrame, box: BBox, types: list[tuple[str, str]],
                     default: hotspots.QuadtreeConfig = hotspots.QuadtreeConfig(),
                     per_category: dict[str, hotspots.QuadtreeConfig] | None = None) -> DataFrame:
    """Thinned points, adaptive cells, overlaps suppressed, scores normalised over all categories."""
    points, _ = quadtree_points(features, box, types, default, per_category)
    cells = hotspots.quadtree_hotspots(points, box, default, per_category, "center_lat", "center_lon")
    limit = hotspots._setting("max_overlap_ratio", default, per_category or {})
    kept = hotspots.suppress_overlaps(cells, limit)
    # a table of cells, bounded by the depth of the tree
    return hotspots.normalise_by_max(kept, "score", [])


def hotspot_grid(features: DataFrame, box: BBox, types: list[tuple[str, str]], n: int, limit: int) -> DataFrame:
    """The uniform grid over features with any of the tags."""
    from acremark.functions.geo import in_bbox

    chosen = features.where(in_bbox(F.col("center_lat"), F.col("center_lon"), box)).where(
        filters.has_any_tag(F.col("tags_json"), types)
    )
    return hotspots.uniform_grid(chosen, box, n, limit)


def probe_area(spark, box: BBox, step_m: float, parcels: DataFrame, points: DataFrame, max_requests: int = 0,
               expected_commune: str | None = None, gates: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples of one area within the request budget, and their counters."""
    area = spark.createDataFrame(
        [("area", box.min_lat, box.min_lon, box.max_lat, box.max_lon)], "area_id string, " + ", ".join(f"{b} double" for b in BOUNDS)
    )
    samples = coverage.judged_samples(area, "area_id", step_m, parcels, points, expected_commune, gates)
    used = coverage.within_budget(samples, max_requests)
    return used, coverage.coverage_counts(used, "area_id")


def link_candidates(cells: DataFrame, parcels: DataFrame, points: DataFrame, run_id: str, max_candidates: int | None = None,
                    step_m: float = 35.0, max_requests: int = 0, expected_commune: str | None = None,
                    strict_commune: bool = False, excluded: list[str] = (), gates: dict | None = None,
                    target_parcels: int = 0) -> tuple[DataFrame, DataFrame]:
    """Parcels found under the best cells of a run: (links, one status row per candidate).

    All candidates are probed in one join, or the ``max_candidates`` best, each until ``max_requests`` of its points were uncovered
    (zero: all its points). A candidate is out of scope or empty by what its points
    up to the first uncovered one show. With ``target_parcels``, candidates after the one that
    reaches it are left out (1 stops at the first hit).
    """
    candidates = ranking.ranked_candidates(cells, run_id, max_candidates, excluded)
    candidates = cut_lineage(candidates)
    samples = coverage.judged_samples(
        candidates, "candidate_index", step_m, parcels, points, expected_commune if strict_commune else None, gates
    )
    first_look = F.col("uncovered_before") < 1
    in_budget = F.lit(True) if max_requests == 0 else first_look if max_requests == 1 else F.col("uncovered_before") < max_requests

    def seen(outcome: str):
        return F.count_if(first_look & (F.col("outcome") == outcome))

    looks = samples.groupBy("candidate_index").agg(
        seen("out_of_scope").alias("o"), seen("uncovered").alias("u"), seen("found").alias("f"),
        F.count_if(in_budget).alias("points"), F.count_if(in_budget & (F.col("outcome") == "uncovered")).alias("requests"),
    )
    state = F.when(F.col("o") > 0, "out_of_scope").when((F.col("u") > 0) & (F.col("f") == 0), "empty").otherwise("probed")
    looked = looks.select("candidate_index", state.alias("status"), "points", "requests")
    found = samples.where(in_budget & (F.col("outcome") == "found")).join(
        looked.where("status = 'probed'").select("candidate_index"), "candidate_index", "left_semi"
    )
    firsts = found.groupBy("parcel_id").agg(F.min("candidate_index").alias("candidate_index"))
    hits = firsts.groupBy("candidate_index").agg(F.count("*").alias("new_parcels"))
    # one row per candidate from here on
    before = Window.orderBy("candidate_index").rowsBetween(Window.unboundedPreceding, -1)
    progress = looked.join(hits, "candidate_index", "left").fillna(0, subset=["new_parcels"]).withColumn(
        "linked_before", F.coalesce(F.sum("new_parcels").over(before), F.lit(0))
    )
    tested = progress.where(F.col("linked_before") < target_parcels) if target_parcels else progress
    w, s, e, n = (F.col(f"bbox_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    labels = candidates.join(tested.select("candidate_index"), "candidate_index", "left_semi").select(
        "candidate_index", F.concat_ws(",", w, s, e, n).alias("source_bbox")
    )
    links = firsts.join(labels, "candidate_index").select(
        F.lit(run_id).alias("run_id"), "parcel_id", "candidate_index", "source_bbox",
        F.lit(expected_commune).cast("string").alias("expected_commune"),
    )
    return links, tested


def candidate_rollup(tested: DataFrame, strict_commune: bool = False) -> DataFrame:
    """One row about a linking run: how many candidates were tested and what became of them."""
    none = "no_in_scope_parcels" if strict_commune else "no_parcels_found"
    totals = tested.agg(
        F.count("*").alias("tested_candidates"),
        F.count_if(F.col("status") == "empty").alias("empty_candidates"),
        F.count_if(F.col("status") == "out_of_scope").alias("out_of_scope_candidates"),
        F.coalesce(F.sum("new_parcels"), F.lit(0)).alias("linked_parcels"),
        F.min(F.when(F.col("new_parcels") > 0, F.col("candidate_index"))).alias("selected_candidate"),
    )
    return totals.withColumn("status", F.when(F.col("linked_parcels") > 0, "ok").otherwise(none))


def store_links(stored: DataFrame, links: DataFrame) -> DataFrame:
    """Links to append: the first candidate of a parcel wins, stored links stay."""
    return insert_if_absent(stored, links, ["run_id", "parcel_id"], [F.col("candidate_index")])


def price_scan(parcels: DataFrame, records: DataFrame, run_id: str, index: DataFrame | None = None,
               checks: DataFrame | None = None, tile_km: float = 2.0, margin_m: float = 50.0,
               failed_tiles: DataFrame | None = None, reference_year: str | None = None,
               newest_by: tuple[str, ...] = ("transaction_date", "parcel_id", "price_per_m2", "raw_json")) -> dict[str, DataFrame]:
    """Scan landed price records for all parcels not yet checked.

    Records are merged on (source, source_record_id, run_id) before any figure is taken; of repeated
    ones the last by ``newest_by`` counts. Parcels of failed tiles have zero counts and no figures.

    Returns the observations, the tiles to fetch, the checks of this scan and its totals. Tiles in
    ``failed_tiles`` (tile_id, error) mark their parcels as failed, to be taken up by the next scan.
    """
    pending = filters.fully_located(parcels)
    if checks is not None:
        pending = pending.join(checks.where("status = 'ok'").select("parcel_id"), "parcel_id", "left_anti")
    tiles, members = prices.scan_tiles(pending, tile_km, margin_m)
    # not stored: figures need few columns of the records that stay, so the texts are sent for the observations alone
    parsed = prices.parsed_records(records)
    newest = prices.newest_records(parsed, newest_by)
    observations = prices.observations_of(newest, run_id, index, reference_year)
    stats = prices.stats_per_parcel(members, observations)
    status = members.join(stats, "parcel_id")
    if failed_tiles is None:
        status = status.withColumn("status", F.lit("ok")).withColumn("error_message", F.lit(None).cast("string"))
    else:
        known = failed_tiles.select("tile_id", F.col("error").alias("error_message"))
        status = status.join(known, "tile_id", "left").withColumn(
            "status", F.when(F.col("error_message").isNull(), "ok").otherwise("error")
        )
        done = F.col("status") == "ok"
        counts = {"rcn_records", "priced_records"}
        status = status.withColumns({c: F.when(done, F.col(c)).otherwise(F.lit(0) if c in counts else F.lit(None))
                                     for c in stats.columns if c != "parcel_id"})
    # the rows to store; the totals are counted from the same copy
    checked = cut_lineage(status.withColumn("run_id", F.lit(run_id)))
    tile_status = checked.groupBy("tile_id").agg(F.max(F.when(F.col("status") == "ok", "ok").otherwise("error")).alias("status"))
    return {
        "observations": observations, "tiles": tiles, "checks": checked,
        "totals": prices.scan_totals(tile_status, checked, records, parsed.select("source_record_id").distinct()),
    }


def merge_checks(stored: DataFrame, checks: DataFrame) -> DataFrame:
    return upsert(stored, checks, ["parcel_id"], ["run_id", "tile_id"])


def geometry_features(points: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Moments of all parcels, or of those named, with the geometry digest they were made from."""
    chosen = points if ids is None else points.join(ids.select("parcel_id"), "parcel_id", "left_semi")
    digests = geometry.geometry_hash(chosen).withColumnRenamed("geometry_hash", "source_geometry_hash")
    return geometry.polygon_moments(chosen).join(digests, "parcel_id")


def job_states(ids: DataFrame, points: DataFrame, features: DataFrame) -> DataFrame:
    """(parcel_id, status, error, source_geometry_hash) of every id a feature job was asked for.

    ``skipped`` has no vertices, ``error`` has a row with a message, ``computed`` has figures. The digest is that of the vertices
    the job saw.
    """
    digests = geometry.geometry_hash(points.join(ids.select("parcel_id"), "parcel_id", "left_semi")).withColumnRenamed("geometry_hash", "source_geometry_hash")
    made = features.select("parcel_id", "error", F.lit(True).alias("_made"))
    found = ids.select("parcel_id").distinct().join(digests, "parcel_id", "left").join(made, "parcel_id", "left")
    status = F.when(F.col("source_geometry_hash").isNull(), "skipped").when(F.col("error").isNotNull() | F.col("_made").isNull(), "error").otherwise("computed")
    message = F.when(status == "error", F.coalesce("error", F.lit("no figures")))
    return found.select("parcel_id", status.alias("status"), message.alias("error"), "source_geometry_hash")


def job_counters(states: DataFrame) -> DataFrame:
    """How many ids were requested, computed, skipped for want of vertices, and failed."""
    return states.agg(F.count("*").alias("requested"), *[F.count_if(F.col("status") == s).alias(n) for s, n in
                                                         (("computed", "computed"), ("skipped", "skipped"), ("error", "errors"))])


def still_open(ids: DataFrame, points: DataFrame, states: DataFrame | None, retry_errors: bool = False) -> DataFrame:
    """The ids whose state is not known, or was made from other vertices; failed ones again with ``retry_errors``."""
    ids = ids.select("parcel_id").distinct()
    if states is None:
        return ids
    done = states.where("status <> 'error'") if retry_errors else states
    digests = geometry.geometry_hash(points.join(ids, "parcel_id", "left_semi")).withColumnRenamed("geometry_hash", "_now")
    current = ids.join(digests, "parcel_id", "left")
    same = (done["parcel_id"] == current["parcel_id"]) & done["source_geometry_hash"].eqNullSafe(current["_now"])
    return current.join(done, same, "left_anti").select("parcel_id")


ALGORITHM_VERSION = "deriv_parcel_visual_features_v1"  # fixed value, stored with the rows
NO_PIXELS = "parcel mask has no pixels"  # fixed value, the message of parcels without pixels


def visual_features(points: DataFrame, strips: DataFrame, zoom: int, image_source: str, tile_size: int = 256) -> DataFrame:
    """A row for every parcel with vertices: its colour figures, ready to store, or an ``error`` where it has no pixels."""
    figures = imagery.zonal_statistics(points, strips, zoom, tile_size)
    tiles = imagery.parcel_tiles(points, zoom, tile_size).groupBy("parcel_id").agg(F.count("*").alias("tile_count"))
    digests = geometry.geometry_hash(points).withColumnRenamed("geometry_hash", "source_geometry_hash")
    return digests.join(tiles, "parcel_id").join(figures, "parcel_id", "left").select("parcel_id", *figures.columns[1:], "tile_count", "source_geometry_hash").withColumns({
        "zoom": F.lit(zoom), "image_source": F.lit(image_source), "algorithm_version": F.lit(ALGORITHM_VERSION),
        "error": F.when(F.col("masked_pixel_count").isNull(), F.lit(NO_PIXELS)),
    })


def fill_missing_visual(parcels: DataFrame, points: DataFrame, strips: DataFrame, stored: DataFrame, zoom: int, image_source: str,
                        links: DataFrame | None = None, run_id: str | None = None, limit: int = 0, states: DataFrame | None = None,
                        retry_errors: bool = False, tile_size: int = 256) -> dict[str, DataFrame]:
    """Computes the visual features that are missing, of all parcels or of one run, and merges them into the stored ones.

    With the ``states`` of earlier jobs, ids that were skipped or failed with the same vertices are passed over, so a job that is
    run again goes on where the last one ended and computes nothing twice. Gives the merged ``features`` (rows without an
    error), the ``states`` to store, and the ``report``: requested, computed, skipped, errors, and missing ids left.
    """
    missing = missing_features(parcels, stored, links, run_id)
    wanted = still_open(missing, points, states, retry_errors)
    wanted = cut_lineage(wanted.orderBy("parcel_id").limit(limit) if limit > 0 else wanted)
    made = cut_lineage(visual_features(points.join(wanted, "parcel_id", "left_semi"), strips, zoom, image_source, tile_size))
    fresh = cut_lineage(job_states(wanted, points, made))
    features = upsert(stored, made.where("error IS NULL").select(*[c for c in made.columns if c in stored.columns]), ["parcel_id"], ["parcel_id"])
    after = fresh if states is None else upsert(states, fresh, ["parcel_id"], ["parcel_id"])
    left = missing.join(fresh.where("status = 'computed'"), "parcel_id", "left_anti")
    report = job_counters(fresh).join(left.agg(F.count("*").alias("missing_after")), F.lit(True))
    return {"features": features, "states": after, "report": report}


def rank_run(links: DataFrame, parcels: DataFrame, geometry_table: DataFrame | None, visual_table: DataFrame | None,
             run_id: str, gates: ranking.Gates = ranking.Gates(), weights: Weights = Weights(),
             limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked parcels of a run, or the ``limit`` best in order; funnel)."""
    rows = ranking.ranking_rows(links, parcels, geometry_table, visual_table, run_id)
    return ranking.rank_parcels(rows, gates, weights, limit), ranking.funnel(rows, gates, limit)


def presentation_bundle(runs: list[str], cells: DataFrame, features: DataFrame, parcels: DataFrame, points: DataFrame,
                        links: DataFrame, prices_table: DataFrame | None, geometry_table: DataFrame | None,
                        visual_table: DataFrame | None, limit: int = 0, scanned: int | None = None,
                        kept: int | None = None) -> dict[str, DataFrame]:
    """All tables of a map page of several runs.

    ``limit`` cells are shown (zero: all); the top candidates are the ``kept`` first boxes among the ``scanned`` best cells, or all.
    """
    shown = ranking.top_rows(cells, runs, limit)
    spots = presentation.points_of_runs(shown, features)
    return {
        "cells": shown,
        "points": spots,
        "parcels": presentation.map_parcels(parcels, points, links, runs, prices_table, geometry_table, visual_table),
        "categories": presentation.categories_union(shown, spots),
        "top_candidates": ranking.top_distinct_boxes(cells, runs, scanned, kept),
    }


def trail_boxes(ways: DataFrame, box: BBox, margin_km: float = 10.0, count: int = 20, size_km: float = 20.0,
                step_km: float = 7.0) -> dict[str, DataFrame]:
    """Boxes and sample points along a long easy trail inside the box."""
    edges = graph.edges_inside(graph.way_edges(filters.easy_trails(ways)), box, margin_km)
    segments = graph.path_segments(graph.long_path(edges))
    return {
        "segments": segments,
        "boxes": graph.path_boxes(segments, count, size_km, step_km),
        "route": graph.path_samples(segments),
    }
