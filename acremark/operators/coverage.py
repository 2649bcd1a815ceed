"""Sampling an area, finding the known parcel under each sample, and counting what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acremark.functions.geo import METRES_PER_DEGREE, metres_per_lon_degree
from acremark.functions.text import commune_matches
from acremark.operators.filters import BOUNDS, rejection_reason
from acremark.operators.geometry import points_in_polygons
from acremark.operators.ordering import numbered, sums_before
from acremark.operators.spatial import keys_touching, points_in_boxes
from acremark.session import cut_lineage


def sampling_lattice(boxes: DataFrame, step_m: float, key: str) -> DataFrame:
    """Cell centres of a lattice over each box, row by row; ``ordinal`` counts from 1.

    Rows of the lattice are spread over tasks before their points are made.
    """
    south, west, north, east = (F.col(b) for b in BOUNDS)
    lat_step = F.lit(step_m / METRES_PER_DEGREE)
    lon_step = F.lit(step_m) / metres_per_lon_degree((south + north) / 2.0, floor=1.0)
    sized = boxes.select(
        key, *BOUNDS,
        F.greatest(F.lit(1), F.ceil((north - south) / lat_step)).alias("rows"),
        F.greatest(F.lit(1), F.ceil((east - west) / lon_step)).alias("cols"),
    )
    lines = sized.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).repartition(key, "row")
    spots = lines.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    return spots.select(
        key, "row", (F.col("row") * F.col("cols") + F.col("col") + 1).alias("ordinal"),
        (west + (F.col("col") + 0.5) * (east - west) / F.col("cols")).alias("lon"),
        (south + (F.col("row") + 0.5) * (north - south) / F.col("rows")).alias("lat"),
    )


def judged_samples(boxes: DataFrame, key: str, step_m: float, parcels: DataFrame, points: DataFrame,
                   expected_commune: str | None = None, gates: dict | None = None) -> DataFrame:
    """Lattice points with the parcel under them and the verdict on it.

    ``outcome`` is uncovered, out_of_scope, rejected or found; ``reason`` names a rejection;
    ``uncovered_before`` counts the uncovered points that come earlier in the same box. The parcel is the one with the
    smallest id, unless an earlier point of the box has rejected another one that the point lies in: then that one counts.
    """
    # the boxes are few and used several times; they are found once
    boxes = cut_lineage(boxes.select(key, *BOUNDS))
    spots = sampling_lattice(boxes, step_m, key)
    facts = parcels.select("parcel_id", "commune", "area_m2", *BOUNDS)
    # outlines are built only for parcels whose box touches a sampled box, or has no known box
    unknown = F.lit(False)
    for bound in BOUNDS:
        unknown = unknown | F.col(bound).isNull()
    sides = ("bbox_min_lon", "bbox_min_lat", "bbox_max_lon", "bbox_max_lat")
    near = cut_lineage(keys_touching(facts, "parcel_id", sides, boxes, sides).union(facts.where(unknown).select("parcel_id")).distinct())
    # the verdict is per parcel, so it is made before the join, once for each that is near
    verdicts = _verdicts(facts.join(near, "parcel_id", "left_semi"), expected_commune, gates)
    hits = points_in_polygons(spots, points.join(near, "parcel_id", "left_semi"), [key, "ordinal"])
    hits = cut_lineage(hits.join(verdicts, "parcel_id"))
    firsts = hits.groupBy(key, "ordinal").agg(F.min(F.struct("parcel_id", "in_scope", "reason")).alias("_first"), F.count("*").alias("_hits"))
    rejected = _rejected_before(hits, firsts, key)
    judged = spots.join(firsts, [key, "ordinal"], "left").join(rejected, [key, "ordinal"], "left")
    taken = F.coalesce("_rejected", "_first")
    judged = judged.select(
        key, "row", "ordinal", "lon", "lat", taken["parcel_id"].alias("parcel_id"),
        F.when(taken["in_scope"].isNull(), "uncovered").when(~taken["in_scope"], "out_of_scope")
        .when(taken["reason"].isNotNull(), "rejected").otherwise("found").alias("outcome"),
        F.when(taken["in_scope"], taken["reason"]).alias("reason"),
    )
    missed = F.when(F.col("outcome") == "uncovered", 1).otherwise(0)
    # located once; the running count and all that follows read the verdicts
    judged = cut_lineage(judged)
    return sums_before(judged, [key], "row", [F.col("ordinal")], missed, "uncovered_before")


def _verdicts(facts: DataFrame, expected_commune: str | None, gates: dict | None) -> DataFrame:
    """(parcel_id, in_scope, reason); each commune's name is folded once."""
    reasons = facts.select("parcel_id", "commune", rejection_reason(**(gates or {})).alias("reason"))
    if not expected_commune:
        return reasons.select("parcel_id", F.lit(True).alias("in_scope"), "reason")
    names = reasons.select("commune").distinct()
    folded = names.withColumn("in_scope", commune_matches(F.col("commune"), expected_commune))
    same = reasons["commune"].eqNullSafe(folded["commune"])
    return reasons.join(folded, same).select("parcel_id", F.coalesce("in_scope", F.lit(False)).alias("in_scope"), "reason")


def _rejected_before(hits: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, _rejected) of the points inside a parcel that an earlier point of the box has rejected.

    A point rejects its first parcel unless it lies in one that is rejected already. What each point does depends on earlier
    ones only, so repeating from "every point rejects" settles, in as many rounds as outlines overlap in a chain.
    """
    bad = hits.where(F.col("in_scope") & F.col("reason").isNotNull())
    makes = firsts.where(F.col("_first.in_scope") & F.col("_first.reason").isNotNull()).select(key, "ordinal", F.col("_first.parcel_id").alias("parcel_id"))
    since = cut_lineage(makes.groupBy(key, "parcel_id").agg(F.min("ordinal").alias("_since")))
    while True:
        inside = bad.join(since, [key, "parcel_id"]).where("_since < ordinal")
        rejected = inside.groupBy(key, "ordinal").agg(F.min(F.struct("parcel_id", "in_scope", "reason")).alias("_rejected"))
        left = makes.join(rejected, [key, "ordinal"], "left_anti").groupBy(key, "parcel_id").agg(F.min("ordinal").alias("_now"))
        both = cut_lineage(since.join(left, [key, "parcel_id"], "full"))
        if both.where(~F.col("_since").eqNullSafe(F.col("_now"))).isEmpty():
            return rejected
        since = both.where("_now IS NOT NULL").select(key, "parcel_id", F.col("_now").alias("_since"))


def within_budget(samples: DataFrame, max_requests: int) -> DataFrame:
    """Points reached before the budget of uncovered points is used up; zero means no limit."""
    return samples.where(F.col("uncovered_before") < max_requests) if max_requests else samples


def coverage_counts(samples: DataFrame, key: str) -> DataFrame:
    """Counters per box. A rejected parcel counts once; its further points count as skipped."""
    per_parcel = samples.groupBy(key, "outcome", "parcel_id").agg(F.count("*").alias("n"), F.first("reason").alias("reason"))

    def points(outcome: str):
        return F.sum(F.when(F.col("outcome") == outcome, F.col("n")).otherwise(0))

    def parcels(outcome: str):
        return F.count_if(F.col("outcome") == outcome)

    return per_parcel.groupBy(key).agg(
        F.sum("n").alias("processed_points"),
        points("uncovered").alias("uncovered"),
        (points("out_of_scope") + points("found") + parcels("rejected")).alias("skipped_existing"),
        points("out_of_scope").alias("out_of_scope"),
        parcels("rejected").alias("rejected"),
        (points("rejected") - parcels("rejected")).alias("skipped_rejected_polygon"),
        parcels("found").alias("found_parcels"),
    )


def rejection_histogram(samples: DataFrame, key: str) -> DataFrame:
    return (
        samples.where("outcome = 'rejected'").select(key, "parcel_id", "reason").distinct()
        .groupBy(key, "reason").agg(F.count("*").alias("parcels"))
    )


def uncovered_points(samples: DataFrame, key: str) -> DataFrame:
    """What a fetcher should ask for."""
    return samples.where("outcome = 'uncovered'").select(key, "ordinal", "lon", "lat")


def parcels_in_boxes(parcels: DataFrame, boxes: DataFrame, order: str, limit: int | None = None,
                     expected_commune: str | None = None, strict: bool = False) -> DataFrame:
    """Parcels whose centroid lies in any box, each taken by the first box in order; ``limit`` in all, or every one."""
    from acremark.operators.filters import commune_is

    scoped = parcels.where(commune_is(F.col("commune"), expected_commune, strict))
    located = scoped.select("parcel_id", "centroid_lon", "centroid_lat")
    bounds = {"bbox_min_lon": "c_min_lon", "bbox_min_lat": "c_min_lat", "bbox_max_lon": "c_max_lon", "bbox_max_lat": "c_max_lat"}
    frames = boxes.select(order, *[F.col(b).alias(n) for b, n in bounds.items()])
    pairs = points_in_boxes(located, frames, "centroid_lon", "centroid_lat",
                            ("c_min_lon", "c_min_lat", "c_max_lon", "c_max_lat"))
    firsts = pairs.groupBy("parcel_id").agg(F.min(order).alias(order))
    if limit is None:
        return numbered(firsts, [F.col(order), F.col("parcel_id")], "ordinal").join(scoped, "parcel_id")
    taken = firsts.orderBy(order, "parcel_id").limit(limit)
    ordinal = F.row_number().over(Window.orderBy(order, "parcel_id"))  # at most ``limit`` rows
    return taken.withColumn("ordinal", ordinal).join(scoped, "parcel_id")
