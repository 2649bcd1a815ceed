"""Candidate selection, parcel ranking, and the step-by-step funnel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.functions.scoring import Weights, simple_score, weighted_score
from acremark.functions.text import map_link, nonzero
from acremark.operators.filters import BOUNDS, not_in_categories, ranking_area, shape_gate, visual_gate
from acremark.operators.ordering import first_per_key, numbered

GEOMETRY_COLUMNS = ["compactness", "elongation_ratio", "principal_moment_min_m4", "principal_moment_max_m4"]
VISUAL_COLUMNS = ["green_pixel_ratio", "dark_pixel_ratio", "bright_pixel_ratio", "low_saturation_ratio", "brightness_mean"]


@dataclass(frozen=True)
class Gates:
    """Limits of the ranking; zero switches a gate off."""

    min_area_m2: float = 0.0
    max_area_m2: float = 1_000_000_000.0
    min_compactness: float = 0.0
    max_elongation: float = 0.0
    require_visual: bool = False
    min_green_pixel_ratio: float = 0.0
    max_bright_pixel_ratio: float = 0.0
    max_low_saturation_ratio: float = 0.0
    max_brightness_mean: float = 0.0


def ranked_candidates(cells: DataFrame, run_id: str, limit: int | None = None, excluded: list[str] = ()) -> DataFrame:
    """Best cells of a run, one per exact box, numbered from 1; all of them without a limit. Exclusion comes before all else."""
    usable = cells.where((F.col("run_id") == run_id) & not_in_categories(F.col("category"), list(excluded)))
    distinct = first_per_key(usable, list(BOUNDS), [F.desc("score"), F.col("cell_id")])
    if limit is None:
        return numbered(distinct, [F.desc("score"), F.col("cell_id")], "candidate_index").withColumn("candidate_index", F.col("candidate_index").cast("int"))
    top = distinct.orderBy(F.desc("score"), "cell_id").limit(limit)
    # at most ``limit`` rows reach this window
    return top.withColumn("candidate_index", F.row_number().over(Window.orderBy(F.desc("score"), "cell_id")))


def top_distinct_boxes(cells: DataFrame, runs: list[str], scan: int | None = None,
                       keep: int | None = None) -> DataFrame:
    """The first cell of each box; among the ``scan`` best cells and at most ``keep`` where given."""
    order = [F.desc("score"), F.col("run_id"), F.col("cell_id")]
    best = cells.where(F.col("run_id").isin(list(runs)))
    best = best if scan is None else best.orderBy(*order).limit(scan)
    first = first_per_key(best, list(BOUNDS), order)
    return first if keep is None else first.orderBy(*order).limit(keep)


def top_rows(cells: DataFrame, runs: list[str], limit: int) -> DataFrame:
    """Cells of several runs by score; a limit of zero means all of them."""
    ordered = cells.where(F.col("run_id").isin(list(runs))).orderBy(F.desc("score"), "run_id", "cell_id")
    return ordered.limit(limit) if limit > 0 else ordered


def optional_columns(frame: DataFrame, other: DataFrame | None, columns: dict[str, str]) -> DataFrame:
    """Left join on parcel_id; an absent table gives null columns."""
    if other is None:
        return frame.select("*", *[F.lit(None).cast("double").alias(name) for name in columns.values()])
    return frame.join(other.select("parcel_id", *[F.col(c).alias(n) for c, n in columns.items()]), "parcel_id", "left")


def linked_parcels(links: DataFrame, parcels: DataFrame, run_id: str) -> DataFrame:
    own = links.where(F.col("run_id") == run_id).select("parcel_id", "candidate_index", "source_bbox")
    return own.join(parcels, "parcel_id")


def ranking_rows(links: DataFrame, parcels: DataFrame, geometry: DataFrame | None, visual: DataFrame | None,
                 run_id: str) -> DataFrame:
    base = linked_parcels(links, parcels.withColumnRenamed("area_m2", "parcel_area_m2"), run_id)
    shaped = optional_columns(base, geometry, {"area_m2": "geometry_area_m2", **{c: c for c in GEOMETRY_COLUMNS}})
    return optional_columns(shaped, visual, {c: c for c in VISUAL_COLUMNS})


def _steps(gates: Gates) -> list[tuple[str, Column]]:
    area = ranking_area()
    return [
        ("with_geometry_features", F.col("geometry_area_m2").isNotNull()),
        (f"area_{gates.min_area_m2:g}_{gates.max_area_m2:g}", area.between(gates.min_area_m2, gates.max_area_m2)),
        ("geometry_shape_filter", shape_gate(gates.min_compactness, gates.max_elongation)),
        (
            "with_visual_features" if gates.require_visual else "visual_not_required",
            F.col("green_pixel_ratio").isNotNull() if gates.require_visual else F.lit(True),
        ),
        (
            "visual_land_filter",
            visual_gate(gates.min_green_pixel_ratio, gates.max_bright_pixel_ratio, gates.max_low_saturation_ratio,
                        gates.max_brightness_mean),
        ),
    ]


def _last_link(rows: DataFrame) -> DataFrame:
    """A parcel linked twice counts once, as its last link."""
    return first_per_key(rows, ["parcel_id"], [F.desc("candidate_index")])


def rank_parcels(rows: DataFrame, gates: Gates = Gates(), weights: Weights = Weights(), limit: int | None = None) -> DataFrame:
    """Parcels that pass all gates with their weighted score: all, or the ``limit`` best in order."""
    passed = _last_link(rows)
    for _, test in _steps(gates):
        passed = passed.where(test)
    sized = passed.withColumn("area_m2", ranking_area())
    score = weighted_score(*[F.col(c) for c in ("area_m2", "compactness", "elongation_ratio", "green_pixel_ratio",
                                                "dark_pixel_ratio", "bright_pixel_ratio")], weights)
    four = ["compactness", "elongation_ratio", "green_pixel_ratio", "dark_pixel_ratio", "bright_pixel_ratio",
            "low_saturation_ratio"]
    box = {n: F.col(b) for n, b in zip(("min_lat", "min_lon", "max_lat", "max_lon"), BOUNDS)}
    ranked = (
        sized.select(
            "parcel_id",
            F.round(score, 4).alias("score"),
            F.round("area_m2", 1).alias("area_m2"),
            "commune", "county", "voivodeship",
            *[F.round(c, 4).alias(c) for c in four],
            map_link(F.col("centroid_lat"), F.col("centroid_lon"), box).alias("map_link"),
        )
    )
    return ranked if limit is None else ranked.orderBy(F.desc("score"), "parcel_id").limit(limit)


def funnel(rows: DataFrame, gates: Gates = Gates(), limit: int | None = None) -> DataFrame:
    """Survivors after each step, all counted in one pass: (position, step, count)."""
    total = rows.agg(F.count("*").alias("n"))
    steps = _steps(gates)
    passed = F.lit(True)
    counts = [F.count("*").alias("c1")]
    for i, (_, test) in enumerate(steps, start=2):
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(f"c{i}"))
    one = _last_link(rows).agg(*counts)
    last = f"c{len(steps) + 1}"
    names = ["deduped_parcels", *[name for name, _ in steps]]
    labelled = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"), F.col(f"c{i}").alias("count"))
        for i, name in enumerate(names, start=1)
    ]
    first = F.struct(F.lit(0).alias("position"), F.lit("layer2_parcels").alias("step"), total.scalar().alias("count"))
    final = F.struct(
        F.lit(len(names) + 1).alias("position"), F.lit("all" if limit is None else f"top_{limit}").alias("step"),
        (F.col(last) if limit is None else F.least(F.lit(limit).cast("long"), F.col(last))).alias("count"),
    )
    return one.select(F.inline(F.array(first, *labelled, final)))


def simple_ranking(candidates: DataFrame, geometry: DataFrame, limit: int, ordinal: str = "ordinal") -> DataFrame:
    """Area, compactness and low elongation added up; equal scores keep the input order."""
    joined = candidates.join(
        geometry.select("parcel_id", F.col("area_m2").alias("_area"), "compactness", "elongation_ratio"), "parcel_id", "left"
    ).withColumn("area_m2", F.coalesce(nonzero(F.col("area_m2")), F.col("_area"), F.lit(0.0)))
    score = F.round(simple_score(F.col("area_m2"), F.col("compactness"), F.col("elongation_ratio")), 6)
    return (
        joined.drop("_area").withColumn("score", score).orderBy(F.desc("score"), ordinal, "parcel_id").limit(limit)
    )
