"""Hotspot detection: uniform grid, kernel mesh, adaptive quadtree, and the two ordered thinnings."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.functions.geo import METRES_PER_DEGREE, bbox_area_m2, metres_per_lon_degree, overlap_area_m2, overlap_ratio
from acremark.functions.scoring import density_score
from acremark.operators.spatial import overlapping_boxes
from acremark.operators.ordering import numbered
from acremark.session import cut_lineage


def uniform_grid(features: DataFrame, box: BBox, n: int, limit: int, lat: str = "center_lat",
                 lon: str = "center_lon") -> DataFrame:
    """Counts on an n x n grid over the box, largest first, ties by cell."""

    def slot(value: str, lo: float, hi: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(value) - lo) / (hi - lo) * n))).cast("int")

    def edge(lo: float, hi: float, index: Column) -> Column:
        return F.lit(lo) + F.lit(hi - lo) * index / n

    counts = features.groupBy(
        slot(lon, box.min_lon, box.max_lon).alias("x"), slot(lat, box.min_lat, box.max_lat).alias("y")
    ).agg(F.count("*").alias("score"))
    top = counts.orderBy(F.desc("score"), "x", "y").limit(limit)
    x, y = F.col("x"), F.col("y")
    placed = top.select(
        F.concat_ws("_", F.lit("osm"), x, y).alias("candidate_id"),
        "x", "y", "score",
        F.col("score").alias("source_count"),
        edge(box.min_lon, box.max_lon, x).alias("bbox_min_lon"),
        edge(box.min_lat, box.max_lat, y).alias("bbox_min_lat"),
        edge(box.min_lon, box.max_lon, x + 1).alias("bbox_max_lon"),
        edge(box.min_lat, box.max_lat, y + 1).alias("bbox_max_lat"),
    )
    return placed.select(
        "*",
        ((F.col("bbox_min_lon") + F.col("bbox_max_lon")) / 2).alias("center_lon"),
        ((F.col("bbox_min_lat") + F.col("bbox_max_lat")) / 2).alias("center_lat"),
    )


# --- Triangular kernel-density mesh -------------------------------------------------------


def mesh_rows(box: BBox, nx: int) -> int:
    width = (box.max_lon - box.min_lon) * max(METRES_PER_DEGREE * math.cos(math.radians(box.mid_lat)), 1e-6)
    height = (box.max_lat - box.min_lat) * METRES_PER_DEGREE
    return max(4, round(nx * height / max(width, 1.0)))


# Corners of the two triangles of a quad, as (row offset, column offset).
TRIANGLES = (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))


def kernel_mesh(points: DataFrame, box: BBox, nx: int = 28, kernel_m: float = 450.0, min_norm: float = 0.0,
                lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Sum of a Gaussian over all points of a category at the centre of every mesh triangle.

    The Gaussian separates into a latitude and a longitude factor, so a batch of points adds to a
    whole mesh by one matrix product. Every task keeps one mesh per category, whose size depends on
    the mesh and not on the data, and sends it on once; the shuffle only adds meshes up. No
    point-triangle pairs are ever made, and no category is gathered anywhere.
    """
    ny = mesh_rows(box, nx)
    sy = METRES_PER_DEGREE / kernel_m
    sx = max(METRES_PER_DEGREE * math.cos(math.radians(box.mid_lat)), 1e-6) / kernel_m
    lat_lines = np.array([box.min_lat + (box.max_lat - box.min_lat) * y / ny for y in range(ny + 1)])
    lon_lines = np.array([box.min_lon + (box.max_lon - box.min_lon) * x / nx for x in range(nx + 1)])
    rows, cols = np.arange(ny), np.arange(nx)
    centres = [
        (sum(lat_lines[rows + dy] for dy, _ in t) / 3.0, sum(lon_lines[cols + dx] for _, dx in t) / 3.0)
        for t in TRIANGLES
    ]

    def add_up(batches):
        meshes: dict[tuple, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for key, part in batch.groupby(["category", "tag_key", "tag_value"], dropna=False, sort=False):
                plat, plon = part["_lat"].to_numpy(), part["_lon"].to_numpy()
                total, seen = meshes.get(key, (np.zeros((2, ny, nx)), 0))
                for t, (clat, clon) in enumerate(centres):
                    down = np.exp(-0.5 * ((plat[:, None] - clat[None, :]) * sy) ** 2)
                    across = np.exp(-0.5 * ((plon[:, None] - clon[None, :]) * sx) ** 2)
                    total[t] += down.T @ across
                meshes[key] = (total, seen + len(part))
        t, y, x = (a.ravel() for a in np.indices((2, ny, nx)))
        for (category, tag_key, tag_value), (total, seen) in meshes.items():
            yield pd.DataFrame(
                {"category": category, "tag_key": tag_key, "tag_value": tag_value,
                 "t": t, "y": y, "x": x, "score": total.ravel(), "points": seen}
            )

    partial = points.select(
        "category", "tag_key", "tag_value", F.col(lat).alias("_lat"), F.col(lon).alias("_lon")
    ).mapInPandas(
        add_up, "category string, tag_key string, tag_value string, t int, y int, x int, score double, points long"
    )
    summed = partial.groupBy("category", "tag_key", "tag_value", "t", "y", "x").agg(
        F.sum("score").alias("score"), F.sum("points").alias("source_point_count")
    )
    top = F.max("score").over(Window.partitionBy("category"))
    normed = summed.withColumn("norm", F.when(top != 0, F.col("score") / top).otherwise(F.lit(0.0)))

    def corner(axis: str, step: int) -> Column:
        lo, hi, n = (box.min_lat, box.max_lat, ny) if axis == "y" else (box.min_lon, box.max_lon, nx)
        return F.lit(lo) + F.lit(hi - lo) * (F.col(axis) + step) / n

    def pick(values: list[Column]) -> Column:
        return F.when(F.col("t") == 0, values[0]).otherwise(values[1])

    lats = [[corner("y", dy) for dy, _ in t] for t in TRIANGLES]
    lons = [[corner("x", dx) for _, dx in t] for t in TRIANGLES]
    ring = [
        F.array(*[F.array(lons[i][j], lats[i][j]) for j in (0, 1, 2, 0)]) for i in (0, 1)
    ]
    return normed.where(F.col("norm") >= min_norm).select(
        "category", "tag_key", "tag_value", "t", "y", "x", "score", "norm", "source_point_count",
        pick([(v[0] + v[1] + v[2]) / 3.0 for v in lats]).alias("center_lat"),
        pick([(v[0] + v[1] + v[2]) / 3.0 for v in lons]).alias("center_lon"),
        corner("y", 0).alias("bbox_min_lat"), corner("x", 0).alias("bbox_min_lon"),
        corner("y", 1).alias("bbox_max_lat"), corner("x", 1).alias("bbox_max_lon"),
        pick(ring).alias("ring"),
    )


def number_cells(cells: DataFrame, run_id: str, tie_break: list[str]) -> DataFrame:
    """``cell_id`` = run and five-digit rank by score."""
    ranked = numbered(cells, [F.desc("score"), *map(F.col, tie_break)], "_rank")
    rank = F.col("_rank").cast("string")
    digits = F.when(F.length(rank) < 5, F.lpad(rank, 5, "0")).otherwise(rank)
    return ranked.withColumn("cell_id", F.concat(F.lit(run_id + "_"), digits)).withColumn("run_id", F.lit(run_id)).drop("_rank")


def normalise_by_max(cells: DataFrame, score: str, group: list[str]) -> DataFrame:
    top = F.max(score).over(Window.partitionBy(*group)) if group else cells.agg(F.max(score)).scalar()
    return cells.withColumn("norm", F.when(top != 0, F.col(score) / top).otherwise(F.lit(0.0)))


# --- Adaptive quadtree --------------------------------------------------------------------


@dataclass(frozen=True)
class QuadtreeConfig:
    """Fixed default values of the adaptive grid."""

    min_cell_m: float = 100.0
    max_depth: int = 6
    min_points: int = 3
    min_area_m2: float = 10_000.0
    max_area_m2: float = 3_000_000.0
    hotspot_percentile: float = 0.75
    dedupe_radius_m: float = 25.0
    max_overlap_ratio: float = 0.7

    def override(self, **values) -> "QuadtreeConfig":
        return replace(self, **values)


def _setting(name: str, default: QuadtreeConfig, per_category: dict[str, QuadtreeConfig]) -> Column:
    value = F.lit(getattr(default, name))
    for category, config in per_category.items():
        value = F.when(F.col("category") == category, F.lit(getattr(config, name))).otherwise(value)
    return value


def _halves(value: Column, parents: Column) -> Column:
    """The halves of the given intervals that hold the value, both at a shared edge."""

    def split(p: Column) -> Column:
        mid = (p["lo"] + p["hi"]) / 2.0
        low = F.struct((p["i"] * 2).alias("i"), p["lo"].alias("lo"), mid.alias("hi"))
        high = F.struct((p["i"] * 2 + 1).alias("i"), mid.alias("lo"), p["hi"].alias("hi"))
        return F.filter(F.array(low, high), lambda h: (h["lo"] <= value) & (value <= h["hi"]))

    return F.flatten(F.transform(parents, split))


def _axis_paths(points: DataFrame, column: str, lo: float, hi: float, depth: int, name: str) -> DataFrame:
    """For each depth, the intervals of an axis that hold the value (bounds by repeated halving)."""
    root = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))
    out = points.withColumn(f"{name}0", root)
    for d in range(1, depth + 1):
        out = out.withColumn(f"{name}{d}", _halves(F.col(column), F.col(f"{name}{d - 1}")))
    return out


def quadtree_members(points: DataFrame, box: BBox, depth: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with every quadtree cell that holds them, one row per (point, cell), depth 0 to ``depth``."""
    paths = _axis_paths(points, lat, box.min_lat, box.max_lat, depth, "_y")
    paths = _axis_paths(paths, lon, box.min_lon, box.max_lon, depth, "_x")

    def cells(d: int) -> Column:
        def row(y: Column) -> Column:
            return F.transform(f"_x{d}", lambda x: F.struct(
                F.lit(d).alias("depth"), y["i"].alias("iy"), x["i"].alias("ix"),
                y["lo"].alias("min_lat"), x["lo"].alias("min_lon"),
                y["hi"].alias("max_lat"), x["hi"].alias("max_lon"),
            ))

        return F.flatten(F.transform(f"_y{d}", row))

    every = F.concat(*[cells(d) for d in range(depth + 1)])
    return paths.select(*points.columns, F.inline(every))


CELL = ["category", "depth", "iy", "ix"]


def quadtree_cells(points: DataFrame, box: BBox, default: QuadtreeConfig = QuadtreeConfig(),
                   per_category: dict[str, QuadtreeConfig] | None = None, lat: str = "lat",
                   lon: str = "lon") -> DataFrame:
    """Every cell the adaptive split visits, with count, area, density and score.

    One pass puts each point into its cells at all depths and counts them with partial aggregation.
    A cell is visited if it is the root or its parent may be split; a parent that may be split
    implies the same for all its ancestors, so one semi-join decides.
    """
    per_category = per_category or {}
    depth = max([default.max_depth, *[c.max_depth for c in per_category.values()]])
    # the points are gone through once; what is kept is a table of cells
    counted = cut_lineage(
        quadtree_members(points.select("category", "tag_key", "tag_value", lat, lon), box, depth, lat, lon)
        .groupBy(*CELL, "tag_key", "tag_value")
        .agg(F.count("*").alias("point_count"),
             *[F.min(c).alias(f"bbox_{c}") for c in ("min_lat", "min_lon", "max_lat", "max_lon")])
    )
    bounds = [F.col(f"bbox_{c}") for c in ("min_lat", "min_lon", "max_lat", "max_lon")]
    south, west, north, east = bounds
    side = F.least((north - south) * METRES_PER_DEGREE,
                   (east - west) * metres_per_lon_degree((south + north) / 2.0))
    sized = counted.withColumn("area_m2", bbox_area_m2(*bounds)).withColumn("side_m", side)
    density = F.when(F.col("area_m2") > 0, F.col("point_count") / (F.col("area_m2") / 1_000_000.0)).otherwise(F.lit(0.0))
    scored = sized.withColumn("density_per_km2", density).withColumn(
        "score", density_score(F.col("point_count"), F.col("density_per_km2"))
    )
    may_split = (
        (F.col("depth") < _setting("max_depth", default, per_category))
        & (F.col("side_m") >= _setting("min_cell_m", default, per_category))
        & (F.col("point_count") >= _setting("min_points", default, per_category))
    )
    parents = scored.where(may_split).select(
        F.col("category").alias("p_category"), (F.col("depth") + 1).alias("p_depth"),
        F.col("iy").alias("p_iy"), F.col("ix").alias("p_ix"),
    )
    below = scored.where("depth > 0").join(
        parents,
        (F.col("category") == F.col("p_category")) & (F.col("depth") == F.col("p_depth"))
        & (F.floor(F.col("iy") / 2) == F.col("p_iy")) & (F.floor(F.col("ix") / 2) == F.col("p_ix")),
        "left_semi",
    )
    return scored.where("depth = 0").unionByName(below).drop("side_m")


def nearest_rank(cells: DataFrame, value: str, group: list[str], p: Column, name: str) -> DataFrame:
    """Value at position floor((n - 1) p) of each group in ascending order.

    For cell tables: a group has at most 4^depth cells, whatever the number of points.
    """
    ranked = cells.select(
        *group, value, p.alias("_p"),
        F.row_number().over(Window.partitionBy(*group).orderBy(value)).alias("_rn"),
        F.count("*").over(Window.partitionBy(*group)).alias("_n"),
    )
    at = F.col("_rn") - 1 == F.floor((F.col("_n") - 1) * F.col("_p"))
    return ranked.where(at).select(*group, F.col(value).alias(name))


def quadtree_hotspots(points: DataFrame, box: BBox, default: QuadtreeConfig = QuadtreeConfig(),
                      per_category: dict[str, QuadtreeConfig] | None = None, lat: str = "lat",
                      lon: str = "lon") -> DataFrame:
    """Visited cells that are big enough, small enough and dense enough, numbered per category."""
    per_category = per_category or {}
    cells = quadtree_cells(points, box, default, per_category, lat, lon)
    limit = nearest_rank(cells, "density_per_km2", ["category"],
                         _setting("hotspot_percentile", default, per_category), "threshold")
    kept = cells.join(limit, "category").where(
        (F.col("point_count") >= _setting("min_points", default, per_category))
        & (F.col("area_m2") >= _setting("min_area_m2", default, per_category))
        & (F.col("area_m2") <= _setting("max_area_m2", default, per_category))
        & (F.col("density_per_km2") >= F.col("threshold"))
    )
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "depth", "iy", "ix"))
    digits = F.when(rank < 10_000, F.lpad(rank.cast("string"), 4, "0")).otherwise(rank.cast("string"))
    return kept.withColumn("id", F.concat_ws("_", "category", digits)).drop("threshold")


# --- Ordered greedy thinning --------------------------------------------------------------


def thin_by_radius(points: DataFrame, order: list[str], group: list[str], radius_m, mid_lat: float,
                   lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Keep a point unless it lies within the radius of an earlier kept point of its group.

    Gives exactly what going through the points one by one in ``order`` gives. ``radius_m`` is a
    number or a Column that is constant within a group; zero or less keeps everything.

    Copies at one position are first cut to the earliest, which decides for all of them. Then, on
    cells so small that two points of a cell are always within the radius, only the earliest open
    point of a cell can be kept next, and no cell ever keeps two. So a round compares an open point
    with one candidate and one kept point per small cell around it, some dozens at most, however
    crowded a place is.
    """
    radius = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    columns = points.columns
    rank = F.struct(*order)
    off = points.where(radius <= 0)
    spots = (
        points.where(radius > 0)
        .withColumn("_radius", radius)
        .withColumn("_x", F.col(lon) * metres_per_lon_degree(mid_lat))
        .withColumn("_y", F.col(lat) * METRES_PER_DEGREE)
    )
    # earliest copy per exact position: a partial aggregate, not a sort of the copies
    firsts = spots.groupBy(*group, lat, lon).agg(
        F.min(rank).alias("_rank"), F.first("_radius").alias("_radius"), F.first("_x").alias("_x"), F.first("_y").alias("_y")
    )
    side = F.col("_radius") / math.sqrt(2.0)
    spot = ["_rank", "_x", "_y"]
    cell, block = [*group, "_cx", "_cy"], [*group, "_bx", "_by"]
    open_points = cut_lineage(
        firsts.select(
            *group, *spot, "_radius",
            F.floor(F.col("_x") / side).alias("_cx"), F.floor(F.col("_y") / side).alias("_cy"),
            F.floor(F.col("_x") / F.col("_radius")).alias("_bx"), F.floor(F.col("_y") / F.col("_radius")).alias("_by"),
        )
    )

    def around(seeds: DataFrame) -> DataFrame:
        """The seeds in each of the nine blocks (of the radius' size) that they can reach."""
        steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
        east = F.explode(F.transform(steps, lambda d: F.col("_bx") + d))
        north = F.explode(F.transform(steps, lambda d: F.col("_by") + d))
        named = seeds.select(*group, *[F.col(c).alias(f"s{c}") for c in spot], "_bx", "_by")
        return named.withColumn("_bx", east).withColumn("_by", north)

    dx, dy = F.col("s_x") - F.col("_x"), F.col("s_y") - F.col("_y")
    close = F.sqrt(dx * dx + dy * dy) <= F.col("_radius")

    def reached(left: DataFrame, seeds: DataFrame, test: Column, how: str) -> DataFrame:
        right = around(seeds).withColumnsRenamed({c: f"s_{c}" for c in block})
        same = [F.col(c) == F.col(f"s_{c}") for c in block]
        return left.join(right, [*same, test], how)

    kept_parts: list[DataFrame] = []
    while True:
        candidates = open_points.groupBy(*cell).agg(
            F.min_by(F.struct(*spot, "_bx", "_by"), "_rank").alias("_s")
        ).select(*group, "_s.*")
        earlier = reached(open_points, candidates, close & (F.col("_rank") < F.col("s_rank")), "inner")
        blocked = earlier.select(*group, F.col("s_rank").alias("_rank")).distinct()
        kept = cut_lineage(candidates.join(blocked, [*group, "_rank"], "left_anti"))
        kept_parts.append(kept)
        open_points = cut_lineage(reached(open_points, kept, close, "left_anti"))
        if open_points.isEmpty():
            break
    winners = kept_parts[0].select(*group, "_rank")
    for part in kept_parts[1:]:
        winners = winners.unionByName(part.select(*group, "_rank"))
    survivors = points.where(radius > 0).withColumn("_rank", rank).join(winners, [*group, "_rank"], "left_semi")
    return survivors.select(*columns).unionByName(off)


def suppress_overlaps(cells: DataFrame, max_ratio, key: str = "id",
                      bounds: tuple[str, str, str, str] = ("bbox_min_lat", "bbox_min_lon", "bbox_max_lat", "bbox_max_lon"),
                      ) -> DataFrame:
    """Go through cells by falling score (ties by key); drop one that overlaps a kept one too much.

    Overlap is the shared area over the smaller area, within a category. Same rounds as above on the
    table of overlapping pairs.
    """
    limit = max_ratio if isinstance(max_ratio, Column) else F.lit(float(max_ratio))
    south, west, north, east = bounds
    boxes = cells.select(key, "category", "score", "area_m2", *bounds, limit.alias("_limit"))
    pairs = overlapping_boxes(boxes, key, (west, south, east, north), ["category"])

    def side(p: str) -> dict[str, Column]:
        return {n: F.col(f"{p}_{b}") for n, b in zip(("min_lat", "min_lon", "max_lat", "max_lon"), bounds)}

    shared = overlap_area_m2(side("a"), side("b"))
    ratio = overlap_ratio(shared, F.col("a_area_m2"), F.col("b_area_m2"))
    a_first = (F.col("a_score") > F.col("b_score")) | (
        (F.col("a_score") == F.col("b_score")) & (F.col(f"a_{key}") < F.col(f"b_{key}"))
    )
    conflicts = cut_lineage(
        pairs.where((shared > 0) & (ratio > F.col("a__limit"))).select(
            F.when(a_first, F.col(f"a_{key}")).otherwise(F.col(f"b_{key}")).alias("first"),
            F.when(a_first, F.col(f"b_{key}")).otherwise(F.col(f"a_{key}")).alias("second"),
        )
    )
    dropped: DataFrame | None = None
    open_pairs = conflicts
    while not open_pairs.isEmpty():
        # "first" cells that nobody open precedes are kept; whatever they precede is dropped
        losers = open_pairs.select(F.col("second").alias("first")).distinct()
        winners = open_pairs.select("first").distinct().join(losers, "first", "left_anti")
        gone = cut_lineage(open_pairs.join(winners, "first", "left_semi").select(F.col("second").alias(key)).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        left = open_pairs.join(gone.withColumnRenamed(key, "second"), "second", "left_anti").join(
            gone.withColumnRenamed(key, "first"), "first", "left_anti"
        )
        open_pairs = cut_lineage(left.select("first", "second"))
    return cells if dropped is None else cells.join(dropped, key, "left_anti")
