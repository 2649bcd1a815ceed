"""Spatial joins as equi-joins on grid cells, exact for boxes of any size.

Spark plans ``x BETWEEN lo AND hi`` as a nested-loop product. Here every box picks a grid whose
cells are at least as large as the box, so it lies in at most four cells; points are put into one
cell of each grid size that some box uses. Both sides then meet by key (sort-merge or hash join,
split by AQE where a cell is hot) and the exact predicate is tested on the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acremark.session import cut_lineage

BASE_DEGREES = 1e-4  # smallest cell, about 10 m
GROWTH = 4.0  # cell size ratio between neighbouring grids

KEYS = ["_level", "_cell_x", "_cell_y"]


def _level(width: Column, height: Column, base: float) -> Column:
    extent = F.greatest(width, height)
    steps = F.ceil(F.log(F.greatest(extent, F.lit(base)) / base) / F.log(F.lit(GROWTH)))
    return F.greatest(F.lit(0), steps).cast("int")


def _cell_size(level: Column, base: float) -> Column:
    return F.pow(F.lit(GROWTH), level.cast("double")) * base


def _span(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def box_level(min_x: str, min_y: str, max_x: str, max_y: str, base: float = BASE_DEGREES) -> Column:
    """The grid whose cells are at least as large as the box."""
    return _level(F.col(max_x) - F.col(min_x), F.col(max_y) - F.col(min_y), base)


def boxes_on_grid(boxes: DataFrame, min_x: str, min_y: str, max_x: str, max_y: str,
                  base: float = BASE_DEGREES) -> DataFrame:
    """One row per cell that the box touches on its grid (at most four).

    Boxes that already carry ``_level`` keep it; it must not be below their own.
    """
    known = boxes.where(F.col(min_x).isNotNull() & F.col(min_y).isNotNull()
                        & F.col(max_x).isNotNull() & F.col(max_y).isNotNull())
    levelled = known if "_level" in boxes.columns else known.withColumn("_level", box_level(min_x, min_y, max_x, max_y, base))
    size = _cell_size(F.col("_level"), base)
    return levelled.withColumn("_cell_x", F.explode(_span(F.col(min_x), F.col(max_x), size))).withColumn(
        "_cell_y", F.explode(_span(F.col(min_y), F.col(max_y), size))
    )


def grid_levels(levelled_boxes: DataFrame) -> Column:
    """Grid sizes in use, about a dozen numbers at most, as a scalar subquery."""
    return levelled_boxes.agg(F.array_sort(F.collect_set("_level")).alias("levels")).scalar()


def points_on_grid(points: DataFrame, x: str, y: str, levels: Column, base: float = BASE_DEGREES) -> DataFrame:
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    each = known.withColumn("_level", F.explode(levels))
    size = _cell_size(F.col("_level"), base)
    return each.withColumn("_cell_x", F.floor(F.col(x) / size)).withColumn("_cell_y", F.floor(F.col(y) / size))


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str,
                    bounds: tuple[str, str, str, str], base: float = BASE_DEGREES,
                    levels: Column | None = None) -> DataFrame:
    """Every (point, box) pair with the point inside the box, edges included.

    ``bounds`` names (min_x, min_y, max_x, max_y). A pair meets in exactly one cell, so no
    duplicates arise. Column names of the two sides must differ. ``levels`` may name the grids in
    use where the caller can tell them more cheaply than from the boxes.
    """
    min_x, min_y, max_x, max_y = bounds
    right = boxes_on_grid(boxes, min_x, min_y, max_x, max_y, base)
    left = points_on_grid(points, x, y, grid_levels(right) if levels is None else levels, base)
    inside = F.col(x).between(F.col(min_x), F.col(max_x)) & F.col(y).between(F.col(min_y), F.col(max_y))
    return left.join(right, KEYS).where(inside).drop(*KEYS)


def overlapping_boxes(boxes: DataFrame, key: str, bounds: tuple[str, str, str, str],
                      within: list[str], base: float = BASE_DEGREES) -> DataFrame:
    """Pairs of boxes of the same group that touch, as columns ``a_*`` and ``b_*``.

    Each box is laid on its own grid, where it meets those of its grid, and as a guest on every coarser grid in use, where
    it meets the boxes laid there. The smaller box (ties: smaller key) is the guest, so a pair has one orientation; of the
    cells where it meets, only the one holding the larger of the two lower corners reports it. The boxes on their own grids
    are read the same way on all sides, so that they are shuffled once.
    """
    min_x, min_y, max_x, max_y = bounds
    names = boxes.columns
    grid = _cell_size(F.col("_level"), base).alias("_grid")
    hosts = boxes_on_grid(boxes, min_x, min_y, max_x, max_y, base)
    own = _level(F.col(max_x) - F.col(min_x), F.col(max_y) - F.col(min_y), base)
    coarser = F.filter(F.col("_levels"), lambda v: v > F.col("_own"))
    levelled = boxes.withColumn("_own", own).withColumn("_levels", grid_levels(hosts)).withColumn("_level", F.explode(coarser))
    guests = boxes_on_grid(levelled.drop("_own", "_levels"), min_x, min_y, max_x, max_y, base)
    same = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in within]

    def side(laid: DataFrame, p: str) -> DataFrame:
        return laid.select(*KEYS, grid, *[F.col(c).alias(f"{p}_{c}") for c in names])

    def met(left: DataFrame, within_grid: bool) -> DataFrame:
        pairs = side(left, "a").alias("l").join(side(hosts, "b").alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in KEYS] + same)
        # either side's cell and grid is used once, so that both sides read the same columns
        reports = (F.floor(F.greatest(F.col(f"a_{min_x}"), F.col(f"b_{min_x}")) / F.col("l._grid")) == F.col("l._cell_x")) & (
            F.floor(F.greatest(F.col(f"a_{min_y}"), F.col(f"b_{min_y}")) / F.col("r._grid")) == F.col("r._cell_y"))
        touching = (
            (F.col(f"a_{max_x}") >= F.col(f"b_{min_x}")) & (F.col(f"a_{min_x}") <= F.col(f"b_{max_x}"))
            & (F.col(f"a_{max_y}") >= F.col(f"b_{min_y}")) & (F.col(f"a_{min_y}") <= F.col(f"b_{max_y}"))
        )
        # without a null's verdict, no filter on the key tells one side from the other
        one_way = F.coalesce(F.col(f"a_{key}") < F.col(f"b_{key}"), F.lit(False))
        # most pairs of a cell do not touch, which is the cheapest test
        found = pairs.where(touching & one_way & reports) if within_grid else pairs.where(touching & reports)
        return found.select(*[f"a_{c}" for c in names], *[f"b_{c}" for c in names])

    return met(hosts, True).union(met(guests, False))


def keys_touching(boxes: DataFrame, key: str, bounds: tuple[str, str, str, str], frames: DataFrame,
                  frame_bounds: tuple[str, str, str, str], base: float = BASE_DEGREES) -> DataFrame:
    """Keys of the boxes that touch any of the frames.

    A box meets a frame on the coarser of their two grids: boxes are laid on the frames' grids that
    are no finer than their own, and frames on the boxes' grids that are coarser than theirs.
    """
    names = ("_a", "_b", "_c", "_d")
    own = boxes.select(key, *[F.col(b) for b in bounds])
    others = frames.select(*[F.col(b).alias(n) for b, n in zip(frame_bounds, names)])
    touch = (
        (F.col(bounds[2]) >= F.col("_a")) & (F.col(bounds[0]) <= F.col("_c"))
        & (F.col(bounds[3]) >= F.col("_b")) & (F.col(bounds[1]) <= F.col("_d"))
    )
    host_boxes, host_frames = boxes_on_grid(own, *bounds, base), boxes_on_grid(others, *names, base)

    def as_guests(frame: DataFrame, limits: tuple, hosts: DataFrame, strictly: bool) -> DataFrame:
        low = box_level(*limits, base)
        wanted = F.filter("_levels", lambda v: (v > F.col("_own")) if strictly else (v >= F.col("_own")))
        laid = frame.withColumn("_own", low).withColumn("_levels", grid_levels(hosts)).withColumn("_level", F.explode(wanted))
        return boxes_on_grid(laid.drop("_levels", "_own"), *limits, base)

    on_frames = as_guests(own, bounds, host_frames, False).join(host_frames, KEYS).where(touch).select(key)
    on_boxes = host_boxes.join(as_guests(others, names, host_boxes, True), KEYS).where(touch).select(key)
    return on_frames.union(on_boxes).distinct()


def radius_join(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str],
                radius: float, within: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs at most ``radius`` apart, in the units of the planar coordinates given.

    The right side is copied into the nine cells around its own; keep it the sparser side.
    """
    lx, ly = left_xy
    rx, ry = right_xy
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = left.withColumn("_cell_x", F.floor(F.col(lx) / radius)).withColumn("_cell_y", F.floor(F.col(ly) / radius))
    b = (
        right.withColumn("_cell_x", F.explode(F.transform(near, lambda d: F.floor(F.col(rx) / radius) + d)))
        .withColumn("_cell_y", F.explode(F.transform(near, lambda d: F.floor(F.col(ry) / radius) + d)))
        .withColumnsRenamed({"_cell_x": "_near_x", "_cell_y": "_near_y"})
    )
    dx, dy = F.col(rx) - F.col(lx), F.col(ry) - F.col(ly)
    on = [F.col("_cell_x") == F.col("_near_x"), F.col("_cell_y") == F.col("_near_y")]
    on += [F.col(p) == F.col(q) for p, q in within]
    return (
        a.join(b, on)
        .withColumn("distance", F.sqrt(dx * dx + dy * dy))
        .where(F.col("distance") <= radius)
        .drop("_cell_x", "_cell_y", "_near_x", "_near_y")
    )


def neighbour_counts(points: DataFrame, xy: tuple[str, str], radius: float, within: list[str]) -> DataFrame:
    """(``within``, x, y, ``here``, ``others``, ``nearest``) of each position of points: how many points lie there, how many other points at most
    ``radius`` apart, and the distance of the nearest other position among them.

    Points at one position are one row with a count before anything meets, so a spot with any number of them costs one row.
    """
    x, y = xy
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*within, x, y).agg(F.count("*").alias("here"))
    spots = cut_lineage(spots)
    others = spots.select(*[F.col(c).alias(f"_{c}") for c in within], F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("here").alias("_there"))
    met = radius_join(spots, others, xy, ("_x", "_y"), radius, [(c, f"_{c}") for c in within])
    apart = (F.col(x) != F.col("_x")) | (F.col(y) != F.col("_y"))
    return met.groupBy(*within, x, y, "here").agg(
        (F.sum("_there") - 1).alias("others"), F.min(F.when(apart, F.col("distance"))).alias("nearest"))


def interval_locate(points: DataFrame, segments: DataFrame, at: str, start: str, end: str,
                    step: float) -> DataFrame:
    """Segment with ``start < at <= end`` for every position; both sides meet in blocks of ``step``."""
    left = points.withColumn("_block", F.floor(F.col(at) / step))
    right = segments.withColumn("_block", F.explode(_span(F.col(start), F.col(end), F.lit(float(step)))))
    hit = (F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))
    return left.join(right, "_block").where(hit).drop("_block")
