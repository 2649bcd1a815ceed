"""Imagery figures per parcel: polygons to pixel runs, runs to tile strips, statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.functions.geo import world_pixel
from acremark.operators.geometry import ring_edges

STRIP = ["z", "x", "y", "py"]


def strips_from_pixels(pixels: DataFrame) -> DataFrame:
    """Pixel rows (z, x, y, px, py, r, g, b) as one row per tile line, colours as arrays.

    A line must have each of its pixels from 0 to its last once; one that has not is an error, as colours would move.
    """
    spot = F.struct("px", "r", "g", "b")
    lines = pixels.groupBy(*STRIP).agg(F.sort_array(F.collect_list(spot)).alias("line"))
    whole = F.col("line.px") == F.sequence(F.lit(0), F.size("line") - 1).cast("array<int>")
    broken = F.raise_error(F.concat_ws(" ", F.lit("tile line with missing or repeated pixels:"), *STRIP)).cast("array<int>")
    return lines.withColumn("_px", F.when(whole, F.col("line.px")).otherwise(broken)).where("_px IS NOT NULL").select(
        *STRIP, "line.r", "line.g", "line.b")


def pixels_from_strips(strips: DataFrame) -> DataFrame:
    return strips.select(*STRIP, F.posexplode(F.arrays_zip("r", "g", "b")).alias("px", "c")).select(
        "z", "x", "y", "px", "py", "c.r", "c.g", "c.b"
    )


def _first_centre_at_or_after(value: Column) -> Column:
    return F.ceil(value - 0.5).cast("long")


def polygon_runs(points: DataFrame, zoom: int, tile_size: int = 256, pictured: DataFrame | None = None) -> DataFrame:
    """Runs of pixels (parcel_id, gy, from_gx, to_gx) whose centres lie inside the parcel.

    Every edge yields one crossing per pixel line it passes; the sorted crossings of a line pair up
    into runs, which is the even-odd rule, so holes stay out. Runs of different polygons of a parcel
    are merged where they overlap. Work grows with outline and area, never with pixels x polygons.
    Only the pixel lines ``gy`` of ``pictured`` are made where it is given.
    """
    edges = ring_edges(points)
    x0, y0 = world_pixel(F.col("lon0"), F.col("lat0"), zoom, tile_size)
    x1, y1 = world_pixel(F.col("lon1"), F.col("lat1"), zoom, tile_size)
    placed = edges.select(
        "parcel_id", "polygon_index", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")
    )
    first = _first_centre_at_or_after(F.least("y0", "y1"))
    last = _first_centre_at_or_after(F.greatest("y0", "y1")) - 1
    lines = placed.where(first <= last).withColumn("gy", F.explode(F.sequence(first, last)))
    if pictured is not None:
        lines = lines.join(pictured, "gy", "left_semi")
    rise = F.col("y1") - F.col("y0")
    at = (F.col("x1") - F.col("x0")) * (F.col("gy") + 0.5 - F.col("y0")) / rise + F.col("x0")
    crossings = lines.select("parcel_id", "polygon_index", "gy", at.alias("cross")).repartition("parcel_id", "gy")
    in_order = Window.partitionBy("parcel_id", "polygon_index", "gy").orderBy("cross")
    paired = crossings.withColumn("until", F.lead("cross").over(in_order)).withColumn("n", F.row_number().over(in_order))
    runs = paired.where("n % 2 = 1 AND until IS NOT NULL").select(
        "parcel_id", "gy",
        _first_centre_at_or_after(F.col("cross")).alias("start"),
        (_first_centre_at_or_after(F.col("until")) - 1).alias("stop"),
    ).where("start <= stop")
    earlier = Window.partitionBy("parcel_id", "gy").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier) + 1, F.col("start")))
    return runs.select("parcel_id", "gy", start.alias("from_gx"), F.col("stop").alias("to_gx")).where("from_gx <= to_gx")


def parcel_tiles(points: DataFrame, zoom: int, tile_size: int = 256) -> DataFrame:
    """Tiles that the bounding box of each parcel covers, the list an image fetcher needs."""
    x, y = world_pixel(F.col("lon"), F.col("lat"), zoom, tile_size)
    placed = points.select("parcel_id", F.floor(x / tile_size).alias("tx"), F.floor(y / tile_size).alias("ty"))
    zero = F.lit(0)
    boxes = placed.groupBy("parcel_id").agg(
        *[F.greatest(zero, f(c)).alias(n) for n, f, c in
          (("x0", F.min, "tx"), ("x1", F.max, "tx"), ("y0", F.min, "ty"), ("y1", F.max, "ty"))]
    )
    return boxes.select("parcel_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select(
        "parcel_id", F.lit(zoom).alias("z"), "x", F.explode(F.sequence("y0", "y1")).alias("y")
    )


def _tile_runs(points: DataFrame, strips: DataFrame, zoom: int, tile_size: int) -> DataFrame:
    """The runs of :func:`polygon_runs` cut at tile borders: (parcel_id, gy, z, x, y, py) and the first and last pixel in the tile, ``a`` and ``b_``.

    Pixel lines that no tile line is on are left out before anything is sent.
    """
    pictured = strips.where(F.col("z") == zoom).select((F.col("y") * tile_size + F.col("py")).cast("long").alias("gy")).distinct()
    runs = polygon_runs(points, zoom, tile_size, pictured)
    first_tile, last_tile = F.floor(F.col("from_gx") / tile_size), F.floor(F.col("to_gx") / tile_size)
    return runs.withColumn("x", F.explode(F.sequence(first_tile, last_tile))).select(
        "parcel_id", "gy", F.lit(zoom).alias("z"), "x",
        F.floor(F.col("gy") / tile_size).alias("y"),
        (F.col("gy") % tile_size).cast("int").alias("py"),
        F.greatest(F.lit(0), F.col("from_gx") - F.col("x") * tile_size).cast("int").alias("a"),
        F.least(F.lit(tile_size - 1), F.col("to_gx") - F.col("x") * tile_size).cast("int").alias("b_"),
    )


def parcel_pixels(points: DataFrame, strips: DataFrame, zoom: int, tile_size: int = 256) -> DataFrame:
    """(parcel_id, gx, gy, r, g, b) of every pixel inside a parcel: runs meet tile lines by key."""
    joined = _tile_runs(points, strips, zoom, tile_size).join(strips, STRIP)
    length = F.col("b_") - F.col("a") + 1
    cut = F.arrays_zip(*[F.slice(c, F.col("a") + 1, length).alias(c) for c in ("r", "g", "b")])
    return joined.select("parcel_id", "gy", (F.col("x") * tile_size + F.col("a")).alias("gx0"), F.posexplode(cut).alias("i", "p")).select(
        "parcel_id", (F.col("gx0") + F.col("i")).alias("gx"), "gy", "p.r", "p.g", "p.b"
    )


#: What is added up along a tile line: values, their squares, and whether a threshold is met.
_VALUES = ("r", "g", "b", "brightness", "green_index")
_SUMS = (*_VALUES, *[f"{v}_squared" for v in _VALUES], "green", "dark", "bright", "pale")


def _line_values(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows of ``_SUMS`` for the pixels of one line."""
    brightness = (r + g + b) / 3.0
    values = np.stack([r, g, b, brightness, (g - r) / np.maximum(1.0, g + r)])
    spread = np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    # fixed values: thresholds of the four ratios
    tests = np.stack([(g > 60) & (g >= r * 1.05) & (g >= b * 1.05), brightness < 70, brightness > 190, spread < 25])
    return np.concatenate([values, values**2, tests.astype(np.float64)])


def line_sums(strips: DataFrame) -> DataFrame:
    """Running sums along each tile line: of a run of pixels from a to b the sums are ``sums[b + 1] - sums[a]``, for each of ``_SUMS``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.float64()))
        for batch in batches:
            lines = []
            for colours in zip(*[batch[c].to_pylist() for c in ("r", "g", "b")]):
                found = _line_values(*[np.asarray(c, np.float64) for c in colours])
                lines.append(np.concatenate([np.zeros((len(found), 1)), found.cumsum(axis=1)], axis=1).T.tolist())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in STRIP], pa.array(lines, kind)], [*STRIP, "sums"])

    chosen = strips.select(*STRIP, "r", "g", "b")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:4])
    return chosen.mapInArrow(run, f"{kinds}, sums array<array<double>>")


def zonal_statistics(points: DataFrame, strips: DataFrame, zoom: int, tile_size: int = 256) -> DataFrame:
    """The figures of :func:`pixel_statistics` for every parcel with pixels, from two look-ups a run and tile line.

    Work grows with the lines that a parcel touches, not with its pixels; tile lines that no parcel touches are left out first.
    """
    runs = _tile_runs(points, strips, zoom, tile_size)
    lines = line_sums(strips.join(runs.select(*STRIP).distinct(), STRIP, "left_semi"))
    last = F.least(F.col("b_") + 1, F.size("sums") - 1)
    inside = runs.join(lines, STRIP).where(F.col("a") < last)
    ends = inside.select("parcel_id", (last - F.col("a")).alias("n"), F.get("sums", last).alias("high"), F.get("sums", F.col("a")).alias("low"))
    added = ends.groupBy("parcel_id").agg(
        F.sum("n").alias("masked_pixel_count"), *[F.sum(F.get("high", F.lit(i)) - F.get("low", F.lit(i))).alias(s) for i, s in enumerate(_SUMS)])
    n = F.col("masked_pixel_count")

    def mean(v: str) -> Column:
        return F.col(v) / n

    def deviation(v: str) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), F.col(f"{v}_squared") / n - mean(v) * mean(v)))

    return added.select(
        "parcel_id", "masked_pixel_count",
        *[mean(c).alias(f"rgb_{c}_mean") for c in ("r", "g", "b")], *[deviation(c).alias(f"rgb_{c}_std") for c in ("r", "g", "b")],
        mean("brightness").alias("brightness_mean"), deviation("brightness").alias("brightness_std"),
        mean("green_index").alias("green_index_mean"), deviation("green_index").alias("green_index_std"),
        mean("green").alias("green_pixel_ratio"), mean("dark").alias("dark_pixel_ratio"), mean("bright").alias("bright_pixel_ratio"),
        mean("pale").alias("low_saturation_ratio"))


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """Sixteen colour figures per parcel; needs only partial sums, so a huge parcel is no problem."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    brightness = (r + g + b) / 3.0
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    values = pixels.select(
        "parcel_id", "r", "g", "b", brightness.alias("brightness"), spread.alias("spread"),
        ((g - r) / F.greatest(F.lit(1.0), (g + r).cast("double"))).alias("green_index"),
    )

    def share(test: Column) -> Column:
        return F.count_if(test) / F.count("*")

    # fixed values: thresholds of the four ratios
    green = (g > 60) & (g >= r * 1.05) & (g >= b * 1.05)
    return values.groupBy("parcel_id").agg(
        F.count("*").alias("masked_pixel_count"),
        *[F.avg(c).alias(f"rgb_{c}_mean") for c in ("r", "g", "b")],
        *[F.stddev_pop(c).alias(f"rgb_{c}_std") for c in ("r", "g", "b")],
        F.avg("brightness").alias("brightness_mean"),
        F.stddev_pop("brightness").alias("brightness_std"),
        F.avg("green_index").alias("green_index_mean"),
        F.stddev_pop("green_index").alias("green_index_std"),
        share(green).alias("green_pixel_ratio"),
        share(F.col("brightness") < 70).alias("dark_pixel_ratio"),
        share(F.col("brightness") > 190).alias("bright_pixel_ratio"),
        share(F.col("spread") < 25).alias("low_saturation_ratio"),
    )
