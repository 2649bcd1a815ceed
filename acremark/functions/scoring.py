"""Scores as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Targets, tolerances and weights of the parcel score (fixed default values)."""

    target_area_m2: float = 5000.0
    area_tolerance_m2: float = 5000.0
    target_compactness: float = 0.35
    target_elongation: float = 2.5
    elongation_tolerance: float = 7.0
    target_dark_ratio: float = 0.35
    dark_tolerance: float = 0.35
    target_bright_ratio: float = 0.10
    bright_tolerance: float = 0.20
    area_weight: float = 2.0
    compactness_weight: float = 1.0
    elongation_weight: float = 0.8
    green_weight: float = 1.4
    dark_weight: float = 0.6
    bright_weight: float = 0.4


def bell(value: Column, target: float, tolerance: float) -> Column:
    """1 at the target, falling linearly to 0 at the tolerance."""
    if tolerance <= 0:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(value - float(target)) / float(tolerance))


def weighted_score(area: Column, compactness: Column, elongation: Column, green: Column, dark: Column,
                   bright: Column, w: Weights) -> Column:
    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    parts = [
        (bell(area, w.target_area_m2, w.area_tolerance_m2), w.area_weight),
        (F.least(or_zero(compactness) / max(0.001, w.target_compactness), F.lit(1.0)), w.compactness_weight),
        (bell(or_zero(elongation), w.target_elongation, w.elongation_tolerance), w.elongation_weight),
        (or_zero(green), w.green_weight),
        (bell(or_zero(dark), w.target_dark_ratio, w.dark_tolerance), w.dark_weight),
        (bell(or_zero(bright), w.target_bright_ratio, w.bright_tolerance), w.bright_weight),
    ]
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + value * float(weight)
    return total


def simple_score(area: Column, compactness: Column, elongation: Column) -> Column:
    """Area up to 10,000 m2, compactness, and a bonus for low elongation when it is known."""
    size = F.least(F.coalesce(area, F.lit(0.0)), F.lit(10_000.0)) / 10_000.0
    stretch = F.coalesce(elongation, F.lit(0.0))
    bonus = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(stretch, F.lit(10.0)) / 10.0)
    return size + F.coalesce(compactness, F.lit(0.0)) + F.when(stretch != 0, bonus).otherwise(F.lit(0.0))


def density_score(points: Column, density_per_km2: Column) -> Column:
    return density_per_km2 * F.log1p(points)
