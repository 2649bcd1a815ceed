"""One bounding-box type, so that no caller has to remember an axis order."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BBox:
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def __post_init__(self):
        if self.min_lon >= self.max_lon or self.min_lat >= self.max_lat:
            raise ValueError(f"empty bounding box: {self}")

    @staticmethod
    def _numbers(text: str) -> list[float]:
        numbers = [float(part) for part in text.split(",")]
        if len(numbers) != 4:
            raise ValueError(f"a bounding box needs four numbers: {text!r}")
        return numbers

    @classmethod
    def lon_first(cls, text: str) -> "BBox":
        """Parse ``min_lon,min_lat,max_lon,max_lat``."""
        return cls(*cls._numbers(text))

    @classmethod
    def lat_first(cls, text: str) -> "BBox":
        """Parse ``min_lat,min_lon,max_lat,max_lon``."""
        south, west, north, east = cls._numbers(text)
        return cls(west, south, east, north)

    @property
    def mid_lat(self) -> float:
        return (self.min_lat + self.max_lat) / 2.0

    @property
    def mid_lon(self) -> float:
        return (self.min_lon + self.max_lon) / 2.0
