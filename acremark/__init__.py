"""acremark: parcel and place analytics as plain Spark DataFrame jobs."""

from acremark.bbox import BBox

__all__ = ["BBox"]
