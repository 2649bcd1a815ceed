"""Cleaning, keys and labels as Column expressions; one Arrow UDF, for Unicode folding."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that betray UTF-8 text decoded as Latin-1.
MOJIBAKE_MARKS = ["Ã", "Å", "Ä", "Â"]
# Fixed value: link to a point on the public map.
MAP_LINK = "https://www.google.com/maps/search/?api=1&query=%.7f,%.7f"

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(text: Column) -> Column:
    """Decimal comma or point, blanks dropped, anything else null."""
    clean = F.replace(F.replace(F.trim(text), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.when(clean.rlike(NUMBER), clean.try_cast("double"))


def nonzero(value: Column) -> Column:
    """Null when zero, for chains where zero means "not given"."""
    return F.when(value != 0, value)


def area_m2_from_text(parcel_area: Column, property_area: Column) -> Column:
    """Parcel area, else property area; values in (0, 100) are hectares."""
    area = F.coalesce(nonzero(parse_number(parcel_area)), parse_number(property_area))
    return F.when((area > 0) & (area < 100), area * 10_000.0).otherwise(area)


def price_from_text(parcel_price: Column, property_price: Column) -> Column:
    return F.coalesce(nonzero(parse_number(parcel_price)), parse_number(property_price))


def unit_price(price: Column, area: Column) -> Column:
    return nonzero(price) / nonzero(area)


def canonical_map_json(tags: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def record_key(own_id: Column, *basis: Column) -> Column:
    """The record's own id, or a digest of its fields when it has none."""
    return F.when(F.length(F.coalesce(own_id, F.lit(""))) > 0, own_id).otherwise(
        F.sha2(F.to_json(F.struct(*basis)), 256)
    )


def list_key(source: Column, ids: Column, description: Column) -> Column:
    """Short content key of an id list: ``a_`` and 16 hex digits of SHA-1."""
    nul = F.lit("\0")
    return F.concat(
        F.lit("a_"),
        F.substring(F.sha1(F.concat(source, nul, F.array_join(ids, "\0"), nul, description)), 1, 16),
    )


def folded(name: str) -> str:
    letters = (ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch))
    return " ".join("".join(letters).casefold().split())


#: Names up to this length are folded once each and remembered; rows of a slice that is folded at once.
_SHORT, _SLICE = 64, 64


@lru_cache(maxsize=10_000)
def _remembered(name: str) -> str:
    return folded(name)


@F.arrow_udf(StringType())
def _folded(names: pa.Array) -> pa.Array:
    """Slice by slice, so that a batch of long texts is never held as Python strings."""
    out = [pa.array([(_remembered if len(n) <= _SHORT else folded)(n) if n is not None else "" for n in names.slice(at, _SLICE).to_pylist()], pa.string())
           for at in range(0, len(names), _SLICE)]
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def normalized_name(name: Column) -> Column:
    """Decomposed, unaccented, case-folded, single-spaced. Letters without a decomposition stay."""
    return _folded(name)


def commune_matches(actual: Column, expected: str | None) -> Column:
    if not expected:
        return F.lit(True)
    return normalized_name(actual) == F.lit(folded(expected))


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 read as Latin-1; text that is not such damage comes back unchanged."""
    suspicious = text.rlike("[" + "".join(MOJIBAKE_MARKS) + "]") & text.rlike(r"^[\x{00}-\x{FF}]*$")
    raw = F.when(suspicious, F.encode(text, "ISO-8859-1"))
    as_text = raw.cast("string")
    return F.when(suspicious & F.is_valid_utf8(as_text), as_text).otherwise(text)


def repair_tags(tags: Column) -> Column:
    """Repair the keys and values of a tag map; on equal repaired keys the later entry stays."""
    fixed = F.transform(
        F.map_entries(tags),
        lambda e: F.struct(repair_mojibake(e["key"]).alias("key"), repair_mojibake(e["value"]).alias("value")),
    )
    last = F.filter(fixed, lambda e, i: ~F.exists(F.slice(fixed, i + 2, F.size(fixed)), lambda n: n["key"] == e["key"]))
    return F.map_from_entries(last)


def slug(text: Column, length: int | None = None) -> Column:
    """Letters, digits, ``_`` and ``-`` only; cut to ``length`` where one is given."""
    plain = F.regexp_replace(F.trim(text), r"[^a-zA-Z0-9_-]+", "_")
    plain = F.btrim(F.regexp_replace(plain, "_+", "_"), F.lit("_"))
    plain = plain if length is None else F.substring(plain, 1, length)
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown"))


def clean_part(text: Column, fallback: str = "unknown") -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(fallback))


def map_link(lat: Column, lon: Column, box: dict[str, Column]) -> Column:
    """Link to the centroid, or to the middle of the box where the centroid is missing or zero."""
    at_lat = F.coalesce(nonzero(lat), (box["min_lat"] + box["max_lat"]) / 2.0)
    at_lon = F.coalesce(nonzero(lon), (box["min_lon"] + box["max_lon"]) / 2.0)
    return F.format_string(MAP_LINK, at_lat, at_lon)
