"""Other landed inputs: price records, tiles, id lists, stored tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acremark.functions.text import list_key
from acremark.operators.prices import RECORD_FIELDS


def scan_price_xml(spark: SparkSession, path: str, row_tag: str = "dzialki") -> DataFrame:
    """Price records: gml_id and the text fields, missing ones as empty text."""
    schema = ", ".join(["_id string", *[f"{f} string" for f in RECORD_FIELDS]])
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)
    return raw.select(
        F.coalesce("_id", F.lit("")).alias("gml_id"),
        *[F.coalesce(F.trim(F.col(f)), F.lit("")).alias(f) for f in RECORD_FIELDS],
    )


STRIPS = "z int, x long, y long, py int, r array<int>, g array<int>, b array<int>"


def scan_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Image tiles under ``.../z/x/y.ext`` as one row per pixel line, colours as arrays.

    Spark's image source decodes the files (as BGR). What goes to Python at once is a line of a tile, not whole images.
    """
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    width = F.col("width") * F.col("nChannels")
    place = F.split(F.regexp_extract("origin", r"([^/]+/[^/]+/[^/.]+)[^/]*$", 1), "/")
    cut = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: F.substring(F.col("data"), i * width + 1, width))
    lines = images.where("height > 0").select(place[0].cast("int").alias("z"), place[1].cast("long").alias("x"), place[2].cast("long").alias("y"),
                                              F.col("nChannels").alias("n"), F.posexplode(cut).alias("py", "line"))

    def colours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: [] for c in "rgb"}
            for line, n in zip(batch["line"].to_pylist(), batch["n"].to_pylist()):
                pixels = np.frombuffer(line, np.uint8).reshape(-1, n)
                for c, i in zip("rgb", (2, 1, 0) if n >= 3 else (0, 0, 0)):
                    found[c].append(pixels[:, i].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("z", "x", "y", "py")], *[pa.array(v, pa.list_(pa.int32())) for v in found.values()]],
                                             ["z", "x", "y", "py", "r", "g", "b"])

    return lines.mapInArrow(colours, STRIPS)


def scan_analysis(spark: SparkSession, path: str, title_length: int | None = None,
                  description_length: int | None = None) -> DataFrame:
    """Analysis lists, one JSON object a file, as parsed by ``parse_analysis``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse_analysis(files.select("value", F.input_file_name().alias("source")), title_length, description_length)


def parse_analysis(documents: DataFrame, title_length: int | None = None,
                   description_length: int | None = None) -> DataFrame:
    """(source, key, title, description, count, ids) from JSON texts.

    Ids come from ``parcel_ids``, else ``parcels``, else ``ids``; an item is the id itself or an
    object holding it; blanks and repeats go, order stays. Other documents get null ids.
    """
    fields = "parcel_ids string, parcels string, ids string, title string, description string, summary string, analysis string"
    doc = documents.withColumn("_d", F.from_json("value", fields)).select("source", "_d.*")
    inner = F.from_json("analysis", "title string, description string, summary string")
    listed = F.coalesce("parcel_ids", "parcels", "ids")
    items = F.from_json(listed, "array<string>")

    def id_of(item: Column) -> Column:
        part = F.from_json(item, "id string, parcel_id string, parcelId string")
        named = F.coalesce(part["id"], part["parcel_id"], part["parcelId"])
        return F.trim(F.when(F.ltrim(item).startswith("{"), named).otherwise(item))

    def first_of(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])

    # items as (position, id), the first position of each id, back in order
    cleaned = F.filter(F.transform(items, id_of), lambda v: v.isNotNull() & (v != ""))
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", "")
    title = F.coalesce(first_of(F.col("title"), inner["title"], stem), F.lit("Analiza"))
    description = F.coalesce(
        first_of(F.col("description"), F.col("summary"), inner["description"], inner["summary"]), F.lit("")
    )
    shaped = doc.select(
        "source", F.array_distinct(cleaned).alias("ids"), title.alias("title"), description.alias("description")
    )

    def cut(name: str, length: int | None):
        return F.col(name) if length is None else F.substring(name, 1, length).alias(name)

    return shaped.select(
        "source",
        list_key(F.col("source"), F.col("ids"), F.col("description")).alias("key"),
        cut("title", title_length), cut("description", description_length),
        F.size("ids").alias("count"),
        "ids",
    )


def analysis_ids(analyses: DataFrame, key: str | None = None) -> DataFrame:
    chosen = analyses if key is None else analyses.where(F.col("key") == key)
    return chosen.select("key", F.posexplode("ids").alias("position", "parcel_id"))


def stored_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored table, older files with fewer columns included; only the named columns are read."""
    frame = spark.read.option("mergeSchema", "true").parquet(path)
    return frame.select(*columns) if columns else frame
