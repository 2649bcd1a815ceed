"""Land-price observations: cleaning, inflation, statistics, and tiles to scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acremark.functions.geo import margin_degrees
from acremark.functions.text import area_m2_from_text, nonzero, price_from_text, record_key, unit_price
from acremark.operators.filters import BOUNDS
from acremark.operators.ordering import exact_median, first_per_key
from acremark.session import cut_lineage

SOURCE = "gugik_rcn_wfs"  # fixed value: name of the price register in stored rows

# Text fields of a price record and the stored column each one fills.
RECORD_FIELDS = [
    "serwis_rcn", "teryt", "tran_przestrzen_nazw", "tran_lokalny_id_iip", "tran_wersja_id",
    "tran_rodzaj_trans", "tran_rodzaj_rynku", "tran_sprzedajacy", "tran_kupujacy", "tran_vat",
    "dok_data", "nier_rodzaj", "nier_prawo", "nier_udzial", "nier_pow_gruntu", "nier_cena_brutto",
    "nier_vat", "dzi_id_dzialki", "dzi_nr_dzialki", "dzi_przezn_wmpzp", "dzi_pow_ewid",
    "dzi_sposob_uzyt", "dzi_cena_brutto", "dzi_vat", "dzi_adres",
]
STORED_COLUMNS = {
    "teryt": "teryt",
    "dok_data": "transaction_date",
    "tran_rodzaj_trans": "transaction_type",
    "tran_rodzaj_rynku": "market_type",
    "tran_sprzedajacy": "seller_type",
    "tran_kupujacy": "buyer_type",
    "nier_rodzaj": "property_type",
    "nier_prawo": "property_right",
    "dzi_id_dzialki": "parcel_id",
    "dzi_nr_dzialki": "parcel_number",
    "dzi_adres": "address",
    "dzi_sposob_uzyt": "land_use",
    "dzi_przezn_wmpzp": "zoning",
}


def reference_index(index: DataFrame, requested: str | None) -> DataFrame:
    """One row: the reference year (the one asked for, else the latest) and its index value."""
    if requested:
        known = index.where(F.col("year") == requested)
        missing = F.raise_error(F.lit(f"reference year {requested} is not in the index")).cast("string")
        return known.agg(
            F.when(F.count("*") == 0, missing).otherwise(F.lit(requested)).alias("reference_year"),
            F.max("index_value").alias("reference_value"),
        )
    return index.agg(F.max("year").alias("reference_year"), F.max_by("index_value", "year").alias("reference_value"))


def add_inflation(records: DataFrame, index: DataFrame, requested: str | None = None,
                  date: str = "transaction_date") -> DataFrame:
    """``inflation_factor`` from the index of the transaction year; null where there is no index.

    The index has one row per year, so Spark's own size check makes it the small side of the join.
    """
    reference = reference_index(index, requested)
    year = reference.select("reference_year").scalar()
    value = reference.select("reference_value").scalar()
    factors = index.select(
        F.col("year").alias("_year"), (nonzero(value) / nonzero(F.col("index_value"))).alias("inflation_factor")
    )
    joined = records.withColumn("_year", F.substring(F.col(date), 1, 4)).join(factors, "_year", "left").drop("_year")
    return joined.withColumn("inflation_reference_year", year)


def parsed_records(records: DataFrame) -> DataFrame:
    """Landed price records with ``source_record_id``, ``area_m2``, ``price_pln`` and ``price_per_m2``; each text is parsed once."""
    keyed = records.select(
        "gml_id", *RECORD_FIELDS, record_key(F.col("gml_id"), *[F.col(f) for f in RECORD_FIELDS]).alias("source_record_id"),
        area_m2_from_text(F.col("dzi_pow_ewid"), F.col("nier_pow_gruntu")).alias("area_m2"),
        price_from_text(F.col("dzi_cena_brutto"), F.col("nier_cena_brutto")).alias("price_pln"),
    )
    return keyed.withColumn("price_per_m2", unit_price(F.col("price_pln"), F.col("area_m2")))


def newest_records(parsed: DataFrame, newest_by: tuple[str, ...]) -> DataFrame:
    """One of the parsed records of each key: the last by these columns of an observation, which may be ``raw_json``.

    Records that differ in none of them are told apart by a digest of their texts, so the long text itself is never sorted.
    """
    texts = {name: field for field, name in STORED_COLUMNS.items()}
    digest = F.xxhash64("gml_id", *RECORD_FIELDS)
    order = [F.desc(texts.get(c, c)) if c != "raw_json" else digest.desc() for c in newest_by]
    return first_per_key(parsed, ["source_record_id"], [*order, digest.desc()])


def observations_of(parsed: DataFrame, run_id: str, index: DataFrame | None = None, requested_year: str | None = None) -> DataFrame:
    """Parsed records as observations of a run, with inflation-adjusted prices."""
    base = parsed.select(
        F.lit(SOURCE).alias("source"), "source_record_id", F.lit(run_id).alias("run_id"),
        *[F.col(f).alias(name) for f, name in STORED_COLUMNS.items()],
        "area_m2", "price_pln", "price_per_m2",
        F.to_json(F.struct("gml_id", *RECORD_FIELDS)).alias("raw_json"),
    )
    if index is None:
        base = base.withColumn("inflation_factor", F.lit(None).cast("double")).withColumn(
            "inflation_reference_year", F.lit(None).cast("string")
        )
    else:
        base = add_inflation(base, index, requested_year)
    factor = nonzero(F.col("inflation_factor"))
    return base.withColumn("inflation_adjusted_price_pln", nonzero(F.col("price_pln")) * factor).withColumn(
        "inflation_adjusted_price_per_m2", nonzero(F.col("price_per_m2")) * factor
    )


def price_observations(records: DataFrame, run_id: str, index: DataFrame | None = None,
                       requested_year: str | None = None) -> DataFrame:
    """Landed price records as observations: numbers, unit price, inflation-adjusted prices."""
    return observations_of(parsed_records(records), run_id, index, requested_year)


def _positive(column: str) -> Column:
    return F.count_if(F.col(column) > 0)


def stats_per_parcel(parcels: DataFrame, prices: DataFrame) -> DataFrame:
    """Price counts and ranges of every given parcel; a parcel without records has zeros and nulls."""
    raw, adjusted = "price_per_m2", "inflation_adjusted_price_per_m2"
    stats = prices.groupBy("parcel_id").agg(
        F.count("*").alias("rcn_records"),
        _positive(raw).alias("priced_records"),
        *[f(c).alias(f"{n}_{c}") for c in (raw, adjusted) for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))],
    )
    joined = parcels.select("parcel_id").join(stats, "parcel_id", "left")
    return joined.fillna(0, subset=["rcn_records", "priced_records"])


def stats_per_run(prices: DataFrame) -> DataFrame:
    """Per run: counts, exact medians and range of the positive unit prices, two decimals."""
    raw, adjusted = "price_per_m2", "inflation_adjusted_price_per_m2"
    clean = prices.select(
        "run_id",
        F.when(F.col(raw) > 0, F.col(raw)).alias("p"),
        F.when(F.col(adjusted) > 0, F.col(adjusted)).alias("a"),
    )
    counts = clean.groupBy("run_id").agg(
        F.count("*").alias("rcn_records"),
        F.count("p").alias("priced_records"),
        F.round(F.min("p"), 2).alias("min_price_per_m2"),
        F.round(F.max("p"), 2).alias("max_price_per_m2"),
        F.count("a").alias("inflation_adjusted_priced_records"),
    )
    return (
        counts.join(exact_median(clean, ["run_id"], "p", "m"), "run_id", "left")
        .withColumn("median_price_per_m2", F.round("m", 2)).drop("m")
        .join(exact_median(clean, ["run_id"], "a", "m"), "run_id", "left")
        .withColumn("median_inflation_adjusted_price_per_m2", F.round("m", 2)).drop("m")
    )


def price_summary(prices: DataFrame) -> DataFrame:
    """The presentation summary per run; minimum and mean take every price that is there."""
    raw, adjusted = "price_per_m2", "inflation_adjusted_price_per_m2"
    return prices.groupBy("run_id").agg(
        F.count("*").alias("rcn_records"),
        _positive(raw).alias("priced_records"),
        F.round(F.min(raw), 2).alias("min_price_per_m2"),
        F.round(F.avg(raw), 2).alias("avg_price_per_m2"),
        F.round(F.max(raw), 2).alias("max_price_per_m2"),
        _positive(adjusted).alias("inflation_adjusted_priced_records"),
        F.round(F.avg(adjusted), 2).alias("avg_inflation_adjusted_price_per_m2"),
        F.max("inflation_reference_year").alias("inflation_reference_year"),
    )


def candidate_price_summary(prices: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row over the records of the candidate parcels; the adjusted price wins unless zero."""
    of_candidates = prices.join(candidates.select("parcel_id"), "parcel_id", "left_semi")
    value = F.coalesce(nonzero(F.col("inflation_adjusted_price_per_m2")), F.col("price_per_m2"))
    values = of_candidates.select(value.alias("v"))
    totals = values.agg(
        F.count("*").alias("observation_count"), F.count("v").alias("price_count"),
        F.min("v").alias("price_min"), F.max("v").alias("price_max"), F.avg("v").alias("price_avg"),
    )
    return totals.withColumn("price_median", exact_median(values, [], "v", "m").scalar())


def map_price_stats(prices: DataFrame, runs: list[str]) -> DataFrame:
    return (
        prices.where(F.col("run_id").isin(list(runs)) & F.col("price_per_m2").isNotNull())
        .groupBy("parcel_id")
        .agg(
            F.count("*").alias("rcn_records"),
            F.round(F.avg("price_per_m2"), 2).alias("avg_price_per_m2"),
            F.round(F.avg("inflation_adjusted_price_per_m2"), 2).alias("avg_inflation_adjusted_price_per_m2"),
            F.max("inflation_reference_year").alias("inflation_reference_year"),
        )
    )


def scan_tiles(parcels: DataFrame, tile_km: float = 2.0, margin_m: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Parcels bucketed into square tiles: (tile table, parcel-to-tile links).

    Tiles are numbered by row and column: rows are counted first, so numbering needs no sort of the
    whole tile table. Members stay a table of their own rather than a list in the tile row.
    """
    origin = parcels.agg(
        F.min("centroid_lat").alias("lat"), F.min("centroid_lon").alias("lon"), F.avg("centroid_lat").alias("mid")
    )
    lat0, lon0, mid = (origin.select(c).scalar() for c in ("lat", "lon", "mid"))
    km = 111.32  # fixed value: kilometres per degree
    lat_step = F.lit(max(0.0001, tile_km / km))
    lon_step = F.greatest(F.lit(0.0001), F.lit(tile_km) / F.greatest(F.lit(1.0), F.cos(F.radians(mid)) * km))
    placed = parcels.withColumn("y", F.floor((F.col("centroid_lat") - lat0) / lat_step)).withColumn(
        "x", F.floor((F.col("centroid_lon") - lon0) / lon_step)
    )
    # the tile table is bounded by the area covered; it is counted once
    tiles = cut_lineage(placed.groupBy("y", "x").agg(
        F.count("*").alias("parcels"), F.avg("centroid_lat").alias("lat"),
        F.min("bbox_min_lon").alias("w"), F.min("bbox_min_lat").alias("s"),
        F.max("bbox_max_lon").alias("e"), F.max("bbox_max_lat").alias("n"),
    ))
    rows = tiles.groupBy("y").agg(F.count("*").alias("c"))
    before = Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select("y", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.row_number().over(Window.partitionBy("y").orderBy("x"))
    lon_margin, lat_margin = margin_degrees(margin_m, F.col("lat"))
    digits = F.when(F.length(number.cast("string")) < 6, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string"))
    numbered = tiles.join(offsets, "y").select(
        F.concat_ws("_", F.lit("tile"), digits, "y", "x").alias("tile_id"), "y", "x", "parcels",
        F.round(F.col("w") - lon_margin, 8).alias("bbox_min_lon"),
        F.round(F.col("s") - lat_margin, 8).alias("bbox_min_lat"),
        F.round(F.col("e") + lon_margin, 8).alias("bbox_max_lon"),
        F.round(F.col("n") + lat_margin, 8).alias("bbox_max_lat"),
    )
    members = placed.select("parcel_id", "y", "x").join(numbered.select("tile_id", "y", "x"), ["y", "x"]).select(
        "tile_id", "parcel_id"
    )
    return numbered, members


def run_bbox(parcels: DataFrame, links: DataFrame, margin_m: float = 0.0) -> DataFrame:
    """Per run: the box around its parcels, grown by a margin; null where any bound is unknown."""
    linked = links.select("run_id", "parcel_id").join(parcels.select("parcel_id", *BOUNDS), "parcel_id")
    united = linked.groupBy("run_id").agg(
        F.min("bbox_min_lon").alias("w"), F.min("bbox_min_lat").alias("s"),
        F.max("bbox_max_lon").alias("e"), F.max("bbox_max_lat").alias("n"),
    )
    d_lon, d_lat = margin_degrees(margin_m, (F.col("s") + F.col("n")) / 2.0)
    return united.select(
        "run_id",
        (F.col("w") - d_lon).alias("min_lon"), (F.col("s") - d_lat).alias("min_lat"),
        (F.col("e") + d_lon).alias("max_lon"), (F.col("n") + d_lat).alias("max_lat"),
    )


def scan_totals(tiles: DataFrame, checks: DataFrame, landed: DataFrame, merged: DataFrame) -> DataFrame:
    """One row of totals over a scan: tiles by status, parcels selected, checked and priced, records as
    they landed and after the merge, overall status."""
    per_tile = tiles.agg(
        F.count("*").alias("tiles"),
        F.count_if(F.col("status") == "ok").alias("ok_tiles"),
        F.count_if(F.col("status") != "ok").alias("error_tiles"),
    )
    ok = F.col("status") == "ok"
    per_parcel = checks.agg(
        F.struct(
            F.count("*").alias("selected_parcels"), F.count_if(ok).alias("checked_parcels"), F.count_if(ok & (F.col("priced_records") > 0)).alias("priced_parcels")
        ).alias("n")
    )
    records = {"fetched_records": landed.agg(F.count("*")).scalar(), "stored_records": merged.agg(F.count("*")).scalar()}
    return per_tile.withColumn("_n", per_parcel.scalar()).select("*", "_n.*").drop("_n").withColumns(records).withColumn(
        "status", F.when(F.col("error_tiles") == 0, "ok").otherwise("partial_error")
    )
