"""Price observations, statistics, tiles; upserts; quality checks; streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from acremark.functions import text
from acremark.operators import ordering, prices, quality, upsert
from acremark.plans import analyses
from acremark.session import scratch_path
from acremark.streaming import incremental
from checks.catalog import query


def _records(t):
    """Landed price texts under the register's own field names."""
    names = {"gml_id": "gml_id", "transaction_date": "dok_data", "parcel_id": "dzi_id_dzialki", "parcel_area": "dzi_pow_ewid",
             "property_area": "nier_pow_gruntu", "parcel_price": "dzi_cena_brutto", "property_price": "nier_cena_brutto"}
    given = t("fx_price_text").withColumnsRenamed(names)
    absent = [f for f in prices.RECORD_FIELDS if f not in given.columns]
    return given.select("*", *[F.lit("").alias(f) for f in absent])


@query("price_text_cleaning", ["fx_prices"], """
    SELECT source_record_id, s1, s2, s3, s4, s5, s6, s7, round(area_m2, 3) AS area_m2, price_pln, round(price_per_m2, 7) AS price_per_m2 FROM fx_prices""")
def _(t):
    raw = t("fx_price_text")
    area = text.area_m2_from_text(F.col("parcel_area"), F.col("property_area"))
    price = text.price_from_text(F.col("parcel_price"), F.col("property_price"))
    return raw.select(F.col("gml_id").alias("source_record_id"), *[f"s{i}" for i in range(1, 8)], F.round(area, 3).alias("area_m2"),
                      price.alias("price_pln"), F.round(text.unit_price(price, area), 7).alias("price_per_m2"))


@query("inflation_adjusted_prices", ["fx_prices"], """
    SELECT source_record_id, transaction_date, parcel_id, round(inflation_factor, 9) AS inflation_factor, round(inflation_adjusted_price_per_m2, 7) AS adjusted FROM fx_prices""")
def _(t):
    seen = prices.price_observations(_records(t), "scan-1", t("fx_index"))
    return seen.select("source_record_id", "transaction_date", "parcel_id", F.round("inflation_factor", 9).alias("inflation_factor"),
                       F.round("inflation_adjusted_price_per_m2", 7).alias("adjusted"))


@query("inflation_requested_year", ["fx_price_text", "fx_index"], """
    SELECT t.gml_id, t.transaction_date, t.parcel_id, '1998' AS reference_year, round(CAST(139 AS DOUBLE) / i.index_value, 9) AS factor FROM fx_price_text t LEFT JOIN fx_index i ON i.year = substr(t.transaction_date, 1, 4)""")
def _(t):
    return prices.add_inflation(t("fx_price_text"), t("fx_index"), "1998").select(
        "gml_id", "transaction_date", "parcel_id", F.col("inflation_reference_year").alias("reference_year"), F.round("inflation_factor", 9).alias("factor"))


@query("price_stats_per_parcel", ["fx_parcels", "fx_prices"], """
    SELECT p.parcel_id, count(r.parcel_id) AS rcn_records, count(*) FILTER (WHERE r.price_per_m2 > 0) AS priced_records, round(min(r.price_per_m2), 6) AS min_p, round(avg(r.price_per_m2), 6) AS avg_p, round(max(r.price_per_m2), 6) AS max_p,
      round(avg(r.inflation_adjusted_price_per_m2), 6) AS avg_adjusted
    FROM fx_parcels p LEFT JOIN fx_prices r ON r.parcel_id = p.parcel_id GROUP BY p.parcel_id""")
def _(t):
    s = prices.stats_per_parcel(t("fx_parcels"), t("fx_prices"))
    return s.select("parcel_id", "rcn_records", "priced_records", F.round("min_price_per_m2", 6).alias("min_p"), F.round("avg_price_per_m2", 6).alias("avg_p"),
                    F.round("max_price_per_m2", 6).alias("max_p"), F.round("avg_inflation_adjusted_price_per_m2", 6).alias("avg_adjusted"))


@query("price_stats_per_run", ["fx_prices"], """
    SELECT run_id, count(*) AS rcn_records, count(p) AS priced_records, round(min(p), 2) AS min_price_per_m2, round(max(p), 2) AS max_price_per_m2, round(median(p), 2) AS median_price_per_m2,
      count(a) AS inflation_adjusted_priced_records, round(median(a), 2) AS median_inflation_adjusted_price_per_m2
    FROM (SELECT run_id, CASE WHEN price_per_m2 > 0 THEN price_per_m2 END AS p, CASE WHEN inflation_adjusted_price_per_m2 > 0 THEN inflation_adjusted_price_per_m2 END AS a FROM fx_prices) q GROUP BY run_id""")
def _(t):
    return prices.stats_per_run(t("fx_prices"))


@query("exact_median_per_market", ["fx_prices"], """
    SELECT substr(transaction_date, 1, 4) AS year, run_id, round(median(price_pln), 4) AS m FROM fx_prices WHERE price_pln IS NOT NULL GROUP BY 1, 2""")
def _(t):
    yearly = t("fx_prices").withColumn("year", F.substring("transaction_date", 1, 4))
    return ordering.exact_median(yearly, ["year", "run_id"], "price_pln", "m", ranked=200).withColumn("m", F.round("m", 4))


@query("price_summary_named", ["fx_prices"], """
    SELECT run_id, count(*) AS rcn_records, count(*) FILTER (WHERE price_per_m2 > 0) AS priced_records, round(min(price_per_m2), 2) AS min_price_per_m2, round(avg(price_per_m2), 2) AS avg_price_per_m2, round(max(price_per_m2), 2) AS max_price_per_m2,
      count(*) FILTER (WHERE inflation_adjusted_price_per_m2 > 0) AS inflation_adjusted_priced_records, round(avg(inflation_adjusted_price_per_m2), 2) AS avg_inflation_adjusted_price_per_m2, max(inflation_reference_year) AS inflation_reference_year
    FROM fx_prices GROUP BY run_id""")
def _(t):
    return prices.price_summary(t("fx_prices"))


@query("candidate_price_summary", ["fx_prices", "fx_links"], """
    SELECT count(*) AS observation_count, count(v) AS price_count, round(min(v), 6) AS price_min, round(max(v), 6) AS price_max, round(avg(v), 6) AS price_avg, round(median(v), 6) AS price_median
    FROM (SELECT coalesce(nullif(inflation_adjusted_price_per_m2, 0), price_per_m2) AS v FROM fx_prices WHERE parcel_id IN (SELECT parcel_id FROM fx_links WHERE run_id = 'r2')) q""")
def _(t):
    s = prices.candidate_price_summary(t("fx_prices"), t("fx_links").where("run_id = 'r2'"))
    return s.select("observation_count", "price_count", *[F.round(c, 6).alias(c) for c in ("price_min", "price_max", "price_avg", "price_median")])


@query("price_stats_for_map", ["fx_prices"], """
    SELECT parcel_id, count(*) AS rcn_records, round(avg(price_per_m2), 2) AS avg_price_per_m2, round(avg(inflation_adjusted_price_per_m2), 2) AS avg_inflation_adjusted_price_per_m2, max(inflation_reference_year) AS inflation_reference_year
    FROM fx_prices WHERE run_id IN ('r0', 'r2') AND price_per_m2 IS NOT NULL GROUP BY parcel_id""")
def _(t):
    return prices.map_price_stats(t("fx_prices"), ["r0", "r2"])


TILES = """WITH located AS (SELECT * FROM fx_parcels WHERE centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL),
    o AS (SELECT min(centroid_lat) AS lat0, min(centroid_lon) AS lon0, avg(centroid_lat) AS mid FROM located),
    placed AS (SELECT p.*, CAST(floor((centroid_lat - lat0) / greatest(CAST(0.0001 AS DOUBLE), CAST(2 AS DOUBLE) / CAST(111.32 AS DOUBLE))) AS BIGINT) AS y,
        CAST(floor((centroid_lon - lon0) / greatest(CAST(0.0001 AS DOUBLE), CAST(2 AS DOUBLE) / greatest(CAST(1 AS DOUBLE), CAST(111.32 AS DOUBLE) * cos(radians(mid))))) AS BIGINT) AS x FROM located p CROSS JOIN o),
    tiles AS (SELECT y, x, count(*) AS parcels, avg(centroid_lat) AS lat, min(bbox_min_lon) AS w, min(bbox_min_lat) AS s, max(bbox_max_lon) AS e, max(bbox_max_lat) AS n FROM placed GROUP BY y, x),
    named AS (SELECT *, 'tile_' || lpad(CAST(row_number() OVER (ORDER BY y, x) AS VARCHAR), 6, '0') || '_' || CAST(y AS VARCHAR) || '_' || CAST(x AS VARCHAR) AS tile_id,
        CAST(50 AS DOUBLE) / CAST(111320 AS DOUBLE) AS dlat, CAST(50 AS DOUBLE) / greatest(CAST(1 AS DOUBLE), CAST(111320 AS DOUBLE) * cos(radians(lat))) AS dlon FROM tiles)
"""


@query("scan_tile_plan", ["fx_parcels"], TILES + """
    SELECT tile_id, parcels, round(w - dlon, 8) AS bbox_min_lon, round(s - dlat, 8) AS bbox_min_lat, round(e + dlon, 8) AS bbox_max_lon, round(n + dlat, 8) AS bbox_max_lat FROM named""")
def _(t):
    from acremark.operators.filters import fully_located

    return prices.scan_tiles(fully_located(t("fx_parcels")))[0].drop("y", "x")


@query("scan_tile_members", ["fx_parcels"], TILES + "SELECT n.tile_id, p.parcel_id FROM placed p JOIN named n ON n.y = p.y AND n.x = p.x")
def _(t):
    from acremark.operators.filters import fully_located

    return prices.scan_tiles(fully_located(t("fx_parcels")))[1]


@query("run_bbox_with_margin", ["fx_parcels", "fx_links"], """
    WITH u AS (SELECT l.run_id, min(bbox_min_lon) AS w, min(bbox_min_lat) AS s, max(bbox_max_lon) AS e, max(bbox_max_lat) AS n FROM fx_links l JOIN fx_parcels p ON p.parcel_id = l.parcel_id GROUP BY l.run_id)
    SELECT run_id, round(w - CAST(100 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians((s + n) / 2))), 8) AS min_lon, round(s - CAST(100 AS DOUBLE) / CAST(111320 AS DOUBLE), 8) AS min_lat,
      round(e + CAST(100 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians((s + n) / 2))), 8) AS max_lon, round(n + CAST(100 AS DOUBLE) / CAST(111320 AS DOUBLE), 8) AS max_lat FROM u""")
def _(t):
    box = prices.run_bbox(t("fx_parcels"), t("fx_links"), 100.0)
    return box.select("run_id", *[F.round(c, 8).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


def _scan(t):
    """A second scan: parcels with an order number not divisible by 4 were checked before, one tile in 3 fails now."""
    checked = t("fx_parcels").select(
        "parcel_id", F.when(F.col("parcel_number").cast("long") % 4 == 0, "error").otherwise("ok").alias("status"))
    checks = checked.where(F.substring("parcel_id", -1, 1) < "7")
    pending = incremental.pending_parcels(t("fx_parcels"), checks)
    from acremark.operators.filters import fully_located

    failed = prices.scan_tiles(fully_located(pending))[0].where("x % 3 = 0").select("tile_id", F.lit("timeout").alias("error"))
    return checks, analyses.price_scan(t("fx_parcels"), _records(t), "scan-2", t("fx_index"), checks, failed_tiles=failed)


SCAN = TILES.replace("WITH located AS (SELECT * FROM fx_parcels WHERE centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL)",
                     """WITH located AS (SELECT * FROM fx_parcels WHERE centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL
                       AND NOT (substr(parcel_id, 9, 1) < '7' AND CAST(parcel_number AS BIGINT) % 4 <> 0))""") + """,
    merged AS (SELECT * FROM fx_prices QUALIFY row_number() OVER (PARTITION BY source_record_id ORDER BY transaction_date DESC, parcel_id DESC, price_per_m2 DESC NULLS LAST) = 1),
    stats AS (SELECT parcel_id, count(*) AS c, count(*) FILTER (WHERE price_per_m2 > 0) AS priced FROM merged GROUP BY parcel_id),
    checked AS (SELECT p.parcel_id, n.tile_id, CASE WHEN n.x % 3 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n.x % 3 = 0 THEN 0 ELSE coalesce(s.c, 0) END AS rcn_records,
        CASE WHEN n.x % 3 = 0 THEN 0 ELSE coalesce(s.priced, 0) END AS priced_records
      FROM placed p JOIN named n ON n.y = p.y AND n.x = p.x LEFT JOIN stats s ON s.parcel_id = p.parcel_id)
"""


@query("price_scan_checks", ["fx_parcels", "fx_prices"], SCAN + "SELECT * FROM checked")
def _(t):
    return _scan(t)[1]["checks"].select("parcel_id", "tile_id", "status", "rcn_records", "priced_records")


@query("price_scan_totals", ["fx_parcels", "fx_prices"], SCAN + """
    SELECT (SELECT count(DISTINCT tile_id) FROM checked) AS tiles, (SELECT count(DISTINCT tile_id) FROM checked WHERE status = 'ok') AS ok_tiles, (SELECT count(DISTINCT tile_id) FROM checked WHERE status <> 'ok') AS error_tiles,
      count(*) AS selected_parcels, (SELECT count(*) FROM fx_prices) AS fetched_records, (SELECT count(*) FROM merged) AS stored_records,
      count(*) FILTER (WHERE status = 'ok') AS checked_parcels, count(*) FILTER (WHERE status = 'ok' AND priced_records > 0) AS priced_parcels, CASE WHEN count(*) FILTER (WHERE status <> 'ok') = 0 THEN 'ok' ELSE 'partial_error' END AS status FROM checked""")
def _(t):
    return _scan(t)[1]["totals"]


@query("pending_parcels", ["fx_parcels"], """
    SELECT parcel_id FROM fx_parcels WHERE NOT (substr(parcel_id, 9, 1) < '7' AND CAST(parcel_number AS BIGINT) % 4 <> 0)""")
def _(t):
    checks = t("fx_parcels").where(F.substring("parcel_id", -1, 1) < "7").select(
        "parcel_id", F.when(F.col("parcel_number").cast("long") % 4 == 0, "error").otherwise("ok").alias("status"))
    return incremental.pending_parcels(t("fx_parcels"), checks).select("parcel_id")


@query("missing_visual_features", ["fx_parcels", "fx_visual", "fx_links"], """
    SELECT DISTINCT p.parcel_id FROM fx_parcels p JOIN fx_links l ON l.parcel_id = p.parcel_id AND l.run_id = 'r1' LEFT JOIN fx_visual v ON v.parcel_id = p.parcel_id WHERE v.parcel_id IS NULL ORDER BY p.parcel_id LIMIT 400""")
def _(t):
    return incremental.missing_features(t("fx_parcels"), t("fx_visual"), t("fx_links"), "r1", 400)


@query("ids_of_run", ["fx_parcels", "fx_links"], "SELECT DISTINCT parcel_id FROM fx_links WHERE run_id = 'r1'")
def _(t):
    return incremental.pinned_ids(t("fx_parcels"), t("fx_links"), "r1")


# --- merges --------------------------------------------------------------------------------

ORDER = ["s1", "s2", "s3", "s4", "s5", "s6", "s7"]


@query("keyed_upsert", ["fx_prices"], """
    WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC, s6 DESC, s7 DESC) AS rn FROM fx_prices WHERE run_id <> 'r2') q WHERE rn = 1),
    new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC, s6 DESC, s7 DESC) AS rn FROM fx_prices WHERE run_id = 'r2') q WHERE rn = 1)
    SELECT source_record_id, run_id, transaction_date, price_pln FROM new
    UNION ALL SELECT source_record_id, run_id, transaction_date, price_pln FROM old WHERE source_record_id NOT IN (SELECT source_record_id FROM new)""")
def _(t):
    keys = ["source_record_id"]
    everything = t("fx_prices").select(*keys, "run_id", "transaction_date", "price_pln", *ORDER)
    stored = upsert.upsert(everything.limit(0), everything.where("run_id <> 'r2'"), keys, ORDER)
    return upsert.upsert(stored, everything.where("run_id = 'r2'"), keys, ORDER).drop(*ORDER)


@query("upsert_keeping_created_at", ["fx_artifacts"], """
    SELECT run_id, producer, artifact_type, artifact_key, arg_max(payload_json, id) AS payload_json, max(updated_at) AS updated_at, min(created_at) AS created_at FROM fx_artifacts GROUP BY 1, 2, 3, 4""")
def _(t):
    keys = ["run_id", "producer", "artifact_type", "artifact_key"]
    log = t("fx_artifacts")
    middle = log.agg((F.max("id") / 2).alias("m")).scalar()
    stored = upsert.upsert(log.limit(0), log.where(F.col("id") <= middle), keys, ["updated_at", "id"], keep=["created_at"])
    return upsert.upsert(stored, log.where(F.col("id") > middle), keys, ["updated_at", "id"], keep=["created_at"]).drop("id")


@query("parcel_and_vertices_replace", ["fx_points", "fx_parcels"], """
    SELECT p.parcel_id, count(v.parcel_id) AS vertices, CASE WHEN CAST(p.parcel_number AS BIGINT) % 10 = 0 THEN 'new' ELSE p.parcel_number END AS parcel_number
    FROM fx_parcels p JOIN fx_points v ON v.parcel_id = p.parcel_id AND NOT (CAST(p.parcel_number AS BIGINT) % 10 = 0 AND v.point_index = 2) GROUP BY p.parcel_id, p.parcel_number""")
def _(t):
    parcels, points = t("fx_parcels").select("parcel_id", "parcel_number"), t("fx_points")
    # every tenth parcel arrives twice: a stale version 1 and, without its third vertices, version 2
    tenth = parcels.where(F.col("parcel_number").cast("long") % 10 == 0)
    versions = tenth.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "parcel_number", F.when(F.col("v") == 2, "new").otherwise("old"))
    vertices = points.join(tenth.select("parcel_id"), "parcel_id", "left_semi").withColumn(
        "v", F.explode(F.array(F.lit(1), F.lit(2)))).where("v = 1 OR point_index <> 2")
    merged, merged_points = upsert.upsert_parcels(parcels, points, versions, vertices, "v")
    return merged.join(merged_points.groupBy("parcel_id").agg(F.count("*").alias("vertices")), "parcel_id")


@query("links_insert_if_absent", ["fx_links"], """
    WITH old AS (SELECT run_id, parcel_id FROM fx_links WHERE candidate_index <= 5),
    new AS (SELECT run_id, parcel_id, min(candidate_index) AS candidate_index FROM (SELECT run_id, parcel_id, candidate_index FROM fx_links WHERE candidate_index > 3 UNION ALL SELECT 'r9', parcel_id, candidate_index FROM fx_links) q GROUP BY run_id, parcel_id)
    SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.run_id = n.run_id AND o.parcel_id = n.parcel_id)""")
def _(t):
    links = t("fx_links").select("run_id", "parcel_id", "candidate_index")
    batch = links.where("candidate_index > 3").unionByName(links.withColumn("run_id", F.lit("r9")))
    return analyses.store_links(links.where("candidate_index <= 5"), batch)


@query("replace_one_run", ["fx_links"], """
    SELECT run_id, count(*) AS n, count(*) FILTER (WHERE candidate_index = 99) AS rewritten FROM (
      SELECT run_id, candidate_index FROM fx_links WHERE run_id <> 'r1' UNION ALL SELECT run_id, 99 FROM fx_links WHERE run_id = 'r1' AND candidate_index < 9) q GROUP BY run_id""")
def _(t):
    path = scratch_path(t.spark, "links")
    links = t("fx_links")
    links.write.partitionBy("run_id").parquet(path)
    again = links.where("run_id = 'r1' AND candidate_index < 9").withColumn("candidate_index", F.lit(99))
    upsert.replace_runs(again, path)
    return t.spark.read.parquet(path).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("candidate_index") == 99).alias("rewritten"))


@query("clear_run_tables", ["fx_links", "fx_cells"], """
    SELECT 'links' AS "table", (SELECT count(*) FROM fx_links) AS before, CAST(0 AS BIGINT) AS after UNION ALL SELECT 'cells', (SELECT count(*) FROM fx_cells), CAST(0 AS BIGINT)""")
def _(t):
    paths = {}
    for name in ("links", "cells"):
        paths[name] = scratch_path(t.spark, f"helper-{name}")
        t(f"fx_{name}").write.parquet(paths[name])
    return upsert.clear_tables(t.spark, paths)


@query("read_with_missing_columns", ["fx_prices"], """
    SELECT source_record_id, run_id, count(*) AS n, count(inflation_factor) AS with_factor, max(state) AS state FROM (
      SELECT source_record_id, run_id, CASE WHEN run_id = 'r0' THEN NULL ELSE inflation_factor END AS inflation_factor, 'new' AS state FROM fx_prices) q GROUP BY 1, 2""")
def _(t):
    from acremark.sources.tables import stored_table

    path = scratch_path(t.spark, "evolved")
    rows = t("fx_prices").select("source_record_id", "run_id", "inflation_factor")
    rows.where("run_id = 'r0'").drop("inflation_factor").write.parquet(f"{path}/part=old")
    rows.where("run_id <> 'r0'").write.parquet(f"{path}/part=now")
    stored = upsert.with_missing_columns(stored_table(t.spark, path), {"state": ("string", "new"), "run_id": ("string", "")})
    return stored.groupBy("source_record_id", "run_id").agg(
        F.count("*").alias("n"), F.count("inflation_factor").alias("with_factor"), F.max("state").alias("state"))


# --- quality -------------------------------------------------------------------------------


@query("duplicate_keys", ["fx_prices"], "SELECT source_record_id, run_id, count(*) AS n FROM fx_prices GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return quality.duplicate_keys(t("fx_prices"), ["source_record_id", "run_id"])


@query("orphan_links", ["fx_links", "fx_parcels"], "SELECT run_id, parcel_id FROM fx_links l WHERE NOT EXISTS (SELECT 1 FROM fx_parcels p WHERE p.parcel_id = l.parcel_id)")
def _(t):
    return quality.orphans(t("fx_links"), t("fx_parcels"), "parcel_id").select("run_id", "parcel_id")


@query("rows_without_run", ["fx_cells"], "SELECT count(*) AS breaches FROM fx_cells WHERE category = 'shop_supermarket'")
def _(t):
    damaged = t("fx_cells").withColumn("run_id", F.when(F.col("category") == "shop_supermarket", F.when(F.col("score") > 2, "")).otherwise(F.col("run_id")))
    return quality.missing_or_empty(damaged, "run_id")


@query("missing_features_as_difference", ["fx_parcels", "fx_visual"], "SELECT parcel_id FROM fx_parcels EXCEPT SELECT parcel_id FROM fx_visual")
def _(t):
    return quality.missing_names(t("fx_parcels"), t("fx_visual"), "parcel_id")


@query("table_row_counts", ["fx_parcels", "fx_links", "fx_cells"], """
    SELECT 'parcels' AS "table", count(*) AS rows FROM fx_parcels UNION ALL SELECT 'links', count(*) FROM fx_links UNION ALL SELECT 'cells', count(*) FROM fx_cells""")
def _(t):
    return quality.table_counts({"parcels": t("fx_parcels"), "links": t("fx_links"), "cells": t("fx_cells")})


@query("validation_report", ["fx_osm", "fx_cells", "fx_parcels", "fx_links", "fx_prices", "fx_visual"], """
    SELECT * FROM (
      SELECT 'canon_parcels' AS "table", 'missing_column' AS "check", 'geometry_hash' AS detail, CAST(1 AS BIGINT) AS breaches
      UNION ALL SELECT 'canon_parcel_polygon_points', 'missing_table', 'canon_parcel_polygon_points', 1
      UNION ALL SELECT 'helper_layer2_run_parcels', 'orphan', 'canon_parcels', (SELECT count(*) FROM fx_links WHERE parcel_id NOT IN (SELECT parcel_id FROM fx_parcels))
      UNION ALL SELECT 'canon_rcn_price_observations', 'missing_column', c, 1 FROM (VALUES ('source'), ('raw_json'), ('inflation_adjusted_price_pln')) AS m(c)
      UNION ALL SELECT 'deriv_parcel_visual_features', 'missing_column', c, 1 FROM (VALUES ('source_geometry_hash'), ('image_source'), ('algorithm_version'), ('rgb_r_mean'), ('rgb_g_mean'), ('rgb_b_mean')) AS m(c)
      UNION ALL SELECT 'deriv_parcel_visual_features', 'forbidden_column', 'area_m2', 1) q WHERE breaches > 0""")
def _(t):
    tables = {
        "canon_osm_features": t("fx_osm"), "helper_osm_hotspot_mesh_cells": t("fx_cells"), "canon_parcels": t("fx_parcels"),
        "helper_layer2_run_parcels": t("fx_links"), "canon_rcn_price_observations": t("fx_prices"),
        "deriv_parcel_visual_features": t("fx_visual").withColumn("area_m2", F.lit(1.0)),
    }
    return quality.validate(t.spark, tables, {"links", "prices", "visual"})


# --- streams -------------------------------------------------------------------------------


@query("page_log_rollup", ["fx_pages"], """
    SELECT county_code, count(*) AS pages, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(inserted_or_updated) AS BIGINT) AS inserted_or_updated, CAST(sum(skipped_unchanged) AS BIGINT) AS skipped_unchanged,
      CAST(sum(errors) AS BIGINT) AS errors, CASE WHEN sum(errors) > 0 THEN 'error' ELSE 'ok' END AS status FROM fx_pages GROUP BY county_code""")
def _(t):
    return incremental.page_rollup(t("fx_pages"))


@query("page_log_totals", ["fx_pages"], """
    WITH c AS (SELECT county_code, sum(fetched) AS f, sum(inserted_or_updated) AS i, sum(skipped_unchanged) AS s, sum(errors) AS e FROM fx_pages GROUP BY county_code)
    SELECT count(*) AS counties, count(*) FILTER (WHERE e = 0) AS ok_counties, count(*) FILTER (WHERE e > 0) AS error_counties, CAST(sum(f) AS BIGINT) AS fetched_total, CAST(sum(i) AS BIGINT) AS inserted_or_updated_total,
      CAST(sum(s) AS BIGINT) AS skipped_unchanged_total, CAST(sum(e) AS BIGINT) AS errors_total FROM c""")
def _(t):
    return incremental.page_totals(incremental.page_rollup(t("fx_pages")))


@query("page_log_stream", ["fx_pages"], """
    SELECT county_code, count(*) AS pages, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(inserted_or_updated) AS BIGINT) AS inserted_or_updated, CAST(sum(skipped_unchanged) AS BIGINT) AS skipped_unchanged,
      CAST(sum(errors) AS BIGINT) AS errors, CASE WHEN sum(errors) > 0 THEN 'error' ELSE 'ok' END AS status FROM fx_pages GROUP BY county_code""")
def _(t):
    """The log as JSON lines, read as a stream; the running report is kept as a table."""
    logs, out, marks = (scratch_path(t.spark, n) for n in ("page-log", "page-report", "page-marks"))
    t("fx_pages").write.json(logs)
    report = incremental.page_rollup(incremental.read_page_log(t.spark, logs))
    stream = (
        report.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True)
        .foreachBatch(lambda batch, n: incremental.merge_into(batch, out, ["county_code"], ["pages"], buckets=4)).start()
    )
    stream.awaitTermination()
    return incremental.read_table(t.spark, out)


@query("artifact_stream_upsert", ["fx_artifacts"], """
    SELECT run_id, artifact_type, artifact_key, max(id) AS id, arg_max(payload_json, id) AS payload_json FROM fx_artifacts GROUP BY 1, 2, 3""")
def _(t):
    """Batches of published artifacts merged as they land, several files per type and not in order of age."""
    landed, out, marks = (scratch_path(t.spark, n) for n in ("landed", "artifacts", "marks"))
    source = t("fx_artifacts")
    source.repartition(6, "id").write.partitionBy("artifact_type").parquet(landed)
    stream = t.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    incremental.stream_upsert(stream, out, ["run_id", "artifact_type", "artifact_key"], ["updated_at", "id"], marks, buckets=4,
                              newest_wins=True).awaitTermination()
    return incremental.read_table(t.spark, out).select("run_id", "artifact_type", "artifact_key", "id", "payload_json")


@query("parcel_stream_replace", ["fx_points"], """
    WITH again AS (SELECT DISTINCT parcel_id FROM fx_points WHERE CAST(substr(parcel_id, 9, 1) AS INT) % 2 = 0),
    kept AS (SELECT p.*, a.parcel_id IS NOT NULL AS newer FROM fx_points p LEFT JOIN again a ON a.parcel_id = p.parcel_id
      WHERE a.parcel_id IS NULL OR (polygon_index = 0 AND ring_index = 0))
    SELECT parcel_id, max(CASE WHEN newer THEN 2 ELSE 1 END) AS seen, count(*) AS points, round(sum(lon), 6) AS lon_sum, round(sum(lat), 6) AS lat_sum
    FROM kept GROUP BY parcel_id""")
def _(t):
    """Landed parcels as a stream, every second one twice with fewer rings: parcels and vertices of one version of the store."""
    land, store, marks = (scratch_path(t.spark, n) for n in ("landed-parcels", "parcels", "marks"))
    corner = F.struct("polygon_index", "ring_index", "point_index", "lon", "lat")
    first = t("fx_points").groupBy("parcel_id").agg(F.sort_array(F.collect_list(corner)).alias("polygons")).withColumn("seen", F.lit(1))
    again = first.where(F.substring("parcel_id", 9, 1).cast("int") % 2 == 0).select(
        "parcel_id", F.filter("polygons", lambda c: (c["polygon_index"] == 0) & (c["ring_index"] == 0)).alias("polygons"), F.lit(2).alias("seen"))
    for batch in (first, again):
        batch.write.mode("append").parquet(land)
    stream = t.spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 4).parquet(land)
    incremental.stream_parcels(stream, store, marks, "seen", lambda rows: rows.select("parcel_id", F.inline("polygons")), buckets=8).awaitTermination()
    counted = incremental.read_table(t.spark, store, "points").groupBy("parcel_id").agg(
        F.count("*").alias("points"), F.round(F.sum("lon"), 6).alias("lon_sum"), F.round(F.sum("lat"), 6).alias("lat_sum"))
    return incremental.read_table(t.spark, store, "parcels").join(counted, "parcel_id")


@query("page_log_windows", ["fx_pages"], """
    SELECT CAST(epoch(date_trunc('hour', time)) AS BIGINT) AS window_start, county_code, count(*) AS pages, CAST(sum(fetched) AS BIGINT) AS fetched,
      CAST(sum(inserted_or_updated) AS BIGINT) AS inserted_or_updated, CAST(sum(skipped_unchanged) AS BIGINT) AS skipped_unchanged, CAST(sum(errors) AS BIGINT) AS errors
    FROM fx_pages WHERE time IS NOT NULL GROUP BY 1, 2""")
def _(t):
    """The log as a stream in event time: hourly windows with a watermark, kept as a stored table."""
    logs, store, marks = (scratch_path(t.spark, n) for n in ("page-log", "page-windows", "marks"))
    t("fx_pages").write.json(logs)
    incremental.stream_page_windows(incremental.read_page_log(t.spark, logs), store, marks, "1 hour", "1 day").awaitTermination()
    return incremental.read_table(t.spark, store).drop("window_end").withColumn("window_start", F.unix_timestamp("window_start"))
