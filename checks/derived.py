"""Domain tables derived from the given tables, as SQL text that Spark and DuckDB both run.

The same text feeds both sides, so a difference in a result is a difference in an operator.
"""

from __future__ import annotations

import os
import re

# name -> (tables it reads, SELECT)
TABLES: dict[str, tuple[list[str], str]] = {
    # k: order key. A 200-column lattice of parcels; sizes vary with k.
    "fx_lots": (
        ["orders", "customer", "nation", "region"],
        """
        SELECT o.o_orderkey AS k,
               'P' || lpad(CAST(o.o_orderkey AS VARCHAR(20)), 8, '0') AS parcel_id,
               CAST(16 AS DOUBLE) + CAST(o.o_orderkey % 200 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lon0,
               CAST(50 AS DOUBLE) + CAST(floor(o.o_orderkey / 200) AS DOUBLE) * CAST(0.0015 AS DOUBLE) AS lat0,
               CAST(0.0004 AS DOUBLE) + CAST(o.o_orderkey % 7 AS DOUBLE) * CAST(0.0002 AS DOUBLE) AS w,
               CAST(0.0003 AS DOUBLE) + CAST(o.o_orderkey % 5 AS DOUBLE) * CAST(0.0002 AS DOUBLE) AS h,
               r.r_name AS voivodeship, n.n_name AS county,
               n.n_name || '/' || CAST(o.o_orderkey % 10 AS VARCHAR(20)) AS commune,
               n.n_name || '/' || CAST(o.o_orderkey % 10 AS VARCHAR(20)) || '-' || CAST(o.o_orderkey % 3 AS VARCHAR(20)) AS precinct
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
        """,
    ),
    # area, precinct and centroid are missing on some rows
    "fx_parcels": (
        ["fx_lots"],
        """
        SELECT parcel_id, CAST(k AS VARCHAR(20)) AS parcel_number, voivodeship, county, commune,
               CASE WHEN k % 97 = 0 THEN NULL ELSE precinct END AS precinct,
               CASE WHEN k % 89 = 0 THEN NULL ELSE
                 round(w * CAST(111320 AS DOUBLE) * cos(radians(lat0 + h / CAST(2 AS DOUBLE))) * h * CAST(111320 AS DOUBLE), 2)
               END AS area_m2,
               CASE WHEN k % 101 = 0 THEN NULL ELSE lat0 + h / CAST(2 AS DOUBLE) END AS centroid_lat,
               CASE WHEN k % 101 = 0 THEN NULL ELSE lon0 + w / CAST(2 AS DOUBLE) END AS centroid_lon,
               lat0 AS bbox_min_lat, lon0 AS bbox_min_lon, lat0 + h AS bbox_max_lat,
               CASE WHEN k % 13 = 0 THEN lon0 + CAST(0.0019 AS DOUBLE) ELSE lon0 + w END AS bbox_max_lon
        FROM fx_lots
        """,
    ),
    # ring 0 outer; every 11th a hole; every 13th a second polygon; every 17th unclosed; every 19th reversed
    "fx_points": (
        ["fx_lots"],
        """
        SELECT parcel_id, CAST(0 AS INT) AS polygon_index, CAST(0 AS INT) AS ring_index,
               CASE WHEN k % 19 = 0 THEN CAST(4 - i AS INT) ELSE CAST(i AS INT) END AS point_index,
               CASE WHEN i = 1 OR i = 2 THEN lon0 + w ELSE lon0 END AS lon,
               CASE WHEN i = 2 OR i = 3 THEN lat0 + h ELSE lat0 END AS lat
        FROM fx_lots CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(i)
        WHERE NOT (k % 17 = 0 AND i = 4)
        UNION ALL
        SELECT parcel_id, CAST(0 AS INT), CAST(1 AS INT), CAST(i AS INT),
               CASE WHEN i = 1 OR i = 2 THEN lon0 + w * CAST(0.75 AS DOUBLE) ELSE lon0 + w * CAST(0.25 AS DOUBLE) END,
               CASE WHEN i = 2 OR i = 3 THEN lat0 + h * CAST(0.75 AS DOUBLE) ELSE lat0 + h * CAST(0.25 AS DOUBLE) END
        FROM fx_lots CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(i) WHERE k % 11 = 0
        UNION ALL
        SELECT parcel_id, CAST(1 AS INT), CAST(0 AS INT), CAST(i AS INT),
               lon0 + CASE WHEN i = 1 OR i = 2 THEN CAST(0.0019 AS DOUBLE) ELSE CAST(0.0017 AS DOUBLE) END,
               lat0 + CASE WHEN i = 2 OR i = 3 THEN CAST(0.0002 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
        FROM fx_lots CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(i) WHERE k % 13 = 0
        """,
    ),
    "fx_osm": (
        ["events"],
        """
        SELECT osm_type, osm_id, fetched_at, tag_key, tag_value, name, second_tag, lat AS center_lat, lon AS center_lon,
               CASE WHEN osm_type = 'relation' THEN NULL WHEN osm_type = 'way' THEN lat - CAST(0.0005 AS DOUBLE) ELSE lat END AS bbox_min_lat,
               CASE WHEN osm_type = 'relation' THEN NULL WHEN osm_type = 'way' THEN lon - CAST(0.0005 AS DOUBLE) ELSE lon END AS bbox_min_lon,
               CASE WHEN osm_type = 'relation' THEN NULL WHEN osm_type = 'way' THEN lat + CAST(0.0005 AS DOUBLE) ELSE lat END AS bbox_max_lat,
               CASE WHEN osm_type = 'relation' THEN NULL WHEN osm_type = 'way' THEN lon + CAST(0.0005 AS DOUBLE) ELSE lon END AS bbox_max_lon,
               '{"' || tag_key || '":"' || tag_value || '","name":"' || name || '"'
                 || CASE WHEN second_tag THEN ',"tourism":"viewpoint"' ELSE '' END || '}' AS tags_json
        FROM (
          SELECT CASE WHEN event_id % 10 < 8 THEN 'node' WHEN event_id % 10 = 8 THEN 'way' ELSE 'relation' END AS osm_type,
                 event_id AS osm_id, ts AS fetched_at,
                 CASE event_type WHEN 'view' THEN 'tourism' WHEN 'purchase' THEN 'shop' ELSE 'amenity' END AS tag_key,
                 CASE event_type WHEN 'click' THEN 'cafe' WHEN 'view' THEN 'viewpoint' WHEN 'purchase' THEN 'supermarket'
                      WHEN 'signup' THEN 'restaurant' ELSE 'school' END AS tag_value,
                 'n' || CAST(event_id AS VARCHAR(20)) AS name,
                 (event_id % 23 = 0 AND event_type <> 'view') AS second_tag,
                 CAST(50 AS DOUBLE) + CAST((event_id * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.11 AS DOUBLE) AS lat,
                 CAST(16 AS DOUBLE) + CAST((event_id * 104729) % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE) * CAST(0.4 AS DOUBLE) AS lon
          FROM events) e
        """,
    ),
    # price records as text, the way they land; record ids repeat
    "fx_price_text": (
        ["lineitem"],
        """
        SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS gml_id,
               'P' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') AS parcel_id,
               CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)) AS transaction_date,
               CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE replace(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || '.' || CAST(l_suppkey % 10 AS VARCHAR(20)) || '37', '.', ',') END AS parcel_area,
               CAST(CAST(l_quantity AS INT) * 151 AS VARCHAR(20)) AS property_area,
               CASE WHEN l_returnflag = 'R' THEN '' ELSE ' ' || CAST(CAST(floor(l_extendedprice / 1000) AS INT) AS VARCHAR(20)) || ' ' || lpad(CAST(CAST(floor(l_extendedprice) AS INT) % 1000 AS VARCHAR(20)), 3, '0') END AS parcel_price,
               CASE WHEN l_linestatus = 'F' THEN CAST(CAST(floor(l_extendedprice) AS INT) AS VARCHAR(20)) ELSE 'n/a' END AS property_price,
               'r' || CAST(l_suppkey % 3 AS VARCHAR(20)) AS run_id,
               l_shipdate AS s1, l_partkey AS s2, l_suppkey AS s3, l_extendedprice AS s4, l_quantity AS s5, l_discount AS s6, l_tax AS s7
        FROM lineitem
        """,
    ),
    # the index: 1999 is missing on purpose
    "fx_index": (
        [],
        """
        SELECT y AS year, CAST(v AS DOUBLE) AS index_value
        FROM (VALUES ('1995', 100), ('1996', 112), ('1997', 125), ('1998', 139), ('2000', 161), ('2001', 170)) AS t(y, v)
        """,
    ),
    # cleaned and inflation-adjusted price observations
    "fx_prices": (
        ["fx_price_text", "fx_index"],
        """
        SELECT gml_id AS source_record_id, parcel_id, run_id, transaction_date, s1, s2, s3, s4, s5, s6, s7,
               area_m2, price_pln, price_pln / area_m2 AS price_per_m2, f AS inflation_factor,
               CASE WHEN f IS NULL THEN NULL ELSE '2001' END AS inflation_reference_year,
               price_pln / area_m2 * f AS inflation_adjusted_price_per_m2
        FROM (
          SELECT t.*, CAST(170 AS DOUBLE) / i.index_value AS f,
                 CASE WHEN s5 < 100 AND parcel_area <> '' THEN CAST(replace(parcel_area, ',', '.') AS DOUBLE) * CAST(10000 AS DOUBLE)
                      ELSE CAST(property_area AS DOUBLE) END AS area_m2,
                 CASE WHEN parcel_price <> '' THEN CAST(replace(parcel_price, ' ', '') AS DOUBLE)
                      WHEN property_price <> 'n/a' THEN CAST(property_price AS DOUBLE) END AS price_pln
          FROM fx_price_text t LEFT JOIN fx_index i ON i.year = substr(t.transaction_date, 1, 4)) q
        """,
    ),
    # hotspot cells of three runs: the 20 x 20 grid over features of the run
    "fx_cells": (
        ["fx_osm"],
        """
        SELECT run_id || '_' || lpad(CAST(x AS VARCHAR(20)), 2, '0') || lpad(CAST(y AS VARCHAR(20)), 2, '0') || '_' || category AS cell_id,
               run_id, category, tag_key, tag_value, CAST(count(*) AS BIGINT) AS point_count, CAST(count(*) AS DOUBLE) AS score,
               CAST(50 AS DOUBLE) + CAST(0.11 AS DOUBLE) * CAST(y AS DOUBLE) / CAST(20 AS DOUBLE) AS bbox_min_lat,
               CAST(16 AS DOUBLE) + CAST(0.4 AS DOUBLE) * CAST(x AS DOUBLE) / CAST(20 AS DOUBLE) AS bbox_min_lon,
               CAST(50 AS DOUBLE) + CAST(0.11 AS DOUBLE) * CAST(y + 1 AS DOUBLE) / CAST(20 AS DOUBLE) AS bbox_max_lat,
               CAST(16 AS DOUBLE) + CAST(0.4 AS DOUBLE) * CAST(x + 1 AS DOUBLE) / CAST(20 AS DOUBLE) AS bbox_max_lon
        FROM (
          SELECT 'r' || CAST(osm_id % 3 AS VARCHAR(20)) AS run_id, tag_key, tag_value, tag_key || '_' || tag_value AS category,
                 CAST(least(CAST(19 AS DOUBLE), floor((center_lon - CAST(16 AS DOUBLE)) / CAST(0.4 AS DOUBLE) * CAST(20 AS DOUBLE))) AS INT) AS x,
                 CAST(least(CAST(19 AS DOUBLE), floor((center_lat - CAST(50 AS DOUBLE)) / CAST(0.11 AS DOUBLE) * CAST(20 AS DOUBLE))) AS INT) AS y
          FROM fx_osm) g
        GROUP BY run_id, category, tag_key, tag_value, x, y
        """,
    ),
    # parcels linked to runs: order key and run agree on a remainder; one in 50 links is an orphan
    "fx_links": (
        ["fx_lots"],
        """
        SELECT 'r' || CAST(k % 3 AS VARCHAR(20)) AS run_id,
               CASE WHEN k % 50 = 0 THEN 'X' ELSE '' END || parcel_id AS parcel_id,
               CAST(k % 20 + 1 AS INT) AS candidate_index, 'box' || CAST(k % 20 AS VARCHAR(20)) AS source_bbox
        FROM fx_lots WHERE k % 4 <> 1
        UNION ALL
        SELECT 'r' || CAST((k + 1) % 3 AS VARCHAR(20)), parcel_id, CAST(k % 20 + 1 AS INT), 'box' || CAST(k % 20 AS VARCHAR(20))
        FROM fx_lots WHERE k % 9 = 0
        """,
    ),
    # imagery figures per parcel, from order amounts; missing on some parcels
    "fx_visual": (
        ["orders"],
        """
        SELECT 'P' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0') AS parcel_id,
               CAST(o_orderkey % 400 AS BIGINT) + 1 AS masked_pixel_count, CAST(1 AS INT) AS tile_count, CAST(18 AS INT) AS zoom,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS green_pixel_ratio,
               CAST(o_orderkey % 41 AS DOUBLE) / CAST(100 AS DOUBLE) AS dark_pixel_ratio,
               CAST(o_orderkey % 31 AS DOUBLE) / CAST(100 AS DOUBLE) AS bright_pixel_ratio,
               CAST(o_orderkey % 61 AS DOUBLE) / CAST(100 AS DOUBLE) AS low_saturation_ratio,
               CAST(50 + o_orderkey % 150 AS DOUBLE) AS brightness_mean,
               CAST(o_orderkey % 37 AS DOUBLE) / CAST(50 AS DOUBLE) AS green_index_mean
        FROM orders WHERE o_orderkey % 6 <> 0
        """,
    ),
    # shape figures per parcel as the moment operator gives them for plain rectangles
    "fx_shape": (
        ["fx_lots"],
        """
        SELECT parcel_id, round(a * b, 2) AS area_m2, round(CAST(2 AS DOUBLE) * (a + b), 3) AS perimeter_m,
               round(CAST(4 AS DOUBLE) * pi() * a * b / (CAST(4 AS DOUBLE) * (a + b) * (a + b)), 6) AS compactness,
               round(greatest(a, b) / least(a, b), 6) AS elongation_ratio,
               round(least(a * b * b * b, b * a * a * a) / CAST(12 AS DOUBLE), 0) AS principal_moment_min_m4,
               round(greatest(a * b * b * b, b * a * a * a) / CAST(12 AS DOUBLE), 0) AS principal_moment_max_m4
        FROM (SELECT parcel_id, k, w * CAST(111320 AS DOUBLE) * cos(radians(CAST(50.5 AS DOUBLE))) AS a, h * CAST(111320 AS DOUBLE) AS b
              FROM fx_lots) q
        WHERE k % 8 <> 0
        """,
    ),
    # each embedding is one 8 x 8 tile; element i of the vector gives pixel i
    "fx_pixels": (
        ["embeddings"],
        """
        SELECT CAST(18 AS INT) AS z, CAST(vec_id % 25 AS BIGINT) AS x, CAST(floor(vec_id / 25) AS BIGINT) AS y,
               CAST(i % 8 AS INT) AS px, CAST(floor(i / 8) AS INT) AS py,
               CAST(CAST(floor(abs(CAST(embedding[i + {one}] AS DOUBLE)) * CAST(1000 AS DOUBLE)) AS BIGINT) % 256 AS INT) AS r,
               CAST(CAST(floor(abs(CAST(embedding[(i + 1) % 64 + {one}] AS DOUBLE)) * CAST(1000 AS DOUBLE)) AS BIGINT) % 256 AS INT) AS g,
               CAST(CAST(floor(abs(CAST(embedding[(i + 2) % 64 + {one}] AS DOUBLE)) * CAST(1000 AS DOUBLE)) AS BIGINT) % 256 AS INT) AS b
        FROM embeddings CROSS JOIN (SELECT t * 8 + o AS i
             FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS a(t) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS c(o)) AS q
        """,
    ),
    # trails: a customer's orders in key order, as points
    "fx_ways": (
        ["orders"],
        """
        SELECT o_custkey AS way_id, o_orderkey AS k,
               CAST(50 AS DOUBLE) + CAST(o_orderkey % 40 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS lat,
               CAST(16 AS DOUBLE) + CAST(floor(o_orderkey / 40) % 60 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS lon,
               CASE WHEN o_custkey % 5 < 3 THEN 'path' WHEN o_custkey % 5 = 3 THEN 'track' ELSE 'road' END AS highway,
               CASE WHEN o_custkey % 7 = 0 THEN 'T1' WHEN o_custkey % 7 = 1 THEN 'T4' ELSE '' END AS sac_scale
        FROM orders
        """,
    ),
    "fx_artifacts": (
        ["events"],
        """
        SELECT event_id AS id, 'u' || CAST(user_id % 5 AS VARCHAR(20)) AS run_id, 'make_' || event_type AS producer,
               event_type AS artifact_type, 'key' || CAST(user_id % 3 AS VARCHAR(20)) AS artifact_key,
               props AS payload_json, ts AS created_at, ts AS updated_at
        FROM events
        """,
    ),
    # page log of an ingest: one row per fetched page
    "fx_pages": (
        ["events"],
        """
        SELECT event_id AS page, ts AS time, 'c' || lpad(CAST(user_id % 30 AS VARCHAR(20)), 2, '0') AS county_code,
               CAST(floor(value) AS BIGINT) AS fetched, CAST(floor(value / 2) AS BIGINT) AS inserted_or_updated,
               CAST(floor(value) - floor(value / 2) AS BIGINT) AS skipped_unchanged,
               CASE WHEN event_type = 'error' AND user_id % 30 < 3 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS errors
        FROM events
        """,
    ),
}


def _with(names: list[str]) -> list[str]:
    """Derived tables needed for these, in dependency order."""
    ordered: list[str] = []

    def visit(name: str):
        if name in TABLES and name not in ordered:
            for parent in TABLES[name][0]:
                visit(parent)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _base_tables(names: list[str]) -> list[str]:
    return sorted({p for n in names for p in TABLES[n][0] if p not in TABLES})


def oracle(names: list[str], body: str) -> str:
    """DuckDB SQL: the derived tables as CTEs and then ``body`` (which may start with more CTEs)."""
    ctes = [f"{n} AS ({TABLES[n][1].replace('{one}', '1')})" for n in _with(names)]
    text = body.strip()
    if not ctes:
        return text
    words = re.match(r"WITH(\s+RECURSIVE)?\s", text, re.IGNORECASE)
    if not words:
        return "WITH " + ",\n".join(ctes) + "\n" + text
    head = "WITH RECURSIVE " if words.group(1) else "WITH "
    return head + "".join(c + ",\n" for c in ctes) + text[words.end() :]


def frame(spark, sf_dir: str, name: str):
    """The derived (or given) table as a Spark DataFrame."""
    if name not in TABLES:
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    needed = _with([name])
    given = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in _base_tables(needed)]
    ctes = given + [f"{n} AS ({TABLES[n][1].replace('{one}', '0')})" for n in needed]
    return spark.sql("WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}")
