"""Scans of landed formats: each query lands derived rows in the format and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from acremark.functions import geo, text
from acremark.operators import geometry
from acremark.operators.prices import RECORD_FIELDS
from acremark.session import cut_lineage, scratch_path
from acremark.sources import osm, parcels, tables
from checks.catalog import query
from checks.q_prices import _records

# how an element was drawn: nodes carry a position, ways bounds or geometry, relations a centre
KIND = "CASE WHEN osm_type = 'node' THEN 'own' WHEN osm_type = 'relation' THEN 'centre' WHEN osm_id % 20 = 8 THEN 'bounds' ELSE 'drawn' END"
D5 = "CAST(0.0005 AS DOUBLE)"


def _land_osm(t):
    lat, lon, d = F.col("center_lat"), F.col("center_lon"), F.lit(0.0005)
    kind = F.expr(KIND)
    point = F.struct(lat.alias("lat"), lon.alias("lon"))
    corner = F.struct((lat - d).alias("lat"), (lon - d).alias("lon"))
    far = F.struct((lat + d).alias("lat"), (lon + d).alias("lon"))
    tags = F.from_json("tags_json", "map<string,string>")
    element = F.to_json(F.struct(
        F.col("osm_type").alias("type"), F.col("osm_id").alias("id"),
        F.when(kind == "own", lat).alias("lat"), F.when(kind == "own", lon).alias("lon"),
        F.when(kind == "centre", point).alias("center"),
        F.when(kind == "bounds", F.struct((lat - d).alias("minlat"), (lon - d).alias("minlon"), (lat + d).alias("maxlat"), (lon + d).alias("maxlon"))).alias("bounds"),
        F.when(kind == "drawn", F.array(corner, far, point)).alias("geometry"),
        tags.alias("tags"),
    ))
    # responses of at most 500 elements, one file each
    pages = t("fx_osm").select(F.floor(F.col("osm_id") / 500).alias("page"), element.alias("e")).groupBy("page").agg(F.collect_list("e").alias("es"))
    body = F.concat(F.lit('{"version":0.6,\t"elements":['), F.array_join("es", ","), F.lit("]}"))
    path = scratch_path(t.spark, "osm")
    pages.select(body.alias("value"), "page").write.partitionBy("page").text(path)
    return osm.scan_osm_json(t.spark, path)


@query("osm_json_normalised", ["fx_osm"], f"""
    SELECT osm_type, osm_id, round(center_lat, 9) AS center_lat, round(center_lon, 9) AS center_lon,
      round(CASE WHEN osm_type = 'way' THEN center_lat - {D5} ELSE center_lat END, 9) AS bbox_min_lat, round(CASE WHEN osm_type = 'way' THEN center_lon + {D5} ELSE center_lon END, 9) AS bbox_max_lon,
      CASE tag_key WHEN 'amenity' THEN '{{"amenity":"' || tag_value || '","name":"' || name || '"' || CASE WHEN second_tag THEN ',"tourism":"viewpoint"' ELSE '' END || '}}'
        ELSE '{{"name":"' || name || '","' || tag_key || '":"' || tag_value || '"' || CASE WHEN second_tag THEN ',"tourism":"viewpoint"' ELSE '' END || '}}' END AS tags_json,
      osm_type <> 'node' AS has_geometry
    FROM fx_osm""")
def _(t):
    rows = osm.normalize_elements(_land_osm(t))
    return rows.select("osm_type", "osm_id", *[F.round(c, 9).alias(c) for c in ("center_lat", "center_lon", "bbox_min_lat", "bbox_max_lon")],
                       "tags_json", F.col("geometry_json").isNotNull().alias("has_geometry"))


@query("osm_preview", ["fx_osm"], f"""
    SELECT osm_type AS type, osm_id AS id, CASE WHEN {KIND} IN ('own', 'centre') THEN round(center_lat, 9) END AS lat, name FROM fx_osm""")
def _(t):
    return osm.preview_elements(_land_osm(t)).select("type", "id", F.round("lat", 9).alias("lat"), "name")


def _land_xml(t, rows, label):
    """Rows of XML text as feature collections, one file per page as the service hands them out."""
    head = ('<?xml version="1.0" encoding="UTF-8"?>\t<wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" '
            'xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:ms="http://mapserver.gis.umn.edu/mapserver">')
    body = F.concat(F.lit(head), F.array_join("rows", "\t"), F.lit("</wfs:FeatureCollection>"))
    path = scratch_path(t.spark, label)
    pages = rows.groupBy("page").agg(F.collect_list("row").alias("rows"))
    # one row a file: a folder per page would be sorted for, made and listed one by one
    pages.select(body.alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def _gml(t):
    """Parcels as feature members: every third in EPSG:2180, the others latitude-first in EPSG:4326."""
    metric = F.col("parcel_number").cast("long") % 3 == 0
    xy = geo.to_epsg2180(F.col("lon"), F.col("lat"))
    points = t("fx_points").join(t("fx_parcels").select("parcel_id", "parcel_number"), "parcel_id")
    pair = points.select(
        *geometry.RING, "point_index", "parcel_number",
        F.when(metric, F.concat_ws(" ", F.format_string("%.6f", xy["x"]), F.format_string("%.6f", xy["y"])))
        .otherwise(F.concat_ws(" ", F.format_string("%.8f", F.col("lat")), F.format_string("%.8f", F.col("lon")))).alias("pos"),
    )
    rings = pair.groupBy(*geometry.RING, "parcel_number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("point_index", "pos"))), lambda s: s["pos"]), " ").alias("list"))
    side = F.when(F.col("ring_index") == 0, "exterior").otherwise("interior")
    ring = F.concat(F.lit("<gml:"), side, F.lit('><gml:LinearRing><gml:posList srsDimension="2">'), F.col("list"),
                    F.lit("</gml:posList></gml:LinearRing></gml:"), side, F.lit(">"))
    srs = F.when(metric, "urn:ogc:def:crs:EPSG::2180").otherwise("urn:ogc:def:crs:EPSG::4326")
    polygons = rings.groupBy("parcel_id", "polygon_index", "parcel_number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ring_index", ring.alias("x")))), lambda s: s["x"]), "").alias("body"))
    polygon = F.concat(F.lit('<gml:Polygon srsName="'), srs, F.lit('">'), F.col("body"), F.lit("</gml:Polygon>"))
    shapes = polygons.groupBy("parcel_id", "parcel_number").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("polygon_index", polygon.alias("x")))), lambda s: s["x"]).alias("ps"))
    member = F.transform("ps", lambda p: F.concat(F.lit("<gml:surfaceMember>"), p, F.lit("</gml:surfaceMember>")))
    shape = F.when(F.size("ps") == 1, F.col("ps")[0]).otherwise(
        F.concat(F.lit("<gml:MultiSurface>"), F.array_join(member, ""), F.lit("</gml:MultiSurface>")))
    facts = t("fx_parcels").select("parcel_id", "commune", "precinct")
    named = shapes.join(facts, "parcel_id")
    value = F.concat(
        F.lit("<wfs:member><ms:dzialki><ms:msGeometry>"), shape, F.lit("</ms:msGeometry><ms:ID_DZIALKI>"), F.col("parcel_id"),
        F.lit("</ms:ID_DZIALKI><ms:NUMER_DZIALKI>"), F.col("parcel_number"), F.lit("</ms:NUMER_DZIALKI><ms:NAZWA_GMINY>"), F.col("commune"),
        F.lit("</ms:NAZWA_GMINY>"),
        F.coalesce(F.concat(F.lit("<ms:NAZWA_OBREBU>"), F.col("precinct"), F.lit("</ms:NAZWA_OBREBU>")), F.lit("<ms:NUMER_OBREBU>0007</ms:NUMER_OBREBU>")),
        F.lit("</ms:dzialki></wfs:member>"),
    )
    page = F.floor(F.col("parcel_number").cast("long") / 500)
    return parcels.scan_parcel_gml(t.spark, _land_xml(t, named.select(page.alias("page"), value.alias("row")), "gml"))


@query("parcel_gml_scan", ["fx_parcels"], "SELECT parcel_id, parcel_number, commune, coalesce(precinct, '0007') AS precinct FROM fx_parcels")
def _(t):
    return _gml(t).select("parcel_id", "parcel_number", "commune", "precinct")


@query("gml_ring_decode", ["fx_points"], """
    SELECT parcel_id, polygon_index, ring_index, CAST(row_number() OVER (PARTITION BY parcel_id, polygon_index, ring_index ORDER BY point_index) - 1 AS INT) AS point_index, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_points""")
def _(t):
    return parcels.gml_ring_points(_gml(t), "EPSG:2180").select(
        "parcel_id", "polygon_index", "ring_index", "point_index", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def _lookups(t):
    """Lookup answers with multi-polygon text; every 40th empty, every 41st damaged."""
    nested = geometry.nested_geometry(t("fx_points"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", F.format_string("%.8f", p[0]), F.format_string("%.8f", p[1]), F.lit("0"))), ","), F.lit(")"))
    polygon = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    several = F.concat(F.lit("SRID=4326;MULTIPOLYGON("), F.array_join(F.transform("polygons", polygon), ","), F.lit(")"))
    single = F.concat(F.lit("POLYGON "), polygon(F.col("polygons")[0]))
    wkt = F.when(F.size("polygons") == 1, single).otherwise(several)
    rows = nested.join(t("fx_parcels"), "parcel_id")
    n = F.col("parcel_number").cast("long")
    fields = F.concat_ws("|", "parcel_id", "parcel_number", "commune", "county", "voivodeship", F.lit("src"), wkt)
    answer = F.when(n % 40 == 0, "-1 brak wyników\nnic").when(n % 41 == 0, "0\nonly|three|fields").otherwise(F.concat(F.lit("0\n "), fields, F.lit("\n")))
    # landed once: a filter on what the answers say would write their texts anew each time it reads them
    return cut_lineage(rows.select(F.col("parcel_id").alias("asked"), answer.alias("answer")))


@query("point_lookup_texts", ["fx_parcels"], """
    SELECT parcel_id AS asked, CASE WHEN CAST(parcel_number AS BIGINT) % 40 = 0 THEN 'empty' WHEN CAST(parcel_number AS BIGINT) % 41 = 0 THEN 'error: too few fields' ELSE 'ok' END AS status,
      CASE WHEN CAST(parcel_number AS BIGINT) % 40 = 0 OR CAST(parcel_number AS BIGINT) % 41 = 0 THEN NULL ELSE county END AS county FROM fx_parcels""")
def _(t):
    return parcels.parse_lookup(_lookups(t)).select("asked", "status", "county")


@query("wkt_decode", ["fx_points"], """
    SELECT parcel_id, polygon_index, ring_index, CAST(row_number() OVER (PARTITION BY parcel_id, polygon_index, ring_index ORDER BY point_index) - 1 AS INT) AS point_index, round(lon, 7) AS lon, round(lat, 7) AS lat
    FROM fx_points WHERE CAST(substr(parcel_id, 2) AS BIGINT) % 40 <> 0 AND CAST(substr(parcel_id, 2) AS BIGINT) % 41 <> 0""")
def _(t):
    found = parcels.parse_lookup(_lookups(t)).where("status = 'ok'").withColumn("rings", parcels.wkt_to_rings(F.col("wkt")))
    return parcels.ring_rows(found).select("parcel_id", "polygon_index", "ring_index", "point_index", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("price_xml_scan", ["fx_price_text"], """
    SELECT gml_id, parcel_id, transaction_date, trim(parcel_price) AS parcel_price, property_area, count(*) AS n FROM fx_price_text GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    tags = [F.concat(F.lit(f"<ms:{f}>"), F.col(f), F.lit(f"</ms:{f}>")) for f in RECORD_FIELDS if f not in ("dzi_vat", "teryt")]
    value = F.concat(F.lit('<ms:dzialki gml:id="'), F.col("gml_id"), F.lit('">'), *tags, F.lit("</ms:dzialki>"))
    page = F.floor(F.split("gml_id", "-")[0].cast("long") / 100)
    path = _land_xml(t, _records(t).select(page.alias("page"), F.concat(F.lit("<wfs:member>"), value, F.lit("</wfs:member>")).alias("row")), "price-xml")
    rows = tables.scan_price_xml(t.spark, path).where("dzi_vat = '' AND teryt = ''")
    return rows.groupBy("gml_id", F.col("dzi_id_dzialki").alias("parcel_id"), F.col("dok_data").alias("transaction_date"),
                        F.col("dzi_cena_brutto").alias("parcel_price"), F.col("nier_pow_gruntu").alias("property_area")).agg(F.count("*").alias("n"))


@query("analysis_lists", ["fx_lots", "orders"], """
    SELECT 'c' || CAST(o_custkey AS VARCHAR) AS source, 'P' || CAST(o_orderkey AS VARCHAR) AS parcel_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS position,
      CASE WHEN o_custkey % 3 = 0 THEN 'list ' || CAST(o_custkey AS VARCHAR) WHEN o_custkey % 3 = 1 THEN 'inner' ELSE 'c' || CAST(o_custkey AS VARCHAR) END AS title FROM orders""")
def _(t):
    """A list per customer; ids plain, as objects or repeated, under each of the accepted names."""
    rows = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
    kind = F.col("o_custkey") % 3
    ids = F.transform("ks", lambda k: F.concat(F.lit(" P"), k.cast("string")))
    twice = F.concat(ids, F.slice(ids, 1, 1), F.array(F.lit("  ")))
    objects = F.transform("ks", lambda k: F.struct(F.concat(F.lit("P"), k.cast("string")).alias("parcel_id")))
    c = F.col("o_custkey").cast("string")
    value = (
        F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit("list "), c).alias("title"), twice.alias("parcel_ids"))))
        .when(kind == 1, F.to_json(F.struct(F.struct(F.lit("inner").alias("title")).alias("analysis"), objects.alias("parcels"))))
        .otherwise(F.to_json(F.struct(ids.alias("ids"))))
    )
    parsed = tables.parse_analysis(rows.select(F.concat(F.lit("c"), c).alias("source"), value.alias("value")))
    titles = parsed.select("key", "source", "title")
    return tables.analysis_ids(parsed).join(titles, "key").select("source", "parcel_id", "position", "title")


@query("canonical_scan", ["fx_parcels"], "SELECT parcel_id, county, area_m2 FROM fx_parcels WHERE county = 'NATION_7'")
def _(t):
    return tables.stored_table(t.spark, t("fx_parcels").inputFiles()[0].rsplit("/", 1)[0], ["parcel_id", "county", "area_m2"]).where("county = 'NATION_7'")


# --- text ----------------------------------------------------------------------------------


@query("mojibake_repair", ["documents"], "SELECT doc_id, text FROM documents")
def _(t):
    """Documents damaged by a Latin-1 reading of their UTF-8 bytes, and repaired. Texts that cannot be
    damaged this way (no marks afterwards) pass as they are."""
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    marked = damaged.rlike("[ÃÅÄÂ]")
    rows = t("documents").select("doc_id", F.when(marked, damaged).otherwise(F.col("text")).alias("bad"))
    return rows.select("doc_id", text.repair_mojibake(F.col("bad")).alias("text"))


@query("name_normalisation", [], r"""
    SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(coalesce(text, ''))), 'ß', 'ss'), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+', ' ', 'g')) AS name FROM documents""")
def _(t):
    return t("documents").select("doc_id", text.normalized_name(F.col("text")).alias("name"))


@query("content_keys", ["fx_artifacts"], """
    SELECT id, sha256(payload_json) AS digest, 'a_' || substr(sha1(run_id || chr(0) || artifact_type || chr(0) || artifact_key || chr(0) || producer), 1, 16) AS list_key FROM fx_artifacts""")
def _(t):
    return t("fx_artifacts").select("id", text.content_hash(F.col("payload_json")).alias("digest"),
                                    text.list_key(F.col("run_id"), F.array("artifact_type", "artifact_key"), F.col("producer")).alias("list_key"))


@query("record_keys", ["fx_price_text"], """
    SELECT CASE WHEN property_price <> 'n/a' THEN gml_id ELSE sha256('{"parcel_id":"' || parcel_id || '","transaction_date":"' || transaction_date || '"}') END AS k,
      count(*) AS n, bool_or(property_price = 'n/a') AS digested FROM fx_price_text GROUP BY 1""")
def _(t):
    """Own ids, and digests of the fields of the records that are given none here."""
    own = F.when(F.col("property_price") == "n/a", "").otherwise(F.col("gml_id"))
    key = text.record_key(own, F.col("parcel_id"), F.col("transaction_date"))
    return t("fx_price_text").select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.max(F.length("k") == 64).alias("digested"))
