import json
import struct
import zlib

from pyspark.sql import functions as F

from acremark.operators import geometry, imagery
from acremark.sources import osm, parcels, sinks, tables


def test_osm_responses(spark, tmp_path):
    elements = [
        {"type": "node", "id": 100, "lat": 50.01, "lon": 16.01, "tags": {"name": "DonÅ¼on", "amenity": "restaurant"}},
        {"type": "way", "id": 7, "bounds": {"minlat": 50, "minlon": 16, "maxlat": 50.2, "maxlon": 16.4}},
        {"type": "way", "id": 8, "geometry": [{"lat": 50, "lon": 16}, {"lat": 50.1, "lon": 16.3}]},
        {"type": "relation", "id": 9, "center": {"lat": 51, "lon": 17}},
        {"id": 10, "lat": 1, "lon": 1},
        {"type": "node", "id": 11},
    ]
    (tmp_path / "r.json").write_text(json.dumps({"elements": elements}, indent=2, ensure_ascii=False))
    scanned = osm.scan_osm_json(spark, str(tmp_path))
    rows = {r.osm_id: r for r in osm.normalize_elements(scanned).collect()}
    assert set(rows) == {100, 7, 8, 9, 11}
    assert rows[100].tags_json == '{"amenity":"restaurant","name":"Donżon"}' and rows[100].geometry_json is None
    assert abs(rows[7].center_lat - 50.1) < 1e-12 and rows[7].bbox_max_lon == 16.4
    assert rows[8].bbox_min_lat == 50 and abs(rows[8].center_lon - 16.15) < 1e-12
    assert (rows[9].center_lat, rows[9].bbox_min_lon) == (51, 17) and rows[11].center_lat is None
    simple = {r.osm_id: r for r in osm.normalize_elements(scanned, geometry_fallback=False, keep_anonymous=True).collect()}
    assert simple[8].center_lat is None and simple[10].osm_type == "unknown"
    preview = {r.id: r for r in osm.preview_elements(scanned).collect()}
    assert preview[100].name == "Donżon" and preview[9].lat == 51 and preview[7].lat is None


GML = """<?xml version="1.0" encoding="UTF-8"?>
<wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" xmlns:gml="http://www.opengis.net/gml/3.2"
    xmlns:ms="http://mapserver.gis.umn.edu/mapserver" numberReturned="3">
  <wfs:member><ms:dzialki><ms:msGeometry>
    <gml:Polygon srsName="urn:ogc:def:crs:EPSG::4326"><gml:exterior><gml:LinearRing>
      <gml:posList srsDimension="3">52.0 19.0 5 52.0 19.001 5 52.001 19.001 5 52.0 19.0 5</gml:posList>
    </gml:LinearRing></gml:exterior></gml:Polygon></ms:msGeometry>
    <ms:ID_DZIALKI>061101_2.0312.77/4</ms:ID_DZIALKI><ms:NUMER_DZIALKI>1</ms:NUMER_DZIALKI>
    <ms:NAZWA_OBREBU>Podlesie Dolne</ms:NAZWA_OBREBU><ms:NAZWA_GMINY>Wierzbowo</ms:NAZWA_GMINY></ms:dzialki></wfs:member>
  <wfs:member><ms:dzialki><ms:msGeometry>
    <gml:Polygon><gml:exterior><gml:LinearRing><gml:coordinates>19,52 19.1,52 19.1,52.1 19,52</gml:coordinates></gml:LinearRing></gml:exterior>
      <gml:interior><gml:LinearRing srsName="CRS84"><gml:posList>19.01 52.01 19.02 52.01 19.02 52.02</gml:posList></gml:LinearRing></gml:interior>
    </gml:Polygon></ms:msGeometry>
    <ms:ID_DZIALKI>061101_2.0007.15</ms:ID_DZIALKI><ms:NUMER_OBREBU>0007</ms:NUMER_OBREBU></ms:dzialki></wfs:member>
  <wfs:member><ms:dzialki><ms:NUMER_DZIALKI>no id</ms:NUMER_DZIALKI></ms:dzialki></wfs:member>
</wfs:FeatureCollection>"""


def test_parcel_gml(spark, tmp_path):
    (tmp_path / "p.xml").write_text(GML)
    features = parcels.scan_parcel_gml(spark, str(tmp_path))
    rows = {r.parcel_id: r for r in features.collect()}
    assert set(rows) == {"061101_2.0312.77/4", "061101_2.0007.15"}
    assert rows["061101_2.0312.77/4"].precinct == "Podlesie Dolne" and rows["061101_2.0312.77/4"].commune == "Wierzbowo" and rows["061101_2.0007.15"].precinct == "0007"
    points = parcels.gml_ring_points(features, "CRS84")
    got = {(r.parcel_id, r.ring_index, r.point_index): (r.lon, r.lat) for r in points.collect()}
    assert got[("061101_2.0312.77/4", 0, 1)] == (19.001, 52.0) and got[("061101_2.0007.15", 1, 2)] == (19.02, 52.02)
    assert len(got) == 4 + 4 + 3
    stats = {r.parcel_id: r for r in geometry.ingest_stats(points).collect()}
    assert stats["061101_2.0312.77/4"].area_m2 > 0 and len(stats["061101_2.0312.77/4"].geometry_hash) == 64


def test_uneven_position_list_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "p.xml").write_text(GML.replace("52.0 19.0 5</gml", "52.0 19.0</gml"))
    with pytest.raises(Exception, match="multiple of its dimension"):
        parcels.gml_ring_points(parcels.scan_parcel_gml(spark, str(tmp_path)), "CRS84").collect()


def test_lookup_files_and_wkt(spark, tmp_path):
    answers = {
        "ok": "0\n301907_2.0044.318|318|Jastrzebniki|Koninski|Wielkopolskie|geo|SRID=4326;POLYGON((18.2 52.2,18.23 52.2,18.23 52.24,18.2 52.2))",
        "none": "-1 brak wynikow w tym miejscu",
        "bad": "500 server error",
        "multi": "0\nM|2|A|B|C|s|MULTIPOLYGON (((1 2 9, 3 4 9, 5 6 9, 1 2 9), (7 8, 9 10, 11 12)), ((0 0, 1 0, 1 1, 0 0)))",
    }
    for name, body in answers.items():
        (tmp_path / f"{name}.txt").write_text(body, encoding="utf-8")
    rows = parcels.scan_lookup_texts(spark, str(tmp_path))
    assert sorted(r.status for r in rows.collect()) == ["empty", "error: unexpected answer", "ok", "ok"]
    rings = parcels.ring_rows(rows.where("status = 'ok'").withColumn("rings", parcels.wkt_to_rings(F.col("wkt"))))
    got = {tuple(r) for r in rings.collect()}
    assert ("M", 0, 1, 2, 11.0, 12.0) in got and ("M", 1, 0, 3, 0.0, 0.0) in got and ("301907_2.0044.318", 0, 0, 2, 18.23, 52.24) in got
    assert len(got) == 4 + 4 + 3 + 4


def test_price_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<c xmlns:ms="http://m" xmlns:gml="http://g"><ms:dzialki gml:id="dzialki.90417"><ms:teryt> 3019 </ms:teryt>'
        "<ms:dzi_cena_brutto>84500</ms:dzi_cena_brutto></ms:dzialki></c>")
    row = tables.scan_price_xml(spark, str(tmp_path)).first()
    assert (row.gml_id, row.teryt, row.dzi_cena_brutto, row.dzi_adres) == ("dzialki.90417", "3019", "84500", "")


def png(width, height, rgb):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(rgb(x, y)[i] for x in range(width) for i in range(3)) for y in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_tiles_keep_channel_order_and_position(spark, tmp_path):
    folder = tmp_path / "18" / "5"
    folder.mkdir(parents=True)
    (folder / "9.png").write_bytes(png(4, 3, lambda x, y: (10 + x, 100 + y, 200)))
    strips = tables.scan_tiles(spark, str(tmp_path))
    pixels = {(r.z, r.x, r.y, r.px, r.py): (r.r, r.g, r.b) for r in imagery.pixels_from_strips(strips).collect()}
    assert len(pixels) == 12 and pixels[(18, 5, 9, 3, 2)] == (13, 102, 200)
    again = imagery.strips_from_pixels(imagery.pixels_from_strips(strips))
    assert {(r.py, tuple(r.r)) for r in again.collect()} == {(r.py, tuple(r.r)) for r in strips.collect()}


def test_analysis_lists(spark, tmp_path):
    (tmp_path / "plain.json").write_text(json.dumps({"title": "T", "parcel_ids": [" a ", "b", "a", None, 7, ""]}))
    (tmp_path / "nested.json").write_text(json.dumps({"analysis": {"summary": "S"}, "ids": [{"id": "x"}, {"parcelId": 5}]}))
    (tmp_path / "other.json").write_text(json.dumps({"nothing": 1}))
    rows = {r.source.rsplit("/", 1)[1]: r for r in tables.scan_analysis(spark, str(tmp_path)).collect()}
    assert rows["plain.json"].ids == ["a", "b", "7"] and rows["plain.json"].title == "T"
    assert rows["nested.json"].ids == ["x", "5"] and (rows["nested.json"].title, rows["nested.json"].description) == ("nested", "S")
    assert rows["other.json"].ids is None
    assert rows["plain.json"].key.startswith("a_") and len(rows["plain.json"].key) == 18


def test_geojson_lines_parse(spark, tmp_path):
    frame = spark.createDataFrame([("c1", 2.0, None)], "cell_id string, score double, note string")
    from acremark.functions.geo import closed_box_ring

    ring = closed_box_ring(*[F.lit(v) for v in (50.0, 16.0, 50.1, 16.1)])
    path = str(tmp_path / "out")
    sinks.write_geojson(frame, sinks.ring_geometry_json(ring), ["cell_id", "score", "note"], path)
    feature = json.loads(spark.read.text(path).first().value)
    assert feature["geometry"]["coordinates"][0][0] == feature["geometry"]["coordinates"][0][-1] == [16.0, 50.0]
    assert feature["properties"] == {"cell_id": "c1", "score": 2.0, "note": None}


def test_landed_xml_is_small_and_whole(spark, tmp_path, monkeypatch):
    import types

    from checks import q_sources

    monkeypatch.setattr(q_sources, "scratch_path", lambda session, label: str(tmp_path / label))
    row = F.concat(F.lit('<wfs:member><ms:dzialki gml:id="'), F.col("id").cast("string"), F.lit('"><ms:dok_data>2001-02-03</ms:dok_data></ms:dzialki></wfs:member>'))
    rows = spark.range(4000).select(F.floor(F.col("id") / 1000).alias("page"), row.alias("row"))
    path = q_sources._land_xml(types.SimpleNamespace(spark=spark), rows, "landed")
    size = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    assert 10 * size < rows.agg(F.sum(F.length("row"))).first()[0]
    found = tables.scan_price_xml(spark, path)
    assert found.count() == found.select("gml_id").distinct().count() == 4000 and found.where("dok_data = '2001-02-03'").count() == 4000


def test_lookup_answers_are_written_once(spark):
    import os

    import pytest

    from checks import q_sources
    from checks.catalog import Tables

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    found = parcels.parse_lookup(q_sources._lookups(Tables(spark, "/root/testdata/sf0.001"))).where("status = 'ok'")
    assert "format_string" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0


def test_gml_ring_of_many_vertices_takes_about_its_length(spark, tmp_path):
    import time

    texts = " ".join(f"50.{k:06d} 16.{k:06d}" for k in range(20_000))
    (tmp_path / "long.xml").write_text(
        '<a><dzialki><msGeometry><Polygon srsName="EPSG:4326"><exterior><LinearRing><posList>' + texts
        + "</posList></LinearRing></exterior></Polygon></msGeometry><ID_DZIALKI>p</ID_DZIALKI></dzialki></a>")
    began = time.time()
    rows = parcels.gml_ring_points(parcels.scan_parcel_gml(spark, str(tmp_path)), "EPSG:2180").orderBy("point_index").collect()
    assert [round(r.lat, 6) for r in rows] == [round(50 + k / 1e6, 6) for k in range(20_000)]
    assert time.time() - began < 60  # minutes if the text is split for every vertex
