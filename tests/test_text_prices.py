import random
import statistics

import pytest
from pyspark.sql import functions as F

from acremark.functions import geo, text
from acremark.operators import ordering, prices


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", float: "double", int: "long"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v if names else None


@pytest.mark.parametrize(
    "given, wanted",
    [("SrebrnogÃ³rski", "Srebrnogórski"), ("DonÅ¼on", "Donżon"), ("Łódź", "Łódź"), ("Ãplain", "Ãplain"), ("abc", "abc")],
)
def test_mojibake(spark, given, wanted):
    assert one(spark, text.repair_mojibake(F.col("s")), s=given) == wanted


def test_tag_repair_covers_keys_and_values(spark):
    frame = spark.createDataFrame([({"nazwÃ³w": "DonÅ¼on", "a": "b"},)], "tags map<string,string>")
    assert frame.select(text.repair_tags(F.col("tags")).alias("t")).first().t == {"nazwów": "Donżon", "a": "b"}


def test_names_fold_but_stroked_l_stays(spark):
    rows = spark.createDataFrame([("Głuszyca", "gluszyca"), ("  Zażółć   Gęślą", "zazolc gesla"), ("WALIM", "walim")], "a string, b string")
    got = [(r.a, r.b) for r in rows.select(text.normalized_name(F.col("a")).alias("a"), "b").collect()]
    assert got[0] == ("głuszyca", "gluszyca") and got[2] == ("walim", "walim")
    assert got[1][0] == "zazołc gesla"


@pytest.mark.parametrize("given, wanted", [("1 234,5", 1234.5), ("", None), ("n/a", None), ("12d", None), (" 7 ", 7.0), ("1e3", 1000.0)])
def test_numbers(spark, given, wanted):
    assert one(spark, text.parse_number(F.col("s")), s=given) == wanted


def test_slug_and_labels(spark):
    assert one(spark, text.slug(F.col("s")), s="  Łąka / Góra--1 ") == "ka_G_ra--1"
    assert one(spark, text.slug(F.col("s")), s="///") == "unknown"
    assert one(spark, text.clean_part(F.col("s")), s="  ") == "unknown"


def test_epsg2180_round_trip(spark):
    frame = spark.createDataFrame([(19.0, 52.0), (16.9, 54.0), (23.0, 50.0)], "lon double, lat double")
    xy = frame.withColumn("p", geo.to_epsg2180(F.col("lon"), F.col("lat")))
    back = xy.withColumn("b", geo.from_epsg2180(F.col("p.x"), F.col("p.y"))).collect()
    for r in back:
        assert abs(r.b.lon - r.lon) < 1e-6 and abs(r.b.lat - r.lat) < 1e-6
    # on the central meridian the easting is the false easting
    assert abs(back[0].p.y - 500000.0) < 1e-6


def test_unknown_system_is_an_error(spark):
    frame = spark.createDataFrame([(1.0, 2.0, "EPSG:9999")], "a double, b double, srs string")
    with pytest.raises(Exception, match="no conversion"):
        geo.with_lonlat(frame, F.col("a"), F.col("b"), "srs").collect()


@pytest.mark.parametrize("srs, wanted", [("EPSG:4326", (2.0, 1.0)), ("urn:ogc:def:crs:OGC:1.3:CRS84", (1.0, 2.0))])
def test_axis_order(spark, srs, wanted):
    frame = spark.createDataFrame([(1.0, 2.0, srs)], "a double, b double, srs string")
    row = geo.with_lonlat(frame, F.col("a"), F.col("b"), "srs").first()
    assert (row.lon, row.lat) == wanted


def records(spark, *rows):
    names = ["gml_id", *prices.RECORD_FIELDS]
    base = dict.fromkeys(names, "")
    full = [tuple({**base, **row}[n] for n in names) for row in rows]
    return spark.createDataFrame(full, ", ".join(f"{n} string" for n in names))


def sale(gml_id, price, area="0.1200", date="2025-01-15"):
    return {"gml_id": gml_id, "dzi_cena_brutto": price, "dzi_pow_ewid": area, "dok_data": date, "dzi_id_dzialki": "P1"}


def test_price_per_square_metre_and_inflation(spark):
    index = spark.createDataFrame([("2025", 100.0), ("2026", 110.0)], "year string, index_value double")
    row = prices.price_observations(records(spark, sale("a", "120000")), "demo", index, "2026").first()
    assert row.area_m2 == 1200.0 and row.price_per_m2 == 100.0
    assert row.inflation_reference_year == "2026" and round(row.inflation_factor, 2) == 1.1
    assert round(row.inflation_adjusted_price_pln, 2) == 132000.0
    assert round(row.inflation_adjusted_price_per_m2, 2) == 110.0
    with pytest.raises(Exception, match="not in the index"):
        prices.price_observations(records(spark, sale("a", "1")), "demo", index, "2030").collect()


def test_zero_falls_through_and_digest_key(spark):
    row = prices.price_observations(
        records(spark, {**sale("", "0"), "nier_cena_brutto": "50 000", "dzi_pow_ewid": "0", "nier_pow_gruntu": "250"}), "r").first()
    assert row.price_pln == 50000.0 and row.area_m2 == 250.0 and row.price_per_m2 == 200.0
    assert len(row.source_record_id) == 64


def test_run_median(spark):
    seen = prices.price_observations(records(spark, sale("a", "120000"), sale("b", "240000")), "demo")
    row = prices.stats_per_run(seen).first()
    assert (row.rcn_records, row.priced_records, row.median_price_per_m2) == (2, 2, 150.0)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_median_with_a_heavy_value(spark, accuracy):
    rnd = random.Random(1)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(3001)] + [("b", 5.0)] * 2000 + [("b", float(i)) for i in range(999)] + [("c", None), ("d", 2.0)]
    rows += [("e", float(i)) for i in range(4)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in ordering.exact_median(frame, ["k"], "v", "m", accuracy).collect()}
    for k in "abde":
        assert got[k] == statistics.median([v for q, v in rows if q == k and v is not None])
    assert "c" not in got
    assert ordering.exact_median(frame, [], "v", "m", accuracy).first().m == statistics.median([v for _, v in rows if v is not None])


def test_sums_before_equals_running_sum(spark):
    rows = [(g, b, i, (i * 7 + b) % 3) for g in "xy" for b in range(4) for i in range(5)]
    frame = spark.createDataFrame(rows, "g string, b int, i int, n int")
    got = {(r.g, r.b, r.i): r.s for r in ordering.sums_before(frame, ["g"], "b", [F.col("i")], F.col("n"), "s").collect()}
    for g in "xy":
        total = 0
        for _, b, i, n in sorted(r for r in rows if r[0] == g):
            assert got[(g, b, i)] == total
            total += n


def test_exact_median_per_market_runs_and_equals_sql(spark):
    import os

    import duckdb

    import __spark_entry__ as entry_module

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = sorted(oracle.execute(entry_module.oracle_sql()["exact_median_per_market"]).fetchall())
    got = sorted(tuple(r) for r in entry_module.queries()["exact_median_per_market"](spark, sf).select("year", "run_id", "m").collect())
    assert got == want


def test_long_names_are_folded_slice_by_slice():
    import tracemalloc

    import pyarrow as pa

    names = pa.array([f"Zażółć {k} " + "GĘŚLĄ  jaźń " * 2000 for k in range(800)] + [None, "", "Łódź"])
    tracemalloc.start()
    got = text._folded.func(names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [text.folded(n) if n is not None else "" for n in names.to_pylist()]
    assert peak < 12 << 20  # all texts at once take 50 MB and more
