"""Nothing is cut unless a number is asked for; the shared folder is never a local one on a cluster."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from acremark import BBox
from acremark.functions import text
from acremark.operators import presentation
from acremark.plans import analyses
from acremark.session import shared_folder
from acremark.sources import tables

PARCEL = ("parcel_id string, parcel_number string, voivodeship string, county string, commune string, precinct string, area_m2 double, "
          "centroid_lat double, centroid_lon double, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double")


def parcels(spark, n, precinct):
    rows = [(f"p{i}", str(i), "W", "K", "Zawada", precinct(i), 100.0, 51.3, 17.4, 51.2, 17.3, 51.4, 17.5) for i in range(n)]
    return spark.createDataFrame(rows, PARCEL)


def test_viewports_and_manifests_give_everything(spark):
    frame = parcels(spark, 8200, lambda i: f"o{i % 300}|{i % 7}")
    box = BBox(17.0, 51.0, 18.0, 52.0)
    assert presentation.viewport(frame, None, box).count() == 8200
    assert presentation.viewport(frame, None, box, 2).count() == 2
    labels = frame.select("precinct").distinct().count()
    assert presentation.admin_manifest(frame).where("level = 'precinct'").count() == labels > 250
    viewer = presentation.viewer_parcels(frame)
    groups = presentation.hierarchy_groups(viewer)
    assert presentation.densest_groups(groups.where("level = 'precinct'")).count() == labels
    assert presentation.two_stage_viewport(groups, viewer, box).count() == 8200
    assert presentation.two_stage_viewport(groups, viewer, box, 3, 5).count() == 5


def test_long_texts_stay_whole(spark):
    long = "ab" * 6000
    row = spark.createDataFrame([(f'{{"title": "{long}", "description": "{long}", "ids": ["x"]}}', "f")], "value string, source string")
    whole = tables.parse_analysis(row).first()
    assert whole.title == whole.description == long
    assert len(tables.parse_analysis(row, 200, 8000).first().title) == 200
    slugs = spark.createDataFrame([("z" * 80 + "a",), ("z" * 80 + "b",)], "t string")
    assert slugs.select(text.slug(F.col("t"))).distinct().count() == 2
    assert slugs.select(text.slug(F.col("t"), 80)).distinct().count() == 1


def test_scan_counts_a_repeated_record_once_and_blanks_failed_tiles(spark):
    from acremark.operators.prices import RECORD_FIELDS

    def record(gml_id, parcel, price, date="2019-04-01"):
        given = {"gml_id": gml_id, "dzi_id_dzialki": parcel, "dzi_pow_ewid": "250", "dzi_cena_brutto": price, "dok_data": date}
        return [given.get(f, "") for f in ("gml_id", *RECORD_FIELDS)]

    rows = [record("a", "p0", "5000"), record("a", "p0", "7500", "2020-01-01"), record("b", "p1", "9000")]
    records = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in ("gml_id", *RECORD_FIELDS)))
    near, far = parcels(spark, 1, lambda i: "o"), parcels(spark, 2, lambda i: "o").where("parcel_id = 'p1'")
    frame = near.unionByName(far.withColumn("centroid_lat", F.lit(51.9)))
    tiles = analyses.price_scan(frame, records, "r1")["checks"].select("parcel_id", "tile_id").collect()
    failed = spark.createDataFrame([(t.tile_id, "slow " * 200) for t in tiles if t.parcel_id == "p1"], "tile_id string, error string")
    scan = analyses.price_scan(frame, records, "r1", failed_tiles=failed)
    got = {r.parcel_id: r for r in scan["checks"].collect()}
    assert (got["p0"].rcn_records, got["p0"].min_price_per_m2, got["p0"].status) == (1, 30.0, "ok")
    assert (got["p1"].rcn_records, got["p1"].min_price_per_m2, got["p1"].status) == (0, None, "error")
    assert len(got["p1"].error_message) == 1000
    totals = scan["totals"].first()
    assert (totals.fetched_records, totals.stored_records, totals.selected_parcels, totals.priced_parcels) == (3, 2, 2, 1)


def test_scan_figures_do_not_store_the_texts_of_records(spark, monkeypatch):
    from acremark.operators.prices import RECORD_FIELDS

    kept, cut = [], analyses.cut_lineage
    monkeypatch.setattr(analyses, "cut_lineage", lambda frame: kept.append(frame.columns) or cut(frame))
    fields = ["gml_id", *RECORD_FIELDS]
    rows = [[{"gml_id": g, "dzi_id_dzialki": "p0", "dzi_pow_ewid": "250", "dzi_cena_brutto": "5000"}.get(f, "") for f in fields] for g in ("a", "a", "", "")]
    records = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    scan = analyses.price_scan(parcels(spark, 1, lambda i: "o"), records, "r1")
    assert scan["totals"].first().stored_records == scan["observations"].count() == 2
    assert kept and not any(set(RECORD_FIELDS) & set(columns) for columns in kept)


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        context = SimpleNamespace(master=master, applicationId="none", getConf=lambda: conf, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=conf, sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"


def test_a_rejected_outline_wins_over_a_later_first_parcel(spark):
    """Overlapping parcels against the points taken one after the other."""
    import random

    from acremark.operators import coverage

    rng = random.Random(6)
    for case in range(2):
        lots = {f"P{i:02d}": (x, y, x + rng.choice([0.002, 0.004]), y + rng.choice([0.002, 0.004]))
                for i in range(14) for x, y in [(16 + rng.randrange(8) * 0.001, 50 + rng.randrange(8) * 0.001)]}
        area = {p: rng.choice([100.0, 5000.0]) for p in lots}
        commune = {p: rng.choice(["Here", "here ", "There"]) for p in lots}
        parcels = spark.createDataFrame([(p, commune[p], area[p], b, a, d, c) for p, (a, b, c, d) in lots.items()],
                                        "parcel_id string, commune string, area_m2 double, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double")
        corners = [(p, 0, 0, k, lon, lat) for p, (a, b, c, d) in lots.items() for k, (lon, lat) in enumerate([(a, b), (c, b), (c, d), (a, d)])]
        points = spark.createDataFrame(corners, "parcel_id string, polygon_index int, ring_index int, point_index int, lon double, lat double")
        box = spark.createDataFrame([("k", 50.0, 16.0, 50.011, 16.011)], "key string, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double")
        got = {r.ordinal: r for r in coverage.judged_samples(box, "key", 37.0, parcels, points, "here", {"min_area_m2": 1000.0}).collect()}
        marked, uncovered = set(), 0
        for n in sorted(got):
            r = got[n]
            under = sorted(p for p, (a, b, c, d) in lots.items() if a < r.lon < c and b < r.lat < d)
            before = sorted(marked & set(under))
            if before:
                want = ("rejected", before[0])
            elif not under:
                want = ("uncovered", None)
            elif commune[under[0]].strip().lower() != "here":
                want = ("out_of_scope", under[0])
            elif area[under[0]] < 1000:
                want = ("rejected", under[0])
                marked.add(under[0])
            else:
                want = ("found", under[0])
            assert (r.outcome, r.parcel_id) == want and r.uncovered_before == uncovered
            uncovered += want[0] == "uncovered"
        assert marked


def test_exact_medians_of_skewed_keys(spark):
    import random
    import statistics

    from pyspark.sql import functions as F

    from acremark.operators import ordering

    rng = random.Random(3)
    rows = [("hot", rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-3, 7)) for _ in range(5000)]
    rows += [("hot", 12.5)] * 800 + [("even", 1.0), ("even", 4.0), ("one", -3.25), ("none", None), (None, 2.0), (None, 4.0), (None, 9.0)]
    rows += [("near", 100 + i * 1e-9) for i in range(401)]
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in ordering.exact_median(frame.where("k IS NOT NULL"), ["k"], "v", "m", 20).collect()}
    assert got == {k: statistics.median(v) for k, v in want.items() if k is not None}
    assert ordering.exact_median(frame, [], "v", "m", 20).first().m == statistics.median([v for _, v in rows if v is not None])
    plan = ordering.exact_median(frame, ["k"], "v", "m", 20)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    numbers = ordering.numbered(frame.where("v IS NOT NULL"), [F.desc("v"), F.col("k")], "n").orderBy("n").collect()
    assert [r.n for r in numbers] == list(range(1, len(numbers) + 1)) and [r.v for r in numbers] == sorted((r.v for r in numbers), reverse=True)
