import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.operators import graph, quality, upsert
from acremark.plans import analyses
from acremark.streaming import incremental


def hav(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def nid(p):
    return round((p[0] + 90) * 1e6) * 1_000_000_000 + round((p[1] + 180) * 1e6)


WAY = "id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"


def test_components_paths_and_boxes_equal_plain_loops(spark):
    rnd = random.Random(4)
    trunk = [(50.2 + i * 0.004, 16.2 + 0.002 * math.sin(i)) for i in range(25)]
    branch = [trunk[10], (50.24, 16.21), (50.241, 16.22), (50.243, 16.225)]
    island = [(50.6, 16.6), (50.601, 16.6)]
    ways = [
        (1, {"highway": "path"}, trunk), (2, {"route": "hiking", "sac_scale": "T1"}, branch), (3, {"highway": "track"}, island),
        (4, {"highway": "path", "sac_scale": "T4"}, [trunk[0], island[0]]), (5, {"highway": "road"}, [trunk[3], island[1]]),
    ]
    ways = [(i, tags, [(round(lat, 6), round(lon, 6)) for lat, lon in g]) for i, tags, g in ways]
    frame = spark.createDataFrame(ways, WAY)
    edges = analyses.graph.way_edges(analyses.filters.easy_trails(frame))
    sizes = sorted(r["count"] for r in graph.connected_components(edges).groupBy("component").count().collect())
    assert sizes == [2, 28]
    adjacent = {}
    for _, _, g in ways[:3]:
        for a, b in zip(g, g[1:]):
            adjacent.setdefault(a, []).append(b)
            adjacent.setdefault(b, []).append(a)

    def sweep(start):
        best, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            d, n = heapq.heappop(queue)
            for m in adjacent[n]:
                if d + hav(n, m) < best.get(m, math.inf):
                    best[m] = d + hav(n, m)
                    heapq.heappush(queue, (best[m], m))
        return best

    start = min(n for n in adjacent if n[0] < 50.5)
    want = sweep(start)
    got = {r.node: r.distance for r in graph.shortest_paths(edges, spark.createDataFrame([(nid(start),)], "node long")).collect()}
    assert set(got) == {nid(n) for n in want} and all(abs(got[nid(n)] - d) < 1e-6 for n, d in want.items())
    out = analyses.trail_boxes(frame, BBox(16.0, 50.0, 17.0, 51.0), 0.0, 5, 4.0, 1.0)
    length = out["segments"].agg(F.max("end_m")).first()[0]
    far = max(want, key=want.get)
    assert abs(length - max(sweep(far).values())) < 1e-6
    boxes = out["boxes"].orderBy("index").collect()
    assert len(boxes) == 5 and all(b.min_lat < b.lat < b.max_lat for b in boxes)
    assert out["route"].count() == min(700, max(2, int(length // 250)))
    del rnd


def test_margin_keeps_inner_edges(spark):
    g = [(50.0, 16.0), (50.5, 16.5), (50.51, 16.51)]
    edges = graph.way_edges(spark.createDataFrame([(1, {"highway": "path"}, g)], WAY))
    assert edges.count() == 4
    assert graph.edges_inside(edges, BBox(15.9, 49.9, 17.1, 51.1), 30.0).count() == 2


def test_upsert_last_write_wins_and_keeps_first_date(spark):
    schema = "k string, v string, created int, n int"
    stored = spark.createDataFrame([("a", "old", 1, 1), ("b", "old", 1, 1)], schema)
    batch = spark.createDataFrame([("a", "mid", 5, 5), ("a", "new", 6, 6), ("c", "c1", 7, 7), ("c", "c2", 8, 8)], schema)
    rows = {r.k: (r.v, r.created) for r in upsert.upsert(stored, batch, ["k"], ["n"], keep=["created"]).collect()}
    assert rows == {"a": ("new", 1), "b": ("old", 1), "c": ("c2", 7)}


def test_merge_into_bucketed_table_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, "one", 1) for i in range(50)], "k long, v string, n int")
    second = spark.createDataFrame([(i, "two", 2) for i in range(40, 60)], "k long, v string, n int")
    incremental.merge_into(first, path, ["k"], ["n"], buckets=8)
    for _ in range(2):
        incremental.merge_into(second, path, ["k"], ["n"], buckets=8)
    rows = {r.k: r.v for r in incremental.read_table(spark, path).collect()}
    assert len(rows) == 60 and rows[39] == "one" and rows[45] == "two"


def test_streamed_parcels_leave_no_stale_vertices(spark, tmp_path):
    from acremark.operators.geometry import ring_edges  # noqa: F401
    from acremark.sources.parcels import ring_rows, wkt_to_rings

    schema = "parcel_id string, number string, wkt string, seen int"
    land, store, mark = (str(tmp_path / n) for n in ("land", "store", "mark"))

    def points(rows):
        return ring_rows(rows.withColumn("rings", wkt_to_rings(F.col("wkt"))))

    def deliver(wkt, number, seen):
        spark.createDataFrame([("P1", number, wkt, seen), ("P" + number, number, wkt, seen)], schema).write.mode("append").json(land)
        stream = spark.readStream.schema(schema).json(land)
        incremental.stream_parcels(stream, store, mark, "seen", points, buckets=4).awaitTermination()

    deliver("POLYGON((16 50,16.01 50,16.01 50.01,16 50.01,16 50))", "7", 1)
    deliver("POLYGON((16 50,16.02 50,16 50))", "8", 2)
    rows = {r.parcel_id: r.number for r in incremental.read_table(spark, store, "parcels").collect()}
    assert rows == {"P1": "8", "P7": "7", "P8": "8"}
    counts = {r.parcel_id: r["count"] for r in incremental.read_table(spark, store, "points").groupBy("parcel_id").count().collect()}
    assert counts == {"P1": 3, "P7": 5, "P8": 3}


def test_replace_run_and_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "runs")
    schema = "parcel_id string, candidate_index int, run_id string"
    spark.createDataFrame([("a", 1, "r1"), ("b", 1, "r1"), ("c", 1, "r2")], schema).write.partitionBy("run_id").parquet(path)
    upsert.replace_runs(spark.createDataFrame([("z", 9, "r1")], schema), path)
    assert sorted(r.parcel_id for r in spark.read.parquet(path).collect()) == ["c", "z"]
    stored = spark.read.parquet(path)
    new = spark.createDataFrame([("z", 1, "r1"), ("y", 4, "r1"), ("y", 2, "r1")], schema)
    rows = upsert.insert_if_absent(stored, new, ["run_id", "parcel_id"], [F.col("candidate_index")]).collect()
    assert [(r.parcel_id, r.candidate_index) for r in rows] == [("y", 2)]


def test_validation_rows(spark):
    osm = spark.createDataFrame([("node", 1), ("node", 1), ("way", 1)], "osm_type string, osm_id long")
    cells = spark.createDataFrame([("c", ""), ("d", "r")], "cell_id string, run_id string")
    report = quality.validate(spark, {"canon_osm_features": osm, "helper_osm_hotspot_mesh_cells": cells, "parcels": osm}, {"links"})
    got = {(r.table, r.check, r.detail): r.breaches for r in report.collect()}
    assert got[("canon_osm_features", "duplicate_key", "osm_type,osm_id")] == 1
    assert got[("helper_osm_hotspot_mesh_cells", "empty_value", "run_id")] == 1
    assert ("canon_parcels", "missing_table", "canon_parcels") in got and ("parcels", "unprefixed", "old table remains") in got
    assert quality.validation_status(report).first().status == "schema_error"
    fine = quality.validate(spark, {"canon_osm_features": osm.distinct(), "helper_osm_hotspot_mesh_cells": cells.where("run_id <> ''")})
    assert quality.validation_status(fine).first().status == "ok"


def test_page_log(spark):
    pages = spark.createDataFrame([("c1", 10, 4, 6, 0), ("c1", 5, 5, 0, 1), ("c2", 1, 1, 0, 0)],
                                  "county_code string, fetched long, inserted_or_updated long, skipped_unchanged long, errors long")
    rollup = incremental.page_rollup(pages)
    assert {r.county_code: (r.pages, r.status) for r in rollup.collect()} == {"c1": (2, "error"), "c2": (1, "ok")}
    total = incremental.page_totals(rollup).first()
    assert (total.counties, total.ok_counties, total.fetched_total, total.errors_total) == (2, 1, 16, 1)


def test_an_older_row_that_lands_later_does_not_replace_a_newer_one(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([("a", 9), ("b", 1)], [("a", 1), ("b", 2), ("c", 5)]):
        incremental.merge_into(spark.createDataFrame(rows, "k string, n int"), path, ["k"], ["n"], buckets=4, newest_wins=True)
    assert {r.k: r.n for r in incremental.read_table(spark, path).collect()} == {"a": 9, "b": 2, "c": 5}


def test_running_distance_and_segments_over_many_blocks(spark):
    rows = [(g, k, 50.0 + 0.001 * ((k * 7) % 11), 16.0 + 0.001 * k) for g in ("a", "b") for k in range(200)]
    frame = spark.createDataFrame(rows + [("c", 0, 50.0, 16.0)], "g string, k int, lat double, lon double").repartition(5)
    walked = graph.running_distance(frame, ["g"], "k")
    got = {(r.g, r.k): r.metres for r in walked.collect()}
    total, last = 0.0, None
    for g, k, lat, lon in rows[:200]:
        total += 0.0 if last is None else hav(last, (lat, lon))
        last = (lat, lon)
        assert abs(got["a", k] - total) < 1e-6 and abs(got["b", k] - total) < 1e-6
    assert got["c", 0] == 0.0 and len(got) == 401
    parts = graph.line_segments(walked, ["g"], "k", "metres").collect()
    assert len(parts) == 398
    assert all(abs(hav((p.lat, p.lon), (p.lat2, p.lon2)) - (p.end_m - p.start_m)) < 1e-6 for p in parts)


def test_a_merge_that_stops_before_the_switch_leaves_the_version_before(spark, tmp_path, monkeypatch):
    from acremark.streaming import versions

    path, schema = str(tmp_path / "store"), "parcel_id string, number string, corners int, seen int"
    rows = [(f"P{i}", "one", 3 + i % 2, 1) for i in range(20)]

    def corners(parcels):
        return parcels.select("parcel_id", F.explode(F.sequence(F.lit(1), F.col("corners"))).alias("point_index"))

    def state():
        parcels = {r.parcel_id: (r.number, r.corners) for r in versions.read_table(spark, path, "parcels").collect()}
        points = {r.parcel_id: r["count"] for r in versions.read_table(spark, path, "points").groupBy("parcel_id").count().collect()}
        return parcels, points

    incremental.merge_parcels(spark.createDataFrame(rows, schema), path, "seen", corners, 4, ("s", 0))
    before = state()
    batch = spark.createDataFrame([("P1", "two", 9, 2), ("P99", "new", 5, 2)], schema)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            incremental.merge_parcels(batch, path, "seen", corners, 4, ("s", 1))
    assert state() == before
    for _ in range(2):  # the second time the batch is known already
        incremental.merge_parcels(batch, path, "seen", corners, 4, ("s", 1))
        parcels, points = state()
        assert parcels == before[0] | {"P1": ("two", 9), "P99": ("new", 5)} and points == {p: n for p, (_, n) in parcels.items()}
    assert versions.manifest(spark, path)["number"] == 2
    known = versions.manifest(spark, path)
    versions.commit(spark, path, known, {})
    with pytest.raises(RuntimeError, match="another writer"):
        versions.commit(spark, path, known, {})


def test_old_versions_go_and_emptied_buckets_stay_empty(spark, tmp_path):
    import os

    from acremark.streaming import versions

    path = str(tmp_path / "store")
    for n in range(6):
        incremental.merge_into(spark.createDataFrame([("a", n)], "k string, n int"), path, ["k"], ["n"], buckets=2)
    assert versions.manifests(spark, path) == [4, 5, 6] and len(os.listdir(f"{path}/rows")) == 3
    assert [tuple(r) for r in versions.read_table(spark, path).select("k", "n").collect()] == [("a", 5)]
    versions.commit(spark, path, versions.manifest(spark, path), {"rows": {b: None for b in "01"}})
    assert versions.read_table(spark, path) is None
    assert versions.read_table(spark, str(tmp_path / "nothing")) is None


def test_event_time_windows_leave_late_rows_out_and_count_them(spark, tmp_path):
    import json

    land, store, mark = (str(tmp_path / n) for n in ("land", "store", "mark"))
    (tmp_path / "land").mkdir()

    def deliver(name, *rows):
        lines = [json.dumps({"time": t, "county_code": c, "stage": "fetch_page", "page": 1, "fetched": n, "inserted_or_updated": n,
                             "skipped_unchanged": 0, "errors": 0}) for t, c, n in rows]
        (tmp_path / "land" / name).write_text("\n".join(lines) + "\n")
        query = incremental.stream_page_windows(incremental.read_page_log(spark, land), store, mark, "1 hour", "2 hours", 2)
        query.awaitTermination()
        return incremental.late_rows(query)

    assert deliver("1.json", ("2024-05-01T10:10:00Z", "c1", 3), ("2024-05-01T10:50:00Z", "c1", 4)) == 0
    assert deliver("2.json", ("2024-05-01T10:20:00Z", "c1", 5), ("2024-05-01T14:00:00Z", "c2", 1)) == 0  # in time
    assert deliver("3.json", ("2024-05-01T10:30:00Z", "c1", 100), ("2024-05-01T14:30:00Z", "c2", 1)) == 1  # the window of 10 h is closed
    got = {(r.window_start.hour, r.county_code): (r.pages, r.fetched) for r in incremental.read_table(spark, store).collect()}
    assert got == {(10, "c1"): (3, 12), (14, "c2"): (2, 2)}


def test_a_star_has_one_component_and_no_join_on_its_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 50_000)
    n = 300_000
    for hub in (0, n + 5):
        edges = spark.range(1, n).select(F.lit(hub).cast("long").alias("src"), F.col("id").alias("dst"))
        got = graph.connected_components(edges).agg(F.count("*"), F.min("component"), F.max("component"), F.countDistinct("node")).first()
        assert tuple(got) == (n, min(hub, 1), min(hub, 1), n)


def test_components_of_many_shapes(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(30)] + [(900, 901), (901, 902), (902, 900)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: root[x] for x in linked}


def test_a_path_of_many_hops_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda frame: rounds.append(1) or cut(frame))
    n = 10_000
    line = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.lit(1.0) + F.col("id") % 3).alias("distance"))
    edges = line.unionByName(line.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    paths = graph.shortest_paths(edges, spark.createDataFrame([(0,)], "node long"))
    last = paths.orderBy(F.desc("distance")).first()
    assert paths.count() == n and last.node == n - 1 and last.prev == n - 2 and abs(last.distance - sum(1.0 + i % 3 for i in range(n - 1))) < 1e-6
    assert paths.where("node > 0 AND prev <> node - 1").count() == 0 and len(rounds) < 24


def test_shortest_paths_of_random_graphs(spark):
    rng = random.Random(8)
    for case in range(3):
        links = {}
        for i in range(1, 60):
            links[rng.randrange(max(0, i - 3), i), i] = rng.randint(1, 9)
        for _ in range(12 * case):
            a, b = sorted(rng.sample(range(60), 2))
            links[a, b] = rng.randint(1, 30)
        ring = [(70, 71, 1), (71, 72, 1), (72, 70, 1)]
        rows = [(a, b, float(d)) for (a, b), d in links.items()] + [(a, b, float(d)) for a, b, d in ring]
        rows += [(b, a, d) for a, b, d in rows]
        near, heap = {}, [(0.0, 5)]
        while heap:
            d, x = heapq.heappop(heap)
            if x not in near:
                near[x] = d
                heap += [(d + w, b) for a, b, w in rows if a == x]
                heapq.heapify(heap)
        got = {r.node: r for r in graph.shortest_paths(spark.createDataFrame(rows, "src long, dst long, distance double"), spark.createDataFrame([(5,)], "node long")).collect()}
        assert {x: r.distance for x, r in got.items()} == near
        weight = {(a, b): d for a, b, d in rows}
        for x, r in got.items():
            before = [a for a, b, d in rows if b == x and a in near and near[a] + d == near[x]]
            assert r.prev == (min(before) if x != 5 else None) and (x == 5 or weight[r.prev, x] + near[r.prev] == near[x])


def test_parcel_batches_are_not_written_anew_with_each_later_one(spark, tmp_path, monkeypatch):
    from acremark.streaming import versions

    path, written, write = str(tmp_path / "store"), [], versions.write_buckets

    def counted(rows, *others):
        written.append(rows.count())
        return write(rows, *others)

    def corners(parcels):
        return parcels.select("parcel_id", F.explode(F.array_repeat("seen", F.col("corners"))).alias("point_index"))

    monkeypatch.setattr(versions, "write_buckets", counted)
    want = {}
    for n in range(9):
        rows = [(f"P{20 * n + i}", 2, n) for i in range(20)] + [(f"P{7 * n}", 3, n)] * (n == 5) + [("P1", 0, n)] * (n == 6)
        want |= {k: (corners_, seen) for k, corners_, seen in rows}
        incremental.merge_parcels(spark.createDataFrame(rows, "parcel_id string, corners int, seen int"), path, "seen", corners, 4, ("s", n))
    parcels = {r.parcel_id: (r.corners, r.seen) for r in versions.read_table(spark, path, "parcels").collect()}
    points = {(r.parcel_id, r.point_index): r["count"] for r in versions.read_table(spark, path, "points").groupBy("parcel_id", "point_index").count().collect()}
    assert parcels == want and points == {(k, seen): n for k, (n, seen) in want.items() if n}
    assert "P1" in parcels and parcels["P35"] == (3, 5)
    assert sum(written) < 2.5 * (180 + 360)
