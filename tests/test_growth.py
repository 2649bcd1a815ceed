"""What tasks hold and what is sent, from the plans and the steps between."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from acremark.operators import geometry, imagery, spatial


def test_vertices_are_sorted_once_and_dealt_finer(spark, vertices):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    edges = geometry.ring_edges(vertices({"a": [[square]]}))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    join, follow = plan.index("Join Inner"), plan.index("lead(lon")
    assert join < follow  # the window lies below the join
    n = geometry.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {n}" in plan[follow:]
    assert sorted((r.lon0, r.lat0, r.lon1, r.lat1) for r in edges.collect()) == [(0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 1, 1), (1, 1, 0, 1)]


def test_pixel_lines_without_tile_lines_are_not_made(spark, vertices):
    points = vertices({"a": [[[(16.0, 50.0), (16.001, 50.0), (16.001, 50.001), (16.0, 50.001)]]]})
    runs = imagery.polygon_runs(points, 18)
    lines = sorted(r.gy for r in runs.select("gy").distinct().collect())
    wanted = lines[2:4]
    pictured = spark.createDataFrame([(g,) for g in wanted], "gy long")
    some = imagery.polygon_runs(points, 18, pictured=pictured)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, runs.where(F.col("gy").isin(wanted)).collect()))


def test_overlapping_boxes_are_shuffled_once(spark):
    """Pairs of boxes of mixed sizes equal the plain loops, and the boxes on their own grids go through one exchange."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        w, s, size = rng.uniform(0, 0.02), rng.uniform(0, 0.02), rng.choice([0.0, 5e-5, 3e-4, 1.2e-3, 5e-3])
        rows.append((None if i % 60 == 7 else i, rng.choice(["a", "b", None]), w, s, w + size, s + size * rng.choice([0.5, 1.0])))
    frame = spark.createDataFrame(rows, "id bigint, kind string, w double, s double, e double, n double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spatial.overlapping_boxes(frame, "id", ("w", "s", "e", "n"), ["kind"])
        got = Counter(tuple(sorted([(r.a_id is None, r.a_id, r.a_w), (r.b_id is None, r.b_id, r.b_w)], key=str)) for r in pairs.collect())
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def level(r):
        steps = math.ceil(math.log(max(r[4] - r[2], r[5] - r[3], 1e-4) / 1e-4) / math.log(4.0))
        return max(0, steps)

    want = Counter()
    for i, p in enumerate(rows):
        for q in rows[:i]:
            if p[1] == q[1] and p[4] >= q[2] and p[2] <= q[4] and p[5] >= q[3] and p[3] <= q[5]:
                if level(p) != level(q) or None not in (p[0], q[0]):  # keys decide among boxes of one grid
                    want[tuple(sorted([(p[0] is None, p[0], p[2]), (q[0] is None, q[0], q[2])], key=str))] += 1
    assert got == want and len(want) > 100
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]
