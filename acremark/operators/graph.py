"""Trail network: edges, components, shortest paths, a long path, boxes along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acremark.bbox import BBox
from acremark.functions.geo import haversine_m, interpolate, square_box
from acremark.operators.filters import inside_margin
from acremark.operators.ordering import beside, in_blocks, sums_before
from acremark.operators.spatial import interval_locate
from acremark.session import cut_lineage

MICRO = 1_000_000  # positions are rounded to six decimals, so they number exactly


def node_id(lat: Column, lon: Column) -> Column:
    """One number per six-decimal position; sorts by latitude, then longitude."""
    south = F.round((lat + 90.0) * MICRO).cast("long")
    west = F.round((lon + 180.0) * MICRO).cast("long")
    return south * F.lit(1_000_000_000) + west


def node_lat(node: Column) -> Column:
    return F.round(F.floor(node / F.lit(1_000_000_000)) / MICRO - 90.0, 6)


def node_lon(node: Column) -> Column:
    return F.round((node % F.lit(1_000_000_000)) / MICRO - 180.0, 6)


def way_edges(ways: DataFrame) -> DataFrame:
    """Edges (src, dst, distance) of consecutive way points, both directions, none of length zero.

    ``ways`` has ``geometry``, an array of (lat, lon); a mapped way has a bounded number of points.
    """
    steps = F.size("geometry") - 1
    pairs = ways.where(steps >= 1).select(
        F.inline(F.arrays_zip(F.slice("geometry", F.lit(1), steps).alias("a"), F.slice("geometry", F.lit(2), steps).alias("b")))
    )
    return edges_from_pairs(pairs.select("a.lat", "a.lon", F.col("b.lat").alias("lat2"), F.col("b.lon").alias("lon2")))


def edges_from_pairs(pairs: DataFrame) -> DataFrame:
    """Both directions of (lat, lon) to (lat2, lon2), zero lengths dropped."""
    one_way = pairs.select(
        node_id(F.col("lat"), F.col("lon")).alias("src"), node_id(F.col("lat2"), F.col("lon2")).alias("dst"),
        haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("distance"),
    ).where("distance > 0")
    # one scan for both directions
    both = F.array(
        F.struct("src", "dst", "distance"),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"),
    )
    return one_way.select(F.inline(both))


def edges_inside(edges: DataFrame, box: BBox, margin_km: float) -> DataFrame:
    def inside(node: str) -> Column:
        return inside_margin(node_lat(F.col(node)), node_lon(F.col(node)), box, margin_km)

    return edges.where(inside("src") & inside("dst"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Shortest of parallel edges; shrinks repeated segments before any iteration."""
    return edges.groupBy("src", "dst").agg(F.min("distance").alias("distance"))


#: Rows of one node from which on it is matched by a broadcast of such nodes alone: at most one in ``HUB`` rows.
HUB = 500_000


def _with_least(pairs: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """The pairs with the least ``other`` of their ``key``, no task getting all rows of a hub."""
    found = pairs.groupBy(key).agg(F.min(other).alias(name), F.count("*").alias("_rows"))
    hubs = cut_lineage(found.where(F.col("_rows") > HUB).drop("_rows"))
    if hubs.isEmpty():
        return pairs.join(found.drop("_rows"), key)
    others = pairs.join(F.broadcast(hubs.select(key)), key, "left_anti").join(found.drop("_rows"), key)
    return others.unionByName(pairs.join(F.broadcast(hubs), key))


def star_components(links: DataFrame, low: str = "one", high: str = "other", rounds: int = 60, store=cut_lineage) -> DataFrame:
    """(node, root) of the nodes of the links, the root being the smallest node that each is connected to.

    Alternates two steps until nothing changes: link every larger neighbour of a node to its smallest one, then do that
    among each node and its smaller neighbours. Depth shrinks in logarithmic rounds. Hubs are matched by
    :func:`_with_least`, so no join meets on a node or label that many rows hold. ``store`` cuts the lineage of a round.
    """
    one, other = F.col(low), F.col(high)
    pairs = store(links.where(one != other).select(F.least(one, other).alias("low"), F.greatest(one, other).alias("high")).distinct())
    before = None
    for _ in range(rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
                pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        before = state
        both = pairs.unionByName(pairs.select(F.col("high").alias("low"), F.col("low").alias("high")))
        near = _with_least(both, "low", "high", "_near").where("high > low")
        large = store(near.select(F.least("low", "_near").alias("low"), "high").distinct())
        small = _with_least(large, "high", "low", "floor")
        pairs = store(small.select(F.col("floor").alias("low"), "high").unionByName(
            small.where("low > floor").select(F.col("floor").alias("low"), F.col("low").alias("high"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of a component as its label."""
    return star_components(edges, "src", "dst").withColumnRenamed("root", "component")


def largest_component(components: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes (ties: smallest label)."""
    best = components.groupBy("component").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "component").limit(1)
    return components.join(best.select("component"), "component", "left_semi")


def contracted(links: DataFrame, keep: DataFrame, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(edges between junctions, ways out of the nodes within chains), of links in both directions.

    A chain node has two neighbours and the same distances there and back; ``keep`` and all other nodes are junctions. Every
    directed link is followed through chain nodes to the junction at its end by doubling, so the rounds are the
    logarithm of the longest chain. Edges are (src, dst, distance, via): the last node before ``dst``; ways are
    (node, end, distance, via): the junction that lies in the direction of the neighbour ``via``. Rings without a junction are left out.
    """
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("distance").alias("_back"))
    paired = links.join(back, ["src", "dst"], "full")
    same = F.coalesce(F.col("distance") == F.col("_back"), F.lit(False))
    degree = paired.groupBy("src").agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.min("dst").alias("one"), F.max("dst").alias("other"))
    chain = degree.where("n = 2 AND same = 2").join(keep.select(F.col("node").alias("src")).distinct(), "src", "left_anti").select(
        F.col("src").alias("end"), "one", "other")
    chain = cut_lineage(chain)

    def followed(rows: DataFrame) -> DataFrame:
        """``to`` is the node to go on to from ``end``, null at a junction; ``source`` is where the last step came from."""
        onward = F.when(F.col("one") == F.col("source"), F.col("other")).otherwise(F.col("one"))
        return rows.join(chain, "end", "left").withColumn("to", F.when(F.col("one").isNotNull(), onward)).drop("one", "other", "source")

    state = cut_lineage(followed(links.select("src", "dst", F.col("dst").alias("end"), "distance", F.col("src").alias("source"))))
    before = None
    for _ in range(rounds):
        waiting = state.where("to IS NOT NULL")
        left = waiting.count()
        if left in (0, before):
            break
        before = left
        jump = state.select(F.col("src").alias("end"), F.col("dst").alias("to"), F.col("end").alias("_end"), F.col("to").alias("_to"),
                            F.col("distance").alias("_distance"))
        moved = waiting.join(jump, ["end", "to"]).select("src", "dst", F.col("_end").alias("end"), (F.col("distance") + F.col("_distance")).alias("distance"),
                                                         F.col("_to").alias("to"))
        state = cut_lineage(state.where("to IS NULL").select("src", "dst", "end", "distance", "to").unionByName(moved))
    done = state.where("to IS NULL")
    inner = chain.select(F.col("end").alias("src"))
    ways = done.join(inner, "src", "left_semi").select(F.col("src").alias("node"), "end", "distance", F.col("dst").alias("via"))
    edges = done.join(inner, "src", "left_anti").where("src <> end").select(F.col("end").alias("src"), F.col("src").alias("dst"), "distance", F.col("dst").alias("via"))
    return edges, ways


def shortest_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, distance, prev) from the start node(s), for edges in both directions as :func:`way_edges` gives them.

    Chains of nodes with two neighbours are contracted to one edge first; junctions are swept by relaxing the edges of
    what just improved; nodes within chains then take the better of both ends. Equal distances prefer the smaller
    previous node. Rounds are the logarithm of the longest chain plus the most junctions on a shortest path.
    """
    links = cut_lineage(simple_edges(edges))
    junctions, ways = (cut_lineage(frame) for frame in contracted(links, start))
    none = F.lit(None).cast("long")
    state = cut_lineage(start.select("node", F.lit(0.0).alias("distance"), none.alias("prev"), F.lit(True).alias("fresh")))
    while True:
        tried = state.where("fresh").select(F.col("node").alias("src"), F.col("distance").alias("so_far")).join(junctions, "src").select(
            F.col("dst").alias("node"), (F.col("so_far") + F.col("distance")).alias("distance"), F.col("via").alias("prev"),
            F.lit(False).alias("known"),
        )
        # old and tried distances meet in one aggregation; what got shorter is the next frontier
        met = state.select("node", "distance", "prev", F.lit(True).alias("known")).unionByName(tried)
        best = met.groupBy("node").agg(
            F.min(F.struct("distance", "prev")).alias("b"), F.min(F.when(F.col("known"), F.col("distance"))).alias("was")
        )
        shorter = F.col("was").isNull() | (F.col("b.distance") < F.col("was"))
        state = cut_lineage(best.select("node", "b.distance", "b.prev", shorter.alias("fresh")))
        if state.where("fresh").isEmpty():
            break
    reached = state.select(F.col("node").alias("end"), F.col("distance").alias("so_far"))
    within = ways.join(reached, "end").groupBy("node").agg(
        F.min(F.struct((F.col("so_far") + F.col("distance")).alias("distance"), F.col("via").alias("prev"))).alias("b"))
    return cut_lineage(state.drop("fresh").unionByName(within.select("node", "b.distance", "b.prev")))


def farthest(paths: DataFrame) -> DataFrame:
    """The node at the largest distance (ties: smallest node)."""
    return paths.orderBy(F.desc("distance"), "node").limit(1).select("node")


def path_back(paths: DataFrame, end: DataFrame) -> DataFrame:
    """(node, distance) on the way from the start to ``end``, by doubling jumps along ``prev``."""
    on_path = cut_lineage(end.select("node"))
    jumps = cut_lineage(paths.where("prev IS NOT NULL").select("node", F.col("prev").alias("to")))
    while True:
        step = on_path.join(jumps, "node").select(F.col("to").alias("node"))
        found = cut_lineage(step.join(on_path, "node", "left_anti").distinct())
        if found.isEmpty():
            return paths.join(on_path, "node", "left_semi").select("node", "distance")
        on_path = cut_lineage(on_path.union(found))
        after = jumps.select(F.col("node").alias("to"), F.col("to").alias("end"))
        jumps = cut_lineage(jumps.join(after, "to").select("node", F.col("end").alias("to")))


def long_path(edges: DataFrame) -> DataFrame:
    """Two sweeps over the largest component: farthest node from its smallest, then farthest from that.

    Returns (node, distance from the first end). Exact on trees, as is the method.
    """
    component = cut_lineage(largest_component(connected_components(edges)))
    inner = edges.join(component.select(F.col("node").alias("src")), "src", "left_semi")
    first = component.select(F.min("node").alias("node"))
    one_end = farthest(shortest_paths(inner, first))
    second = shortest_paths(inner, one_end)
    return cut_lineage(path_back(second, farthest(second)))


def running_distance(path: DataFrame, group: list[str], order: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cumulative haversine length along an ordered path per group.

    Paths are cut into blocks of consecutive points; block lengths are added up first, on one row per block.
    """
    placed = beside(in_blocks(path, group, order), group, order, [F.col(lat), F.col(lon)], "_from")
    leg = haversine_m(F.col(f"_from.{lat}"), F.col(f"_from.{lon}"), F.col(lat), F.col(lon))
    legs = placed.withColumn("_leg", F.coalesce(leg, F.lit(0.0)))
    summed = sums_before(legs, group, "_block", [F.col(order)], F.col("_leg"), "_before")
    return summed.withColumn("metres", F.col("_before") + F.col("_leg")).drop("_before", "_leg", "_from", "_block")


def line_segments(points: DataFrame, group: list[str], order: str, metres: str) -> DataFrame:
    """Consecutive points of each group as segments: ``start_m``, ``end_m``, ``lat``, ``lon``, ``lat2``, ``lon2``."""
    following = [F.col(metres).alias("end_m"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")]
    placed = beside(in_blocks(points, group, order), group, order, following, "_next", ahead=True)
    return placed.where("_next IS NOT NULL").select(*group, F.col(metres).alias("start_m"), "lat", "lon", "_next.*")


def path_segments(path: DataFrame) -> DataFrame:
    """Consecutive path nodes as segments with start and end distance. One path, in order of distance."""
    spots = path.select("distance", node_lat(F.col("node")).alias("lat"), node_lon(F.col("node")).alias("lon"))
    ahead = line_segments(spots, [], "distance", "distance")
    # position zero belongs to the first segment
    return ahead.withColumn("after_m", F.when(F.col("start_m") == 0, F.lit(-1.0)).otherwise(F.col("start_m")))


def along_path(segments: DataFrame, positions: DataFrame, at: str = "metre", block_m: float = 1000.0) -> DataFrame:
    """Latitude and longitude at each metre position, clamped to the ends of the path."""
    length = segments.agg(F.max("end_m").alias("m")).scalar()
    clamped = positions.withColumn(at, F.greatest(F.lit(0.0), F.least(F.col(at), length)))
    hit = interval_locate(clamped, segments, at, "after_m", "end_m", block_m)
    return hit.select(
        *positions.columns,
        interpolate(F.col("lat"), F.col("lat2"), F.col("start_m"), F.col("end_m"), F.col(at)).alias("lat"),
        interpolate(F.col("lon"), F.col("lon2"), F.col("start_m"), F.col("end_m"), F.col(at)).alias("lon"),
    )


def path_boxes(segments: DataFrame, count: int = 20, size_km: float = 20.0, step_km: float = 7.0) -> DataFrame:
    """``count`` equal boxes centred on the path, at most ``step_km`` apart, the set in the middle."""
    spark = segments.sparkSession
    length = segments.agg(F.max("end_m").alias("m")).scalar()
    step = F.least(F.lit(step_km * 1000.0), length / max(1, count - 1))
    start = F.greatest(F.lit(0.0), (length - step * (count - 1)) / 2.0)
    spots = spark.range(count).select(
        (F.col("id") + 1).alias("index"), (start + F.col("id") * step).alias("metre"), F.round(step / 1000.0, 3).alias("step_km")
    )
    placed = along_path(segments, spots)
    return placed.withColumn("box", square_box(F.col("lat"), F.col("lon"), size_km)).select(
        "index", "step_km", "lat", "lon", "box.*"
    )


def path_samples(segments: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Evenly spaced points along the path, one per 250 m, at least 2; ``max_samples`` bounds them."""
    spark = segments.sparkSession
    length = segments.agg(F.max("end_m").alias("m")).scalar()
    count = F.greatest(F.lit(2), F.floor(length / 250)).cast("int")
    count = count if max_samples is None else F.least(F.lit(max_samples), count)
    spots = spark.range(1).select(F.posexplode(F.sequence(F.lit(1), count)).alias("i", "_n")).select(
        "i", (length * F.col("i") / (count - 1)).alias("metre")
    )
    return along_path(segments, spots)
