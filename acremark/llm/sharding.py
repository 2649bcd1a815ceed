"""Histogram sort of bus artifacts into shards of nearly equal bytes.

Artifacts are ordered by (hash of the payload, hash of the id), so equal payloads lie together. Rounds
of probing count the exact bytes between candidate keys in every partition, add the counts up and place
new probes inside the interval that holds each cut, until every cut is within its tolerance or cannot be
refined. Only then do the rows move, once, to their final key ranges.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acremark.llm.common import stored

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def keyed(artifacts: DataFrame, row_id: str, payload: str) -> DataFrame:
    """``_size`` (UTF-8 bytes plus 1; null payloads have none), ``_major`` and ``_minor`` sort keys."""
    text = F.coalesce(F.col(payload), F.lit(""))
    return artifacts.select(
        "*",
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.xxhash64(text).alias("_major"),
        F.xxhash64(F.col(row_id).cast("string")).alias("_minor"),
    )


class _Cut:
    """One wanted cut: the interval of keys that holds it and the bytes before the interval."""

    def __init__(self, target: float, tolerance: float):
        self.target, self.tolerance = target, tolerance
        self.low, self.high, self.before, self.at = LOWEST, HIGHEST, 0, None

    def probes(self, width: int) -> list[int]:
        span = self.high - self.low
        return sorted({self.low + span * k // width for k in range(1, width)} | {min(self.high, HIGHEST)})


def find_splitters(keys: DataFrame, targets: list[tuple[float, float]], group: tuple[int, int] | None = None,
                   width: int = 16) -> list[tuple[int, int | None]]:
    """For each (bytes before the cut, tolerance) the key to cut at: rows with a smaller key lie before.

    Works on ``_major``, and inside one hot value of it (``group``: that value and the bytes before it)
    on ``_minor``. Returns (cut, None), or (value, bytes before it) where the cut falls inside the rows
    of a single key and neither of its ends is near enough. Each round is one aggregation of at most
    ``width`` rows per cut.
    """
    column = "_major" if group is None else "_minor"
    rows = keys if group is None else keys.where(F.col("_major") == F.lit(group[0]))
    cuts = [_Cut(t, e) for t, e in targets]
    if group is not None:
        for c in cuts:
            c.before = group[1]
    out: list[tuple[int, int | None] | None] = [None] * len(cuts)
    while any(x is None for x in out):
        open_cuts = [c for c, x in zip(cuts, out) if x is None]
        edges = sorted({p for c in open_cuts for p in c.probes(width)} | {c.low for c in open_cuts})
        counted = _histogram(rows, column, edges)
        for i, c in enumerate(cuts):
            if out[i] is None:
                out[i] = _narrow(c, edges, counted)
    return out


def _histogram(rows: DataFrame, column: str, edges: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Exact bytes, least and greatest key and number of the rows from each edge (inclusive) to the next."""
    points = np.array(edges, dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, key.to_numpy(), side="right") - 1, dtype="int32")

    counted = rows.groupBy(bucket(F.col(column)).alias("_b")).agg(
        F.sum("_size").alias("bytes"), F.min(column).alias("least"), F.max(column).alias("greatest"), F.count("*").alias("n"))
    return {r["_b"]: (r["bytes"], r["least"], r["greatest"], r["n"]) for r in counted.collect()}


def _narrow(cut: _Cut, edges: list[int], counted: dict[int, tuple[int, int, int, int]]) -> tuple[int, int | None] | None:
    """Move the cut into the bucket that holds its target; the result once it is settled."""
    total = cut.before
    at = bisect.bisect_left(edges, cut.low)
    while at < len(edges) and edges[at] < cut.high:
        size, least, greatest, n = counted.get(at, (0, None, None, 0))
        if size and total + size >= cut.target:
            near_low, near_high = cut.target - total, total + size - cut.target
            if n == 1 or min(near_low, near_high) <= cut.tolerance:
                return (least, None) if near_low <= near_high else (min(greatest + 1, HIGHEST), None)
            if least == greatest:
                return least, total
            cut.low, cut.high, cut.before = least, greatest + 1, total
            return None
        total += size
        at += 1
    return min(cut.high, HIGHEST), None


def shard(artifacts: DataFrame, shards: int, row_id: str = "artifact_id", payload: str = "payload_json",
          tolerance: float = 0.004, ranges_per_shard: int = 16) -> DataFrame:
    """The rows with ``shard`` (0 to ``shards``-1) and ``slot`` (0, 1, ... within the shard, in key order).

    A shard's size is the payloads' UTF-8 bytes plus 1 a row (a null payload counts as empty). Cuts fall
    between groups of equal payloads wherever an end of the group is within ``tolerance`` (as a share of
    a shard) of the wanted place; otherwise the group is cut by id, and copies of one row are kept
    together. Each shard is written by ``ranges_per_shard`` tasks. Rows with null ids or payloads are
    placed like others; an empty table gives no rows; columns named like the new ones are replaced.
    """
    clean = artifacts.drop("shard", "slot")
    rows = keyed(clean, row_id, payload)
    keys = stored(rows.select("_major", "_minor", "_size"), "shard-keys")
    total = keys.agg(F.sum("_size")).first()[0]
    if not total:
        return clean.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    pieces = shards * ranges_per_shard
    share = total / pieces
    targets = [(share * k, tolerance * total / shards if k % ranges_per_shard == 0 else 0.5 * share)
               for k in range(1, pieces)]
    cuts = _final_cuts(keys, targets)
    majors, minors = np.array([c[0] for c in cuts], dtype=np.int64), np.array([c[1] for c in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for major, minor in batches:
            a, b = major.to_numpy(), minor.to_numpy()
            low, high = np.searchsorted(majors, a, side="left"), np.searchsorted(majors, a, side="right")
            for i in np.flatnonzero(high > low):
                low[i] += np.searchsorted(minors[low[i] : high[i]], b[i], side="right")
            yield pd.Series(low, dtype="int32")

    in_range = Window.partitionBy("_range").orderBy("_major", "_minor", F.col(row_id))
    placed = rows.withColumn("_range", range_of("_major", "_minor"))
    counts = {r["_range"]: r["count"] for r in
              keys.select(range_of("_major", "_minor").alias("_range")).groupBy("_range").count().collect()}
    starts, n = [], 0
    for k in range(pieces):
        n = 0 if k % ranges_per_shard == 0 else n
        starts.append(n)
        n += counts.get(k, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_range") + 1)
    return placed.select(
        *[F.col(f"`{c}`") for c in clean.columns],
        F.floor(F.col("_range") / ranges_per_shard).cast("int").alias("shard"),
        (offset + F.row_number().over(in_range) - 1).alias("slot"),
    )


def _final_cuts(keys: DataFrame, targets: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """(major, minor) of each cut; rows at or after it in that order lie behind."""
    found = find_splitters(keys, targets)
    cuts: list[tuple[int, int]] = [(m, LOWEST) for m, _ in found]
    for value, before in {x for x in found if x[1] is not None}:
        inside = [i for i, x in enumerate(found) if x == (value, before)]
        for i, (minor, _) in zip(inside, find_splitters(keys, [targets[i] for i in inside], (value, before))):
            cuts[i] = (value, minor)
    return sorted(cuts)
