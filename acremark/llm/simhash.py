"""SimHash near-duplicates of artifact payloads by anchor-point covering.

A pair of 64-bit fingerprints at distance 3 or less differs in at most one bit in one of its halves. The
anchors of a half are the codewords of a covering code on its 32 bits: the perfect Hamming code on 31
bits times the last bit, covering radius 1. A fingerprint goes to every anchor within 1 + 1 of its half
(at most 18), so both of a pair meet at the anchor nearest to either one, and are compared there.
Payloads are reduced to distinct fingerprints first. At an anchor, linked fingerprints are found by a
search that sets a fingerprint aside as soon as it is reached, so a dense group costs about its size,
not its square, and gives only enough links to hold it together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from acremark.llm.common import byte_texts, byte_words, discard, row_slices, stored

THRESHOLD = 3
#: An anchor with more members is compared in pairs of parts of this size, in separate tasks.
PART = 50_000


def simhash(text: bytes, size: int = 3) -> int:
    """The 64 majority bits of the XXH64 (seed 42) of each run of ``size`` words, repeats included.

    Fewer words make one run, none give 0.
    """
    found = byte_words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(0, len(found) - size)
    runs = zip(starts[: last + 1].tolist(), ends[min(size, len(found)) - 1 :].tolist())
    return majority(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in runs], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have, as a signed number; 0 for no hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(artifacts: DataFrame, row_id: str = "artifact_id", payload: str = "payload_json", shingle: int = 3) -> DataFrame:
    """``row_id`` and ``simhash`` (signed 64 bits) of every row; null or blank payloads get 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, 1, 16 << 20):
                prints = [simhash(t, shingle) for t in byte_texts(piece.column(1))]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(prints, pa.int64())], ["_id", "_print"])

    kind = artifacts.schema[row_id].dataType.simpleString()
    out = artifacts.select(row_id, payload).mapInArrow(run, f"_id {kind}, _print bigint")
    return out.select(F.col("_id").alias(row_id), F.col("_print").alias("simhash"))


def _parity(values: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of 31-bit values: xor of the places (1 to 31) of their set bits."""
    out = np.zeros(len(values), dtype=np.uint32)
    for place in range(1, 32):
        out ^= np.where(values >> np.uint32(place - 1) & np.uint32(1), np.uint32(place), np.uint32(0))
    return out


def _near_anchors(half: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, anchors) for all codewords within distance 2 of each 32-bit half."""
    body, last = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    syndrome = _parity(body)
    rows = np.arange(len(half))

    def flipped(value: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place > 0, value ^ (np.uint32(1) << np.maximum(place, 1).astype(np.uint32) - np.uint32(1)), value)

    nearest = flipped(body, syndrome)
    out = [(rows, nearest | last), (rows, nearest | last ^ np.uint32(0x80000000))]
    for place in range(1, 32):
        other = syndrome ^ np.uint32(place)
        keep = (syndrome > 0) & (other > place)  # each pair of places once; their xor is the syndrome
        two = flipped(flipped(body, np.full_like(syndrome, place)), other)
        out.append((rows[keep], (two | last)[keep]))
    return out


def _to_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for side in (0, 1):
            half = (prints >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for rows, anchors in _near_anchors(half):
                key = anchors.astype(np.int64) | np.int64(side) << np.int64(32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[rows].view(np.int64))], ["anchor", "simhash"])


def _distance(one: np.ndarray | np.uint64, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other)


def _links_within(members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that connect all members reachable over distances up to the threshold; one fewer than each group."""
    rest, links = members, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _distance(at, rest) <= threshold
            if near.any():
                found = rest[near]
                links += [(at, x) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def _links(threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] = []
        for batch in batches:
            block = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            block = np.concatenate([*carried, block], axis=1) if carried else block
            if not block.shape[1]:
                continue
            same = (block[0] == block[0, -1]) & (block[1] == block[1, -1])
            end = block.shape[1] - int(np.argmin(same[::-1])) if not same.all() else 0
            carried = [block[:, end:]]
            yield from _linked(block[:, :end], threshold)
        if carried:
            yield from _linked(carried[0], threshold)

    return run


def _linked(block: np.ndarray, threshold: int) -> Iterator[pa.RecordBatch]:
    """Links of whole groups of equal (anchor, part), which are adjacent; groups up to 8 all at once."""
    n = block.shape[1]
    if n < 2:
        return
    prints = block[2].view(np.uint64)
    starts = np.flatnonzero(np.r_[True, (block[0, 1:] != block[0, :-1]) | (block[1, 1:] != block[1, :-1])])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= 8, sizes)
    group = np.repeat(np.arange(len(starts)), sizes)
    one, other = [], []
    for step in range(1, 8):
        hit = small[:-step] & (group[step:] == group[:-step]) & (_distance(prints[step:], prints[:-step]) <= threshold)
        at = np.flatnonzero(hit)
        one.append(prints[at])
        other.append(prints[at + step])
    for g in np.flatnonzero(sizes > 8):
        links = _links_within(np.unique(prints[starts[g] : starts[g] + sizes[g]]), threshold)
        if links:
            one.append(np.array([a for a, _ in links], dtype=np.uint64))
            other.append(np.array([b for _, b in links], dtype=np.uint64))
    a, b = np.concatenate(one).view(np.int64), np.concatenate(other).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["one", "other"])


def links(prints: DataFrame, threshold: int = THRESHOLD, part: int = PART) -> DataFrame:
    """Distinct links (``one`` < ``other``) that connect what distances up to 3 between distinct ``simhash`` connect."""
    if threshold > 3:
        raise ValueError("two halves with one differing bit cover distances up to 3")
    distinct = prints.select("simhash").where("simhash is not null").distinct()
    spread = distinct.mapInArrow(_to_anchors, "anchor bigint, simhash bigint")
    # parts of crowded anchors meet in pairs (i, j): every two parts share one task
    crowded = spread.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > part).select(
        "anchor", F.ceil(F.col("n") / part).cast("int").alias("_parts"))
    if crowded.isEmpty():
        dealt = spread.select("anchor", F.lit(0).cast("long").alias("part"), "simhash")
    else:
        mine = F.pmod(F.xxhash64("simhash"), F.col("_parts"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1),
                            lambda j: F.least(mine, j) * 1_000_000 + F.greatest(mine, j))
        pairs = F.when(F.col("_parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
        dealt = spread.join(crowded, "anchor", "left").select("anchor", F.explode(pairs).alias("part"), "simhash")
    found = (dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
             .mapInArrow(_links(threshold), "one bigint, other bigint"))
    return found.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node that it is connected to) of the nodes of ``one < other`` links.

    Alternates two steps until nothing changes: link every larger neighbour of a node to its smallest
    one, then do that among each node and its smaller neighbours. Depth shrinks in logarithmic rounds.
    Joins on a hub are left to Spark's splitting of skewed partitions; each round ends in a stored table.
    """
    pairs = stored(edges.select(F.col("one").alias("low"), F.col("other").alias("high")), "links")
    before = None
    for _ in range(rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = pairs.unionByName(pairs.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy("low").agg(F.least(F.col("low"), F.min("high")).alias("least"))
        large = both.where("high > low").join(least, "low").select(F.col("least").alias("low"), "high").distinct()
        floor = large.groupBy("high").agg(F.min("low").alias("floor"))
        small = large.join(floor, "high")
        last, pairs = pairs, stored(
            small.select(F.col("floor").alias("low"), "high")
            .unionByName(small.where("low > floor").select(F.col("floor").alias("low"), F.col("low").alias("high")))
            .distinct(),
            "links",
        )
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root"))


def near_duplicates(artifacts: DataFrame, row_id: str = "artifact_id", payload: str = "payload_json",
                    shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """``row_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable) of every row.

    Rows are linked if their fingerprints differ in at most ``threshold`` bits. Equal fingerprints are
    reduced to one before linking. Null and blank payloads have fingerprint zero and are linked like any
    other; rows with equal ids are kept; rows with a null id are kept and share their group's id. An empty
    table gives no rows.
    """
    prints = stored(fingerprints(artifacts, row_id, payload, shingle), "simhash")
    least = prints.groupBy("simhash").agg(F.min(row_id).alias("_least"))
    roots = components(links(prints, threshold))
    rooted = least.join(roots, least["simhash"] == roots["node"], "left").select(
        "simhash", "_least", F.coalesce("root", "simhash").alias("root"))
    named = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_print = rooted.join(named, "root").select("simhash", "component_id")
    return prints.join(by_print, "simhash").select(
        row_id, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
