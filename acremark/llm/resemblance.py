"""Texts of which the sets of 5-word shingles have a Jaccard similarity of 0.8 or more, joined exactly.

Two sets of sizes a and b are linked if 9 |common| >= 4 (a + b). SimHash by anchor-point covering comes first: sets of which the
fingerprints differ in 3 bits or less meet at an anchor, are compared exactly, and make the first components. Texts of this
similarity also differ in more bits, so a second join completes the links. Under any one order of all shingles such a pair shares
a shingle among the first n - ceil(0.8 n) + 1 of each set, so only those meet in a shuffle, and no pair
is missed. The order puts shingles that are frequent in samples last: it decides the cost, never the result. Of rare shingles those
with the least hashes come first, so a share of all texts counts those alone, and shingles of some texts stay recognised as the table grows.
Equal sets are reduced to one in each task, and again when they meet, groups of the same members likewise. In a round, each member of
a shingle's group is compared with one centre only, which then leaves the group, as all its pairs are decided. The centre is a member of the group's largest component
with few rare shingles, which of copies of one text is close to that text and so to most of them. Groups that are connected
are done. Where rounds bring no more links, the pairs that are left are compared, so a dense group costs about its size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from acremark.llm.common import byte_texts, byte_words, discard, row_slices, stored
from acremark.llm.simhash import components, links as near_prints, majority

SIZE = 5
#: Texts of the sample that sets the order, and the most shingles that are put last.
SAMPLE, FREQUENT = 20_000, 400_000
#: Share of the texts that counts shingles below ``LOW``, which is beyond what first shingles of most texts reach.
SHARE, LOW = 0.4, np.uint64(int(0.3 * 2**64))
#: Rounds of centres at most, and undecided pairs a row below which no more are made; these pairs then meet in one join.
ROUNDS, LEFT = 10, 4
#: Up to this many nodes are broadcast.
BROADCAST_NODES = 1_000_000
_ODD = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """The XXH64 of each word, remembered; emptied once large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxh64_intdigest(word, 42)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: bytes, hashes: dict[bytes, int], size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of each run of ``size`` words; fewer words make one run, none make none."""
    found = byte_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter((hashes[w] for w in found), np.uint64, len(found))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _ODD[k]
    return np.unique(_mixed(out))


def node_of(items: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxh64_intdigest(items.tobytes(), 7)).view(np.int64))


def nodes(docs: DataFrame, text: str, *others: str) -> DataFrame:
    """``others``, the ``node`` of each row's set of shingles and the ``simhash`` of the set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for piece in row_slices(batch, 0, 4 << 20):
                found = [(node_of(items), majority(items)) for t in byte_texts(piece.column(0)) for items in [shingles(t, hashes)]]
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], *[pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]], [*others, "node", "simhash"])

    given = docs.select(text, *others)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:]]
    return given.mapInArrow(run, ", ".join([*kinds, "node bigint", "simhash bigint"]))


def _sets(needed: np.ndarray | None = None):
    """(node, items) of the texts' sets, each once a task; only those of ``needed`` nodes (sorted) where these are given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            for piece in row_slices(batch, 0, 4 << 20):
                found = {}
                for t in byte_texts(piece.column(0)):
                    items = shingles(t, hashes)
                    node = node_of(items)
                    if node not in seen:
                        seen.add(node)
                        if needed is None or (at := np.searchsorted(needed, node)) < len(needed) and needed[at] == node:
                            found[node] = items.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["node", "items"])

    return run


def _low(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles below ``LOW`` of the texts' sets, each set once a task."""
    hashes, seen = _Hashes(), set()
    for batch in batches:
        for piece in row_slices(batch, 0, 4 << 20):
            found = [np.zeros(0, np.int64)]
            for t in byte_texts(piece.column(0)):
                items = shingles(t, hashes)
                node = node_of(items)
                if node not in seen:
                    seen.add(node)
                    found.append(items[: np.searchsorted(items, LOW)].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["shingle"])


def _frequent(texts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that more than two texts of a sample have, the most frequent ones, and about how many of the ``rows`` texts do."""
    place = F.pmod(F.xxhash64(texts[0]), F.lit(rows))
    some = texts.where(place < SAMPLE).mapInArrow(_sets(), "node bigint, items array<bigint>").select(F.explode("items").alias("shingle"))
    counted = some.groupBy("shingle").agg((F.count("*") * (rows / min(rows, SAMPLE))).alias("n"), F.count("*").alias("seen"))
    if SHARE * rows > SAMPLE:
        low = texts.where(place < SHARE * rows).mapInArrow(_low, "shingle bigint").groupBy("shingle")
        low = low.agg((F.count("*") / SHARE).alias("n"), F.count("*").alias("seen"))
        counted = counted.where("seen > 2").unionByName(low.where("seen > 2")).groupBy("shingle").agg(F.max("n").alias("n"), F.max("seen").alias("seen"))
    found = counted.where("seen > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle", F.col("n").cast("long").alias("n")).toArrow()
    last = found["shingle"].to_numpy().view(np.uint64)
    by = np.argsort(last)
    return last[by], found["n"].to_numpy()[by]


_PREFIX = "shingle bigint, node bigint, n int, place int, rare int"


def _prefixes(last: np.ndarray, rank: np.ndarray):
    """(shingle, node, n, place, rare) of the first shingles of each set, each set once a task; those of ``last`` (sorted) come last, by ``rank``.

    ``rare`` counts the set's shingles that are not among ``last``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            for piece in row_slices(batch, 0, 4 << 20):
                out = [[np.zeros(0, np.int64)] for _ in range(5)]
                for t in byte_texts(piece.column(0)):
                    items = shingles(t, hashes)
                    n, node = len(items), node_of(items)
                    if not n or node in seen:
                        continue
                    seen.add(node)
                    held = n - -(-4 * n // 5) + 1
                    late = np.zeros(n, np.int64)
                    if len(last):
                        near = np.minimum(np.searchsorted(last, items), len(last) - 1)
                        late = np.where(last[near] == items, rank[near], 0)
                    first = items[np.lexsort((items, late))[:held]]
                    for into, values in zip(out, (first.view(np.int64), np.full(held, node), np.full(held, n), np.arange(held), np.full(held, n - np.count_nonzero(late)))):
                        into.append(values)
                columns = [pa.array(np.concatenate(c)) for c in out]
                yield pa.RecordBatch.from_arrays([*columns[:2], *[c.cast(pa.int32()) for c in columns[2:]]], ["shingle", "node", "n", "place", "rare"])

    return run


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that more than one node has, of rows sorted by shingle and node; repeats go.

    Only the last row, of which the next one decides, is carried from batch to batch.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    carried, wanted = np.zeros((5, 0), np.int64), False  # wanted: a row with the carried one's shingle came before it

    def rows(block: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(block, kinds)], ["shingle", "node", "n", "place", "rare"])

    for batch in batches:
        block = np.concatenate([carried, np.stack([batch.column(i).to_numpy() for i in range(5)])], axis=1)
        if not block.shape[1]:
            continue
        block = block[:, np.r_[True, (block[0, 1:] != block[0, :-1]) | (block[1, 1:] != block[1, :-1])]]
        same = block[0, 1:] == block[0, :-1]
        keep = np.r_[wanted, same] | np.r_[same, False]
        yield rows(block[:, :-1][:, keep[:-1]])
        carried, wanted = block[:, -1:], bool(keep[-1])
    yield rows(carried[:, [wanted] * carried.shape[1]])


def _merged(shared: DataFrame) -> DataFrame:
    """The rows with groups of the same members made one, ``shingle`` its name, with the least place of each member.

    Texts that share a passage meet at each of its shingles, mostly in the same company. A name that two different groups
    get by chance only joins them, so no pair of a group is lost.
    """
    names = shared.groupBy("shingle").agg(F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("node"))).alias("_name"))
    return (shared.join(names, "shingle").groupBy(F.col("_name").alias("shingle"), "node")
            .agg(*[F.min(c).alias(c) for c in ("n", "place", "rare")]))


def _close(one: str, other: str):
    """What holds for two set sizes and places at the first shingle that a linked pair shares."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    rest = F.least(n - F.col(f"{one}.place"), m - F.col(f"{other}.place"))
    return 9 * rest >= 4 * (n + m)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``one`` < ``other``) of which the sets are similar enough."""
    both = (pairs.join(sets.select(F.col("node").alias("one"), F.col("items").alias("a")), "one")
            .join(sets.select(F.col("node").alias("other"), F.col("items").alias("b")), "other"))
    common = F.size(F.array_intersect("a", "b"))
    return both.where(9 * common >= 4 * (F.size("a") + F.size("b"))).select("one", "other")


def _ordered(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.select(F.least(a, b).alias("one"), F.greatest(a, b).alias("other")).distinct()


def _with_sets(texts: DataFrame, pairs: DataFrame, known: DataFrame | None, hashes: DataFrame) -> DataFrame | None:
    """``known`` (node, items) and, stored, the sets of the nodes of the pairs that are not among them.

    Only texts with the ``text_hash`` of a needed node are read by Python.
    """
    needed = pairs.select("one").union(pairs.select("other")).distinct()
    needed = stored(needed if known is None else needed.join(known, needed["one"] == known["node"], "left_anti"), "needed")
    count = needed.count()
    if not count:
        return known
    if count <= BROADCAST_NODES:
        wanted = hashes.join(F.broadcast(needed), hashes["node"] == needed["one"]).select("text_hash").distinct()
        if wanted.count() <= BROADCAST_NODES:
            texts = texts.join(F.broadcast(wanted), F.xxhash64(texts[0]) == wanted["text_hash"], "left_semi")
        found = texts.mapInArrow(_sets(np.sort(needed.toArrow()["one"].to_numpy())), "node bigint, items array<bigint>")
    else:
        found = texts.mapInArrow(_sets(), "node bigint, items array<bigint>").join(needed.withColumnRenamed("one", "node"), "node", "left_semi")
    found = stored(found.dropDuplicates(["node"]), "sets")
    return found if known is None else known.unionByName(found)


def near_pairs(named: DataFrame) -> DataFrame:
    """Pairs (``one`` < ``other``) that hold together the nodes of equal fingerprints and of those at 3 bits or less, by anchors."""
    prints = stored(named.groupBy("simhash", "node").agg(F.count("*").alias("n")).drop("n"), "prints")
    least = prints.groupBy("simhash").agg(F.min("node").alias("least"))
    equal = prints.join(least, "simhash").where("node != least").select(F.col("node").alias("x"), F.col("least").alias("y"))
    near = near_prints(prints)
    for end, name in (("one", "x"), ("other", "y")):
        near = near.join(least.select(F.col("simhash").alias(end), F.col("least").alias(name)), end)
    return _ordered(equal.unionByName(near.select("x", "y")), "x", "y")


def _rooted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the ``root`` of their node."""
    return rows.join(known, "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("root"))


def _met(rooted: DataFrame, turn: int) -> DataFrame:
    """The rows of groups with more than one root, beside a ``centre`` of the group's largest component, and whether they have to be compared.

    In even turns the centre has the fewest rare shingles, in odd ones the least hash.
    """
    order = [F.xxhash64("node", F.lit(turn)), F.col("node")]
    best = F.min_by(F.struct("node", "n", "place", "root"), F.struct(*([F.col("rare")] if turn % 2 == 0 else []), *order))
    parts = rooted.groupBy("shingle", "root").agg(F.count("*").alias("size"), best.alias("best"))
    centres = parts.groupBy("shingle").agg(
        F.max_by("best", F.struct("size", "root")).alias("c"), F.sum("size").alias("members"), F.count("*").alias("_kinds")).where("_kinds > 1")
    near = (F.col("a.root") != F.col("c.root")) & _close("a", "c")
    return rooted.alias("a").join(centres, "shingle").select("a.*", F.col("c.node").alias("centre"), "members", near.alias("near"))


def _undecided(rooted: DataFrame) -> int:
    """The pairs, at most, of members of different components in all groups, once a group."""
    parts = rooted.groupBy("shingle", "root").agg(F.count("*").alias("size"))
    groups = parts.groupBy("shingle").agg(F.sum("size").alias("all"), F.max("size").alias("most"))
    return groups.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0


def roots(docs: DataFrame, text: str, hashes: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the nodes that are connected to a smaller one over similar sets.

    ``hashes`` has the node, simhash (see :func:`nodes`) and text_hash (the XXH64 of the text, as Spark has it) of all texts.

    Null texts have no node; texts without a word share one, which is connected to nothing. Rows with equal sets are one
    node, however many there are. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(text).where(F.col(text).isNotNull())
    rows = max(1, texts.count())
    # the order only has to be one and the same for all
    spread = texts.mapInArrow(_prefixes(*_frequent(texts, rows)), _PREFIX)
    shared = stored(spread.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(_shared, _PREFIX), "shared")
    pairs = stored(near_pairs(hashes), "pairs")
    sets = _with_sets(texts, pairs, None, hashes)
    links = stored(_verified(pairs, sets) if sets is not None else pairs, "similar")
    known = components(links)
    rooted = stored(_rooted(_merged(shared), known), "rooted")
    rows_left = rooted.count()
    discard(pairs, shared)
    for turn in range(ROUNDS):
        met = stored(_met(rooted, turn), "met")
        pairs = stored(_ordered(met.where("near").select("node", "centre"), "node", "centre"), "pairs")
        sets = _with_sets(texts, pairs, sets, hashes)
        fresh = stored(_verified(pairs, sets) if sets is not None else pairs, "similar")
        found = not fresh.isEmpty()
        if found:
            known = components(known.select(F.col("root").alias("one"), F.col("node").alias("other")).unionByName(fresh))
        before, rooted = rooted, stored(_rooted(met.where("members > 2 and node != centre").select(*shared.columns), known), "rooted")
        discard(before, met, pairs, fresh)
        if not found or _undecided(rooted) <= LEFT * rows_left:
            break
    # of each group all but its largest component meet what they are not connected to
    counted = rooted.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    most = counted.groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("_kinds")).where("_kinds > 1")
    apart = rooted.join(most, "shingle").where("root != most").drop("most", "_kinds")
    pairs = apart.alias("a").join(rooted.alias("b"), "shingle").where((F.col("a.root") != F.col("b.root")) & _close("a", "b"))
    pairs = stored(_ordered(pairs.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")), "x", "y"), "pairs")
    sets = _with_sets(texts, pairs, sets, hashes)
    fresh = _verified(pairs, sets) if sets is not None else pairs
    found = components(known.select(F.col("root").alias("one"), F.col("node").alias("other")).unionByName(fresh))
    discard(rooted, pairs)
    return found
