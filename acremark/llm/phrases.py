"""Collocations in the payloads of bus artifacts: phrases of two to four words that stand together more than by chance.

Words get ids by frequency, and texts are stored once as ids. Pairs of ids are counted by direct address: the id plane is cut
into tiles, a tile with many occurrences is an array of counters filled by ``bincount``, the others are sorted lists of
(cell, count). Longer phrases are counted as sorted lists of packed ids, where all shorter phrases in them are frequent as far as
a sieve tells; it lets some others pass, which the counts then leave out. Tasks hand on their lists packed by range of a hash,
and a task for each range adds them up.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acremark.llm.common import LOWER_BYTES, byte_texts, discard, most_frequent, row_slices, stored

#: Ids of words that a task holds, what is beyond is counted by its words; phrases of one length that a sieve takes, with more there is none.
WORD_IDS, PHRASE_IDS = 1 << 21, 1 << 26
#: Bits of a word id in a packed cell, where one cell has three, and of a tile's cell and side.
_ID_BITS, _IDS_A_CELL = 21, 3
_WORD_BITS, _SIDE_BITS = 20, 10
#: Occurrences in one slice of texts that make a tile an array, and arrays a task holds at most.
_DENSE, _ARRAYS = 1 << 14, 24
#: Cells or strings that a task holds before it hands them on; bytes of text in a slice; ids in a stored row, about, as Spark reads 10,000 rows at once.
_HELD, _SLICE, _STORED = 1 << 20, 16 << 20, 1 << 10
#: Occurrences that a tile's 32 bits count at least.
_COUNTED = 1 << 30
#: Bits of the largest sieve, and bits for each phrase in a smaller one.
_SIEVE_BITS, _SIEVE_SHARE = 28, 32
#: Words of the texts for each range of cells.
_RANGE = 1 << 21
#: Fixed value: the score's scale.
SCALE = 2_000_000
_BREAK, _BLANK, _OTHER = -2, -3, -1
#: A-Z lower-cased, the marks that end a piece to line feeds, tabs to blanks.
_PIECES = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in LOWER_BYTES)


def _tokens(text: bytes) -> list[bytes]:
    """The words of a text in order, a line feed between pieces; empty tokens between blanks."""
    return text.replace(b"\n", b" \n ").split(b" ")


def _parts(text: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """A text with its marks translated, a long one in parts of whole pieces."""
    text, at = text.translate(_PIECES), 0
    while len(text) - at > most:
        end = text.rfind(b"\n", at, at + most)
        end = end if end >= 0 else text.find(b"\n", at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


def _rows(artifacts: DataFrame, text: str, group: str) -> DataFrame:
    return artifacts.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"), F.col(text).alias("text"))


def _slices(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[str, bytes]]:
    """(group, parts of its texts with a line feed after each), see :func:`_parts`; about ``most`` bytes of all groups at a time."""
    held, size = defaultdict(list), 0

    def out() -> Iterator[tuple[str, bytes]]:
        for group, parts in held.items():
            parts.append(b"")
            yield group, b"\n".join(parts)

    for batch in batches:
        for piece in row_slices(batch, 1, 16 << 20):
            for group, text in zip(piece.column(0).to_pylist(), byte_texts(piece.column(1))):
                for part in _parts(text):
                    held[group].append(part)
                    size += len(part) + 1
                    if size > most:
                        yield from out()
                        held, size = defaultdict(list), 0
    yield from out()


def _coded(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The tokens of a slice as numbers of its distinct words, these words, and whether a piece ends after a token.

    Every token ends at a blank or line feed; between two of them lies the empty word.
    """
    marks = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero((marks == 10) | (marks == 32))
    offsets = np.concatenate([np.zeros(1, np.int64), ends + 1])
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text.replace(b"\n", b" "))])
    words = words.dictionary_encode()
    return words.indices.to_numpy(), pc.binary_slice(words.dictionary, 0, -1), marks[ends] == 10


def word_counts(rows: DataFrame) -> DataFrame:
    """(grp, word, n) over all rows of (grp, text); a null word stands for all words of the group."""

    def merged(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        distinct, n = pa.concat_arrays(words).dictionary_encode(), np.concatenate(counts)
        summed = np.zeros(len(distinct.dictionary), np.int64)
        np.add.at(summed, distinct.indices.to_numpy(), n)
        return distinct.dictionary, summed

    def out(grp: str, words: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), 1 << 16):
            part = words.slice(at, 1 << 16).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(part), pa.string()), part, pa.array(n[at:at + len(part)])], ["grp", "word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = Counter(), defaultdict(lambda: ([], [])), 0
        for grp, text in _slices(batches, _SLICE >> 1):
            codes, words, _ = _coded(text)
            n = np.bincount(codes, minlength=len(words)).astype(np.int64)
            full = pc.greater(pc.binary_length(words), 0)
            words, n = words.filter(full), n[full.to_numpy(zero_copy_only=False)]
            total[grp] += int(n.sum())
            for column, found in zip(held[grp], (words, n)):
                column.append(found)
            size += len(n)
            if size > 2 * _HELD:
                for group, columns in held.items():
                    held[group] = tuple([column] for column in merged(*columns))
                size = sum(len(n[0]) for _, n in held.values())
                if size > _HELD:
                    for group, (words, n) in held.items():
                        yield from out(group, words[0], n[0])
                    held, size = defaultdict(lambda: ([], [])), 0
        for group, columns in held.items():
            yield from out(group, *merged(*columns))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()),
                                          pa.array(list(total.values()), pa.int64())], ["grp", "word", "n"])

    return rows.mapInArrow(run, "grp string, word string, n bigint").groupBy("grp", "word").agg(F.sum("n").alias("n"))


@dataclass
class Ids:
    """Ids of frequent words of all groups: ``words[id]`` of the group ``groups[group_of[id]]``."""

    words: pa.Array
    groups: pa.Array
    group_of: np.ndarray

    @classmethod
    def by_frequency(cls, counted: DataFrame) -> Ids:
        table = counted.select("n", "grp", "word").toArrow().sort_by([("n", "descending"), ("grp", "ascending"), ("word", "ascending")])
        grp = pa.array([], pa.string()) if not len(table) else table["grp"].combine_chunks()
        word = pa.array([], pa.string()) if not len(table) else table["word"].combine_chunks()
        grp = grp.dictionary_encode()
        return cls(word, grp.dictionary, grp.indices.to_numpy())

    @cached_property
    def _by_group(self) -> dict[str, tuple[pa.Array, np.ndarray]]:
        order = np.argsort(self.group_of, kind="stable")
        ends = np.searchsorted(self.group_of[order], np.arange(1, len(self.groups)))
        words = self.words.cast(pa.binary()).cast(pa.large_binary())
        return {g: (words.take(pa.array(at)), at) for g, at in zip(self.groups.to_pylist(), np.split(order, ends))}

    def of(self, group: str, words: pa.Array) -> np.ndarray:
        """The ids of words of a group, ``_OTHER`` for those without one."""
        if group not in self._by_group:
            return np.full(len(words), _OTHER, np.int32)
        known, ids = self._by_group[group]
        at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
        return np.where(at >= 0, ids[at], _OTHER).astype(np.int32)


class Tiles:
    """Counts of cells: arrays for crowded tiles, sorted (cell, count) lists for the others."""

    def __init__(self, word_bits: int = _WORD_BITS):
        self.word_bits = word_bits
        self.arrays: dict[int, np.ndarray] = {}
        self.cells, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.waiting = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        side, mask = 1 << _SIDE_BITS, (1 << _SIDE_BITS) - 1
        tile = (left >> _SIDE_BITS) << (self.word_bits - _SIDE_BITS) | right >> _SIDE_BITS
        if not len(tile):
            return
        size = np.bincount(tile)
        crowded = size >= _DENSE
        crowded[[t for t in self.arrays if t < len(size)]] = True
        crowded = np.flatnonzero(crowded & (size > 0))
        rest = np.ones(len(tile), bool)
        for t in crowded[np.argsort(-size[crowded], kind="stable")].tolist():
            if t in self.arrays or len(self.arrays) < _ARRAYS:
                here = tile == t
                rest &= ~here
                place = (left[here] & mask) << _SIDE_BITS | right[here] & mask
                found = np.bincount(place, minlength=side * side)
                if t in self.arrays:
                    self.arrays[t] += found.astype(np.int32)
                else:
                    self.arrays[t] = found.astype(np.int32)
        cells, counts = np.unique(left[rest] << self.word_bits | right[rest], return_counts=True)
        self.cells.append(cells)
        self.counts.append(counts)
        self.waiting += len(cells)

    def merge(self) -> int:
        """Brings the lists together; gives the number of cells in them."""
        (cells,), counts = _summed([np.concatenate(self.cells)], np.concatenate(self.counts))
        self.cells, self.counts, self.waiting = [cells], [counts], 0
        return len(cells)

    def take(self, arrays: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The counted cells, of the lists and with ``arrays`` of the crowded tiles; they are gone from here then."""
        self.merge()
        yield self.cells[0], self.counts[0]
        self.cells, self.counts = [self.cells[0][:0]], [self.counts[0][:0]]
        mask = (1 << _SIDE_BITS) - 1
        for t in list(self.arrays) if arrays else []:
            found = self.arrays.pop(t)
            at = np.flatnonzero(found)
            left = (t >> (self.word_bits - _SIDE_BITS)) << _SIDE_BITS | at >> _SIDE_BITS
            yield left << self.word_bits | (t & mask) << _SIDE_BITS | at & mask, found[at].astype(np.int64)


def coded_texts(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(ids) of all texts as int32, below zero where a piece ends or a word has no id; a row holds whole runs of ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, text in _slices(batches, _SLICE):
            codes, words, breaks = _coded(text)
            ids = np.where(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), _BLANK, shared.value.of(grp, words)).astype(np.int32)
            found = np.stack([ids[codes], np.where(breaks, _BREAK, _BLANK).astype(np.int32)], axis=1).ravel()
            found = found[found != _BLANK]
            known = found >= 0
            found = found[known | np.append(known[1:], True)]  # of a run of others the last one
            ends = np.flatnonzero(found < 0) + 1
            cuts = ends[np.searchsorted(ends, np.arange(_STORED, len(found) + _STORED, _STORED).clip(max=len(found)))] if len(ends) else ends
            at = np.unique(np.append(0, cuts)) * found.itemsize
            stored_ids = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([stored_ids.cast(pa.binary())], ["ids"])

    return rows.mapInArrow(run, "ids binary")


def _cells(k: int, words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The phrases of k words that begin at the places ``at``, three ids packed in each number."""
    out = []
    for first in range(0, k, _IDS_A_CELL):
        cell = words[at + first]
        for i in range(first + 1, min(first + _IDS_A_CELL, k)):
            cell = cell << _ID_BITS | words[at + i]
        out.append(cell)
    return out


def _names(k: int) -> list[str]:
    return [f"c{i}" for i in range(-(-k // _IDS_A_CELL))]


def _mixed(cells: list[np.ndarray]) -> np.ndarray:
    """64 bits of a hash of packed phrases."""
    out = np.zeros(len(cells[0]), np.uint64)
    for cell in cells:
        out = (out ^ cell.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


class Sieve:
    """A bit for each hash of a phrase: never false for a phrase that was added, seldom true for others."""

    def __init__(self, phrases: int):
        self.bits = min(_SIEVE_BITS, max(10, (phrases * _SIEVE_SHARE).bit_length()))
        self.held = np.zeros(1 << (self.bits - 3), np.uint8)

    def _place(self, cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        place = _mixed(cells) >> np.uint64(64 - self.bits)
        return (place >> np.uint64(3)).astype(np.int64), (place & np.uint64(7)).astype(np.uint8)

    def add(self, cells: list[np.ndarray]) -> None:
        byte, bit = self._place(cells)
        np.bitwise_or.at(self.held, byte, np.uint8(1) << bit)

    def has(self, cells: list[np.ndarray]) -> np.ndarray:
        byte, bit = self._place(cells)
        return self.held[byte] >> bit & np.uint8(1) > 0


def sieve(cells: DataFrame, k: int, most: int) -> Sieve | None:
    """The sieve of stored phrases of k words, brought here piece by piece; none for more than ``most``."""
    n, piece = cells.count(), 1 << 21
    if n > most:
        return None
    out, names = Sieve(n), _names(k)
    for i in range(-(-n // piece)):
        part = cells.select(*names).where(F.pmod(F.xxhash64(*names), F.lit(-(-n // piece))) == i).toArrow()
        out.add([part[c].to_numpy() for c in names])
    return out


def _starts(k: int, words: np.ndarray, sieves: dict[int, Sieve | None]) -> np.ndarray:
    """Places where k words with ids begin, all shorter phrases in them frequent as far as the sieves tell."""
    on = words >= 0
    for m in range(2, k):
        on = on[:-1] & on[1:]
        if sieves[m] is not None:
            at = np.flatnonzero(on)
            on[at] = sieves[m].has(_cells(m, words, at))
    return np.flatnonzero(on[:-1] & on[1:])


def _summed(cells: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases and the sums of their counts."""
    order = np.lexsort(cells[::-1]) if len(cells) > 1 else np.argsort(cells[0], kind="stable")
    cells = [c[order] for c in cells]
    first = np.ones(len(order), bool)
    first[1:] = np.any([c[1:] != c[:-1] for c in cells], axis=0)
    at = np.flatnonzero(first)
    return [c[at] for c in cells], np.add.reduceat(n[order], at) if len(at) else n


def cell_counts(coded: DataFrame, k: int, sieves: dict[int, Sieve | None], least: int, ranges: int) -> DataFrame:
    """(c0, ..., n) of the phrases of k words with ids that occur ``least`` times, see :func:`_cells`."""
    names = _names(k)
    shared = coded.sparkSession.sparkContext.broadcast(sieves)

    def packed(cells: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(n), _HELD >> 1):
            part = slice(first, first + (_HELD >> 1))
            where = (_mixed([c[part] for c in cells]) >> np.uint64(33)) % np.uint64(ranges)
            where = where.astype(np.uint16 if ranges <= 1 << 16 else np.int64)
            order = np.argsort(where, kind="stable")
            at = np.searchsorted(where[order], np.arange(ranges + 1))
            used = np.flatnonzero(np.diff(at))
            columns = [pa.array([c[at[r]:at[r + 1]].tobytes() for r in used], pa.binary()) for c in (c[part][order] for c in (*cells, n))]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *columns], ["range", *names, "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves, tiles = shared.value, Tiles(_ID_BITS)
        held: list[list[np.ndarray]] = []
        counted = 0

        def listed() -> Iterator[pa.RecordBatch]:
            cells = [np.concatenate(c) for c in zip(*held)]
            if len(cells) == 1:
                distinct, n = np.unique(cells[0], return_counts=True)
                yield from packed([distinct], n.astype(np.int64))
            else:
                yield from packed(*_summed(cells, np.ones(len(cells[0]), np.int64)))

        for words in _runs(batches):
            at = _starts(k, words, sieves)
            if k == 2:
                tiles.add(words[at], words[at + 1])
                counted += len(at)
                crowded = counted > _COUNTED
                if crowded or tiles.waiting > 3 * _HELD and tiles.merge() > 2 * _HELD:
                    for cells, n in tiles.take(crowded):
                        yield from packed([cells], n)
                    counted *= not crowded
            elif len(at):
                held.append(_cells(k, words, at))
                if sum(len(c[0]) for c in held) > 2 * _HELD:
                    yield from listed()
                    held = []
        if held:
            yield from listed()
        for cells, n in tiles.take(True) if k == 2 else ():
            yield from packed([cells], n)

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        waiting = done = 0

        def summed() -> list[np.ndarray]:
            *cells, n = [np.concatenate(c) for c in zip(*held)]
            cells, n = _summed(cells, n)
            return [*cells, n]

        for batch in batches:
            for row in zip(*(batch.column(name) for name in [*names, "n"])):
                held.append([np.frombuffer(v.as_buffer(), np.int64) for v in row])
                waiting += len(held[-1][0])
                if waiting > max(2 * done, 4 * _HELD):
                    held = [summed()]
                    waiting = done = len(held[0][0])
        if held:
            columns = summed()
            enough = columns[-1] >= least
            for part in pa.table([c[enough] for c in columns], names=[*names, "n"]).to_batches(1 << 16):
                yield part

    binary = ", ".join(f"{name} binary" for name in [*names, "n"])
    sent = coded.mapInArrow(count, f"range int, {binary}").repartitionById(ranges, F.col("range"))
    return sent.mapInArrow(add_up, ", ".join(f"{name} bigint" for name in [*names, "n"]))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The ids of stored rows, about a million at a time."""
    for batch in batches:
        ids = batch.column(0)
        if not len(ids):
            continue
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
        words = np.frombuffer(ids.buffers()[2], np.int32)
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(at, int(at[first]) + 4 * _HELD, "right")) - 1)
            yield words[at[first] // 4:at[last] // 4].astype(np.int64)
            first = last


def open_counts(rows: DataFrame, k: int, shared: Broadcast) -> DataFrame:
    """(grp, phrase, n) of the phrases of k words that :func:`cell_counts` leaves out, as one of the words has no id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in counts], pa.string()), pa.array([p for _, p in counts], pa.binary()).cast(pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], ["grp", "phrase", "n"])

        for grp, text in _slices(batches, _SLICE >> 1):
            tokens = [t for t in _tokens(text) if t]
            ends = np.fromiter((t == b"\n" for t in tokens), bool, len(tokens))
            others = ~ends & (shared.value.of(grp, pa.array(tokens, pa.large_binary())) < 0)
            ends, others = (np.cumsum(np.append(0, c)) for c in (ends, others))
            for i in np.flatnonzero((ends[k:] == ends[:-k]) & (others[k:] > others[:-k])).tolist():
                counts[grp, b" ".join(tokens[i:i + k])] += 1
                if len(counts) > _HELD:
                    yield out()
                    counts = Counter()
        yield out()

    return rows.mapInArrow(run, "grp string, phrase string, n bigint").groupBy("grp", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(artifacts: DataFrame, text: str = "payload_json", group: str = "artifact_type", longest: int = 4, least: int = 30,
                     word_ids: int = WORD_IDS, phrase_ids: int = PHRASE_IDS) -> tuple[DataFrame, DataFrame]:
    """((grp, words, n) of all phrases of 1 to ``longest`` words that occur ``least`` times, (grp, n) of all words), stored."""
    if word_ids > 1 << _ID_BITS:
        raise ValueError(f"at most {1 << _ID_BITS} words can have ids")
    rows = _rows(artifacts, text, group)
    context = rows.sparkSession.sparkContext
    words = stored(word_counts(rows).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = words.where("word is null").select("grp", "n")
    frequent = words.where("word is not null")
    head, whole = most_frequent(frequent, word_ids)
    ids = context.broadcast(Ids.by_frequency(head))
    found = frequent.select("grp", F.array("word").alias("words"), "n")
    coded = stored(coded_texts(rows, ids), "coded")
    ranges = max(context.defaultParallelism, -(-(totals.agg(F.sum("n")).first()[0] or 0) // _RANGE))
    sieves: dict[int, Sieve | None] = {}
    for k in range(2, longest + 1):
        cells = stored(cell_counts(coded, k, sieves, least, ranges), f"cells{k}")
        found = found.unionByName(_spelled(cells, k, ids))
        if not whole:
            opened = open_counts(rows, k, ids).where(F.col("n") >= least)
            found = found.unionByName(opened.select("grp", F.split("phrase", " ", -1).alias("words"), "n"))
        if k < longest:
            sieves = {**sieves, k: sieve(cells, k, phrase_ids)}
    found = stored(found, "phrases")
    discard(coded)
    return found, totals


def _spelled(cells: DataFrame, k: int, shared: Broadcast) -> DataFrame:

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = shared.value, []
            for i in range(k):
                first = i // _IDS_A_CELL * _IDS_A_CELL
                shift = _ID_BITS * (min(first + _IDS_A_CELL, k) - 1 - i)
                places.append(batch.column(f"c{i // _IDS_A_CELL}").to_numpy() >> shift & (1 << _ID_BITS) - 1)
            spelled = pa.ListArray.from_arrays(pa.array(np.arange(0, k * batch.num_rows + 1, k), pa.int32()),
                                               ids.words.take(pa.array(np.stack(places, axis=1).ravel())))
            yield pa.RecordBatch.from_arrays([ids.groups.take(pa.array(ids.group_of[places[0]])), spelled, batch["n"]], ["grp", "words", "n"])

    return cells.mapInArrow(run, "grp string, words array<string>, n bigint")


def scored_phrases(phrases: DataFrame) -> DataFrame:
    """(grp, words, a, l, r, score) of phrases of two words or more that no longer one takes the place of.

    A cut after the first words gives l and r, the counts of both parts, and floor(2000000 a / (l + r)); the lowest counts,
    equal ones by the earliest cut. Phrases inside a longer one with at least 80 hundredths of their count are left out.
    """
    longer = phrases.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    part = phrases.withColumnRenamed("words", "part")
    cuts = cuts.withColumn("part", F.slice("words", F.lit(1), F.col("cut"))).join(part.withColumnRenamed("n", "l"), ["grp", "part"])
    cuts = cuts.withColumn("part", F.slice("words", F.col("cut") + 1, F.size("words"))).join(part.withColumnRenamed("n", "r"), ["grp", "part"])
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + r)")
    best = cuts.withColumn("score", score).groupBy("grp", "words", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("best"))
    size = F.size("words")
    inner = longer.where(size > 2).select("grp", "a", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))).alias("words"))
    inner = inner.groupBy("grp", "words").agg(F.max("a").alias("above"))
    kept = best.join(inner, ["grp", "words"], "left").where("above is null or 100 * cast(above as decimal(19,0)) < 80 * cast(a as decimal(19,0))")
    return kept.select("grp", "words", "a", "best.l", "best.r", "best.score")


def collocations(artifacts: DataFrame, text: str = "payload_json", group: str = "artifact_type", longest: int = 4, least: int = 30,
                 limit: int | None = 2000, word_ids: int = WORD_IDS, phrase_ids: int = PHRASE_IDS) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): of each group of artifacts the ``limit`` best phrases, or all with None.

    ``group`` keeps its name, as text; null is ``und``. A payload is split at ``. , ; : ! ?`` and line ends into pieces and
    those at blanks and tabs into words, A-Z lower-cased; phrases do not leave a piece. ``a`` is how often a phrase occurs, overlaps
    included, ``n`` all words of the group; the rest is as :func:`scored_phrases` has it. Ranks go by score and a, both
    descending, then by the phrase's bytes. Null, empty and blank payloads have no words; rows that repeat count each; an
    empty table gives no rows. Other columns are not read, so their names do not matter. Phrases with words beyond the ``word_ids`` most
    frequent are counted by their words, and with more than ``phrase_ids`` phrases of a length there is no sieve of it, with equal results.
    """
    phrases, totals = frequent_phrases(artifacts, text, group, longest, least, word_ids, phrase_ids)
    best = scored_phrases(phrases).withColumn("phrase", F.array_join("words", " "))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = best.withColumn("rank", rank)
    best = best if limit is None else best.where(F.col("rank") <= limit)
    return best.join(totals, "grp").select(F.col("grp").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")
