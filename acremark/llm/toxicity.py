"""Toxicity of analysis descriptions by a factorization machine over hashed words.

A text is the set of its hashed words. Besides a weight per word the model has a short vector per word;
products of vectors add what pairs of words mean together, such as an insult beside the mention of a
group. Trained on a bounded sample of labelled rows, then sent to the tasks that score whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from acremark.llm.common import LOWER_BYTES, bounded_sample, byte_texts, known_labels, row_slices

BUCKETS, FACTORS = 1 << 20, 4
#: Labelled rows of each kind that a model is trained on, at most.
SAMPLE = 4000
#: Rows of the sample that a bucket must have to be learned, and to be looked at for partners.
LEAST_ROWS, PAIR_ROWS = 3, 50
_EXPANDED = 1 << 22
#: Letters lower-cased, other ASCII but digits to blanks; bytes of other scripts stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES)


class _Buckets(dict):
    """Buckets of each word: its own and those of its beginnings, which inflected forms share.

    Remembered per word; emptied once large. With ``kept`` only those buckets are given.
    """

    def __init__(self, kept: np.ndarray | None = None):
        super().__init__()
        self.kept = None if kept is None else set(kept.tolist())

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 50_000:
            self.clear()
        found = {zlib.crc32(part) & (BUCKETS - 1) for part in (word, b"^" + word[:4], b"^" + word[:5])}
        self[word] = out = tuple(found if self.kept is None else found & self.kept)
        return out


def hashed_words(text: bytes, buckets: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Distinct hash buckets of a text's words and word beginnings (4 and 5 bytes), sorted."""
    found = set().union(*(buckets[w] for w in set(text.translate(_PLAIN).split())))
    return np.sort(np.fromiter(found, np.int64, len(found)))


def _dependence(n, n1, has, both):
    """The chi-square with the continuity correction of a presence and a label."""
    gap = np.maximum(np.abs(both * n - has * n1) - n / 2, 0.0)
    return n * gap * gap / np.maximum(has * (n - has) * n1 * (n - n1), 1.0)


@dataclass
class Sample:
    """Rows as one array of places of their buckets in ``kept``, row after row, and their labels.

    ``kept`` (sorted) are the buckets that ``LEAST_ROWS`` rows or more have; ``start[r]`` is where row r begins in ``flat``.
    """

    kept: np.ndarray
    flat: np.ndarray
    start: np.ndarray
    labels: np.ndarray

    @staticmethod
    def of(items: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Sample:
        """From the buckets of all rows, one row after the other, and their number in each row."""
        known, n = np.unique(items, return_counts=True)
        kept = known[n >= LEAST_ROWS]
        flat, row, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
        ends = np.cumsum(sizes)
        while at < len(items):  # a part at a time, as the driver's memory is small
            part = items[at : at + (1 << 19)]
            place = np.minimum(np.searchsorted(kept, part), max(len(kept) - 1, 0)).astype(np.int32)
            held = kept[place] == part if len(kept) else np.zeros(len(part), bool)
            flat.append(place[held])
            row.append(np.searchsorted(ends, at + np.flatnonzero(held), side="right").astype(np.int32))
            at += len(part)
        start = np.searchsorted(np.concatenate(row), np.arange(len(sizes) + 1))
        return Sample(kept, np.concatenate(flat), start, labels)

    def dependence(self) -> np.ndarray:
        """Chi-square of each kept bucket and the label."""
        n = np.bincount(self.flat, minlength=len(self.kept))
        n1 = np.bincount(self.flat, np.repeat(self.labels, np.diff(self.start)), len(self.kept))
        return _dependence(float(len(self.labels)), float(self.labels.sum()), n.astype(np.float64), n1)


def _interaction(n, n1, a, a1, b, b1, both, both1) -> np.ndarray:
    """Squared z of how much the log odds ratio of b and the label differs between rows with and without a."""

    def ratio(rows, rows1, has, has1):
        cells = [np.maximum(x, 0) + 0.5 for x in (has1, has - has1, rows1 - has1, rows - has - rows1 + has1)]
        return np.log(cells[0] * cells[3] / (cells[1] * cells[2])), sum(1 / x for x in cells)

    one, other = ratio(a, a1, both, both1), ratio(n - a, n1 - a1, b - both, b1 - both1)
    return (one[0] - other[0]) ** 2 / (one[1] + other[1])


def pair_buckets(spark: SparkSession, sample: Sample, least: float = 25.0) -> np.ndarray:
    """Places in ``sample.kept`` of buckets with a partner: the label depends on both together otherwise than on each alone.

    All pairs of buckets with ``PAIR_ROWS`` rows each are counted; with fewer rows no pair reaches ``least``. The buckets are
    dealt to tasks, which count the pairs of theirs with all later ones.
    """
    n, rows = np.bincount(sample.flat, minlength=len(sample.kept)), len(sample.labels)
    some = np.flatnonzero((n >= PAIR_ROWS) & (n < rows))
    if len(some) < 2:
        return some[:0]
    place = np.full(len(n), -1)
    place[some] = np.arange(len(some))
    flat = place[sample.flat]
    row = np.repeat(np.arange(rows), np.diff(sample.start))[flat >= 0].astype(np.int32)
    shared = spark.sparkContext.broadcast((flat[flat >= 0].astype(np.int32), row, sample.labels.astype(np.int8)))
    blocks = -(-len(some) // 64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, row, labels = shared.value
        end = np.searchsorted(row, np.arange(len(labels)), side="right")
        order, m = np.argsort(flat, kind="stable"), len(some)
        first = np.searchsorted(flat[order], np.arange(m + 1))
        own, own1 = np.bincount(flat, minlength=m), np.bincount(flat, labels[row], m)
        told = np.zeros(m, bool)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                mine = np.arange(block, m, blocks)
                both = np.zeros((2, len(mine) * m))
                at = np.concatenate([order[first[i]:first[i + 1]] for i in mine])
                local = np.repeat(np.arange(len(mine)), first[mine + 1] - first[mine])
                later = end[row[at]] - at - 1
                for part in np.array_split(np.arange(len(at)), 1 + int(later.sum()) // _EXPANDED):
                    k = later[part]
                    cell = np.repeat(local[part] * m, k) + flat[np.arange(k.sum()) + np.repeat(at[part] + 1 - np.cumsum(k) + k, k)]
                    both[0] += np.bincount(cell, minlength=both.shape[1])
                    both[1] += np.bincount(cell, np.repeat(labels[row[at[part]]], k), both.shape[1])
                for i, a in enumerate(mine):
                    pair, pair1 = both[:, i * m:(i + 1) * m]
                    hit = (_interaction(len(labels), labels.sum(dtype=np.int64), own[a], own1[a], own, own1, pair, pair1) >= least) & (np.arange(m) > a)
                    told |= hit
                    told[a] |= hit.any()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(told), pa.int64())], ["place"])

    told = spark.range(0, blocks, 1, min(blocks, 64)).mapInArrow(run, "place bigint").distinct().toPandas()["place"]
    return np.sort(some[told.to_numpy(np.int64)])


@dataclass
class Machine:
    """Bias, kept buckets (sorted), their weights and vectors."""

    bias: float
    kept: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, items: np.ndarray) -> float:
        """Probability of label 1 for a set of buckets; unknown ones say nothing."""
        at = np.searchsorted(self.kept, items)
        at = at[(at < len(self.kept)) & (self.kept[np.minimum(at, len(self.kept) - 1)] == items)] if len(self.kept) else at[:0]
        v = self.vectors[at]
        total = v.sum(axis=0)
        raw = self.bias + self.weights[at].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40))))


def fit(sample: Sample, paired: np.ndarray, factors: int = FACTORS, epochs: int = 20, batch: int = 256, rate: float = 0.2, seed: int = 7,
        order: np.ndarray | None = None) -> Machine:
    """Logistic factorization machine over all buckets of the sample, by adaptive gradient steps over its rows in a seeded order.

    With ``order`` the seed shuffles the rows in that order, so that the result does not depend on how they came in.

    Every bucket has a weight and a vector. The less a bucket and the label depend on each other, the more both decay, so that
    few words are learned by heart; vectors of ``paired`` places hardly decay.
    """
    rng = np.random.default_rng(seed)
    kept, labels = sample.kept, sample.labels
    share = min(max(labels.mean() if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    model = Machine(float(np.log(share / (1 - share))), kept, np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), factors)))
    if not len(kept):
        return model
    order = np.arange(len(labels)) if order is None else order
    decay_w = 1e-4 + 0.1 / (1 + sample.dependence() ** 2)
    decay_v = decay_w.copy()
    decay_v[paired] = 1e-4
    model.vectors[paired] *= 2
    grad_w, grad_v, grad_b = np.full(len(kept), 1e-6), np.full(model.vectors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        for rows in np.array_split(order[rng.permutation(len(labels))], max(1, len(labels) // batch, min(len(labels) // 32, 8))):
            n = sample.start[rows + 1] - sample.start[rows]
            row = np.repeat(np.arange(len(rows)), n)
            at = sample.flat[np.arange(n.sum()) + np.repeat(sample.start[rows] - np.cumsum(n) + n, n)]
            v = model.vectors[at]
            total = np.stack([np.bincount(row, v[:, f], len(rows)) for f in range(factors)], axis=1)
            raw = model.bias + np.bincount(row, model.weights[at], len(rows)) + 0.5 * (
                (total**2).sum(axis=1) - np.bincount(row, (v**2).sum(axis=1), len(rows)))
            off = 1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40))) - labels[rows]
            dw = np.bincount(at, off[row], len(kept)) / len(rows) + decay_w * model.weights
            step = off[row][:, None] * (total[row] - v) / len(rows)
            dv = np.stack([np.bincount(at, step[:, f], len(kept)) for f in range(factors)], axis=1) + decay_v[:, None] * model.vectors
            grad_w += dw**2
            grad_v += dv**2
            grad_b += off.mean() ** 2
            model.weights -= rate * dw / np.sqrt(grad_w)
            model.vectors -= 0.2 * rate * dv / np.sqrt(grad_v)
            model.bias -= rate * off.mean() / np.sqrt(grad_b)
    return model


def train(analyses: DataFrame, labels: DataFrame, learn: Column, analysis_id: str = "analysis_number", text: str = "description",
          label: str = "offensive", most: int = SAMPLE, seed: int = 7) -> Machine:
    """A machine from at most ``most`` ids of each label among those of ``labels`` where ``learn`` holds.

    Of two labels of one id the larger counts. The machine has every bucket that ``LEAST_ROWS`` rows of the sample have. The
    bias is that of the share of labels among all such ids, not of the sample. Without labels all scores are near 0.
    Only the sample's buckets come to the driver; no text is shuffled.
    """
    known = known_labels(labels.where(learn), analysis_id, label)
    n = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    chosen = bounded_sample(known, analysis_id, label, most, seed, each=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            sets = [hashed_words(t, buckets) for t in byte_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["items", "label", "place"])

    rows = analyses.select(analysis_id, text).join(F.broadcast(chosen), analysis_id).select(
        text, F.col(label).alias("label"), F.xxhash64(F.col(analysis_id).cast("string"), F.lit(seed)).alias("place"))
    got = rows.mapInArrow(run, "items array<int>, label int, place bigint").toArrow()
    order = np.argsort(got["place"].to_numpy(), kind="stable")
    sizes = pc.list_value_length(got["items"]).to_numpy().astype(np.int64)
    items = np.concatenate([np.zeros(0, np.int32), *[part.flatten().to_numpy() for part in got["items"].chunks]])
    is_one = got["label"].to_numpy().astype(np.float64)
    del got
    sample = Sample.of(items, sizes, is_one)
    del items
    machine = fit(sample, pair_buckets(analyses.sparkSession, sample), seed=seed, order=order)
    pa.default_memory_pool().release_unused()
    if not len(sizes):
        machine.bias = -40.0
        return machine
    if len(n) == 2:  # what the sample took of each label
        machine.bias -= np.log(min(n[1], most) / n[1]) - np.log(min(n[0], most) / n[0])
    return machine


def score(analyses: DataFrame, machine: Machine, text: str = "description") -> DataFrame:
    """The rows with ``score`` (0 to 1, higher: label 1 likelier), in place of a column of that name.

    Null and empty texts get the score of no words, the bias. Repeated rows get equal scores; an empty
    table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(machine.kept)
        for batch in batches:
            for piece in row_slices(batch, at, 4 << 20):
                scores = [machine.score(hashed_words(t, buckets)) for t in byte_texts(piece.column(at))]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores, pa.float64())], [*piece.schema.names, "score"])

    clean = analyses.drop("score")
    at = clean.columns.index(text)
    return clean.mapInArrow(run, StructType([*clean.schema.fields, StructField("score", DoubleType())]))
