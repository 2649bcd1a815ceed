"""Language of map features' descriptions by a string kernel with Nystroem landmarks and ridge regression.

Two texts are alike by the character runs of length 1, 2 and 3 that both have: for each length the shared
runs over the geometric mean of both counts, averaged. Every text is compared with a few landmark texts
only; one-versus-rest kernel ridge regression on a bounded sample gives a weight per landmark and
language, and whole batches are scored by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from acremark.llm.common import row_slices, stored

UNDETERMINED = "und"
#: Learned rows of each language and landmarks in all, at most.
SAMPLE, LANDMARKS = 400, 192
#: Up to this many languages their counts are broadcast.
BROADCAST_LANGUAGES = 100_000
_LENGTHS = (1, 2, 3)
_POINT = np.uint64(21)


def runs(text: str | None) -> list[np.ndarray] | None:
    """The runs of 1, 2 and 3 characters that occur, sorted, other characters than letters as one blank.

    A run is the number that its code points of 21 bits make, so no two runs are taken for one. None if there is no letter.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known, where = np.unique(points, return_inverse=True)
    letters = np.fromiter((chr(p).isalpha() for p in known), bool, len(known))
    if not letters.any():
        return None
    points = np.where(letters[where], points, np.uint32(32)).astype(np.uint64)
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    points = np.r_[np.uint64(32), points[int(points[0] == 32) : len(points) - int(points[-1] == 32)], np.uint64(32)]
    pairs = points[:-1] << _POINT | points[1:]
    three = np.unique(pairs[:-1] << _POINT | points[2:])
    two = np.unique(np.r_[three >> _POINT, pairs[-1]])
    return [np.unique(np.r_[two >> _POINT, points[-1]]), two, three]


@dataclass
class Runs:
    """The runs of some texts, numbered: of each length the sorted runs and the number of the first."""

    known: list[np.ndarray]

    @staticmethod
    def of(found: list[list[np.ndarray]]) -> Runs:
        return Runs([np.unique(np.concatenate([f[i] for f in found])) for i in range(len(_LENGTHS))])

    def presence(self, found: list[list[np.ndarray]]) -> np.ndarray:
        """A row per text: presence of each of these runs, over the square root of how many runs of its length the text has at all.

        Products with rows of texts that have no other runs are the kernel.
        """
        first = np.cumsum([0, *map(len, self.known)])
        out = np.zeros((len(found), first[-1]), dtype=np.float32)
        for row, parts in enumerate(found):
            for i, own in enumerate(parts):
                at = np.minimum(np.searchsorted(self.known[i], own), len(self.known[i]) - 1)
                out[row, first[i] + at[self.known[i][at] == own]] = 1.0 / np.sqrt(len(own) * len(_LENGTHS))
        return out


@dataclass
class Recogniser:
    """The landmarks' runs, their rows, the regression weights of each (landmark, language), and the languages."""

    runs: Runs
    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def predict(self, texts: list[str | None], block: int = 128) -> list[tuple[str, float]]:
        """Language and score (0 to 1) of each text; undetermined with score 0 without letters or languages.

        Of languages that fit equally well the first by name is given.
        """
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for at in range(0, len(texts) if self.languages else 0, block):
            found = [runs(t) for t in texts[at : at + block]]
            rows = [i for i, f in enumerate(found) if f is not None]
            if rows:
                margin = self.margins([found[i] for i in rows])
                best = margin.argmax(axis=1)
                odds = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
                share = odds.max(axis=1) / odds.sum(axis=1)
                for i, b, s in zip(rows, best, share):
                    out[at + i] = (self.languages[b], float(s))
        return out

    def margins(self, found: list[list[np.ndarray]]) -> np.ndarray:
        return self.runs.presence(found) @ self.landmarks.T @ self.weights


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Recogniser:
    """A recogniser from learned texts; texts without letters are left out."""
    found = [(f, lang) for f, lang in ((runs(t), lang) for t, lang in zip(texts, languages)) if f is not None]
    names = sorted({lang for _, lang in found})
    if not found:
        return Recogniser(Runs([]), np.zeros((0, 0), np.float32), np.zeros((0, 0)), [])
    by_language = {n: [i for i, (_, lang) in enumerate(found) if lang == n] for n in names}
    each = max(1, landmarks // len(names))
    chosen = [found[i][0] for n in names for i in by_language[n][:each]]
    numbered = Runs.of(chosen)
    marks = numbered.presence(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    near = np.concatenate([numbered.presence([f for f, _ in found[at : at + 128]]) @ marks.T for at in range(0, len(found), 128)])
    features = near @ root
    wanted = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in found])
    solved = np.linalg.solve(features.T @ features + ridge * len(found) * np.eye(features.shape[1]), features.T @ wanted)
    return Recogniser(numbered, marks, (root @ solved).astype(np.float32), names)


def train(features: DataFrame, learn: Column, feature_id: str = "osm_id", text: str = "description", language: str = "language",
          most: int = SAMPLE, seed: int = 5) -> Recogniser:
    """A recogniser from at most ``most`` ids of each non-null language among those where ``learn`` holds.

    The rows of each language are counted first, so that tasks hand on little more than is taken, by a hash of the id.
    """
    order = [F.xxhash64(F.col(feature_id).cast("string"), F.lit(seed)), F.col(feature_id)]
    w = Window.partitionBy("language").orderBy("_o", "_id")
    known = features.where(learn & F.col(language).isNotNull() & F.col(text).isNotNull() & F.col(feature_id).isNotNull())
    chosen = known.select(F.col(language).alias("language"), order[0].alias("_o"), F.col(feature_id).alias("_id"))
    share = F.lit(1.2 * most + 200) / F.col("_n")
    counts = stored(known.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("_n")), "languages")
    chosen = chosen.join(F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts, "language")
    chosen = chosen.where(F.shiftrightunsigned("_o", 11) / F.lit(2.0**53) <= share)
    chosen = chosen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).select("_id").distinct()
    rows = known.join(F.broadcast(chosen), known[feature_id] == chosen["_id"], "left_semi")
    got = rows.select(F.col(text).alias("text"), F.col(language).alias("language"), order[0].alias("o")).toPandas()
    got = got.sort_values(["o", "text"], kind="stable")
    return fit(list(got["text"]), list(got["language"]))


def recognise(features: DataFrame, recogniser: Recogniser, text: str = "description") -> DataFrame:
    """The rows with ``language_pred`` and ``score``, in place of columns of those names.

    Null texts and texts without letters are ``und`` with score 0; whole texts count, however long. Repeated rows get equal results; an
    empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, at, 16 << 20):
                got = recogniser.predict(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    [*piece.schema.names, "language_pred", "score"])

    clean = features.drop("language_pred", "score")
    at = clean.columns.index(text)
    more = [StructField("language_pred", StringType()), StructField("score", DoubleType())]
    return clean.mapInArrow(run, StructType([*clean.schema.fields, *more]))
