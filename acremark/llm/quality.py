"""Quality of analysis descriptions by votes of their nearest labelled neighbours in a latent space.

A text's terms are short runs of character kinds (letters by case, digits, each mark), repeated words and
lines: its form, in any language. Tf-idf weights of a bounded labelled sample are reduced to a few latent
directions; every text is placed there and compared with every labelled vector by blocked matrix
products, and the labels of the nearest ones vote, weighted by cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from acremark.llm.common import bounded_sample, byte_texts, known_labels, row_slices

#: Labelled rows that are kept as neighbours, at most, and what is taken of them.
SAMPLE, DIRECTIONS, NEIGHBOURS = 6000, 48, 15
_KINDS = 40
_EXTRA = 24


def _kind_table() -> np.ndarray:
    """Kind of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 beyond ASCII, then the marks."""
    out = np.full(256, 5, dtype=np.int64)
    mark = 6
    for b in range(128):
        c = chr(b)
        if c.islower() or c.isupper():
            out[b] = int(c.isupper())
        elif c.isdigit():
            out[b] = 2
        elif c in "\r\n":
            out[b] = 4
        elif c.isspace() or b < 32:
            out[b] = 3
        else:
            out[b], mark = mark, mark + 1
    return out


_KIND = np.minimum(_kind_table(), _KINDS - 1)
TERMS = _KINDS**3 + _EXTRA


def form_terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and their counts: triples of character kinds (runs of lower-case letters count once),
    and how often words and lines repeat, on a scale of halvings."""
    kinds = _KIND[np.frombuffer(text, dtype=np.uint8)]
    kinds = kinds[kinds != 5] if len(kinds) else kinds
    if len(kinds):
        kinds = kinds[np.r_[True, (kinds[1:] != kinds[:-1]) | (kinds[1:] != 0)]]
    found = text.split()
    lines = text.split(b"\n")
    scales = [sum(a == b for a, b in zip(found, found[1:])) / max(1, len(found)), 1 - len(set(lines)) / len(lines),
              1 - len(set(found)) / max(1, len(found))]
    extra = [TERMS - _EXTRA + 8 * i + min(7, int(-np.log2(s))) for i, s in enumerate(scales) if s > 0]
    if len(kinds) < 3:
        return np.array(extra, np.int64), np.full(len(extra), 8.0)
    terms, counts = np.unique((kinds[:-2] * _KINDS + kinds[1:-1]) * _KINDS + kinds[2:], return_counts=True)
    return np.r_[terms, extra].astype(np.int64), np.r_[counts, np.full(len(extra), 8.0)]


@dataclass
class Space:
    """Kept terms (sorted), their idf, the latent directions, and the labelled vectors in it."""

    terms: np.ndarray
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, texts: list[bytes]) -> np.ndarray:
        """Unit latent vectors; zero for texts without any known term."""
        return _unit(_weights([form_terms(t) for t in texts], self.terms, self.idf) @ self.directions)

    def vote(self, texts: list[bytes], neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by a power of the cosine; equally near ones in their order."""
        out = np.full(len(texts), float(self.labels.mean()) if len(self.labels) else 0.5)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(texts) if k else 0, block):
            placed = self.place(texts[at : at + block])
            cosine = placed @ self.vectors.T
            last = np.partition(cosine, -k, axis=1)[:, -k, None]  # of equally near rows at the end the first count
            tied = cosine == last
            above = cosine > last
            near = np.nonzero(above | tied & (tied.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))[1].reshape(-1, k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** 8
            known = (placed != 0).any(axis=1)
            got = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            out[at : at + block] = np.where(known, got, out[at : at + block])
        return np.clip(out, 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0).astype(np.float32)


def _weights(found: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(found), len(terms)), dtype=np.float32)
    for row, (t, n) in enumerate(found):
        if len(terms):
            at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            ok = terms[at] == t
            out[row, at[ok]] = (1 + np.log(n[ok])) * idf[at[ok]]
    return _unit(out)


def fit(texts: list[bytes], labels: np.ndarray, directions: int = DIRECTIONS, least: int = 3, most_terms: int = 2500) -> Space:
    """The latent space of labelled texts, of the ``most_terms`` most frequent terms that ``least`` of them have."""
    found = [form_terms(t) for t in texts]
    seen, df = np.unique(np.concatenate([t for t, _ in found]) if found else np.array([], np.int64), return_counts=True)
    strong = np.sort(np.argsort(-df, kind="stable")[:most_terms])
    strong = strong[df[strong] >= least]
    terms, idf = seen[strong], (np.log((1 + len(texts)) / (1 + df[strong])) + 0.3).astype(np.float32)
    rows = _weights(found, terms, idf)
    _, basis = np.linalg.eigh((rows.T @ rows).astype(np.float64))
    basis = basis[:, ::-1][:, :directions].astype(np.float32)
    return Space(terms, idf, basis, _unit(rows @ basis), labels.astype(np.float32))


def train(analyses: DataFrame, labels: DataFrame, learn: Column, analysis_id: str = "analysis_number", text: str = "description",
          label: str = "usable", most: int = SAMPLE, seed: int = 11) -> Space:
    """A space from at most ``most`` labelled ids among those of ``labels`` where ``learn`` holds; of two labels of one id the larger counts."""
    chosen = bounded_sample(known_labels(labels.where(learn), analysis_id, label), analysis_id, label, most, seed)
    rows = analyses.select(analysis_id, text).join(F.broadcast(chosen), analysis_id).select(
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.col(label).alias("label"),
        F.xxhash64(F.col(analysis_id).cast("string"), F.lit(seed)).alias("place"))
    got = rows.toPandas().sort_values("place", kind="stable")
    return fit([bytes(t) for t in got["text"]], got["label"].to_numpy())


def score(analyses: DataFrame, space: Space, text: str = "description") -> DataFrame:
    """The rows with ``score`` (0 to 1, higher: label 1 likelier), in place of a column of that name.

    Null, empty and wholly unknown texts get the labelled rows' share of label 1. Repeated rows get equal
    scores; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, at, 16 << 20):
                scores = space.vote(byte_texts(piece.column(at)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores, pa.float64())], [*piece.schema.names, "score"])

    clean = analyses.drop("score")
    at = clean.columns.index(text)
    return clean.mapInArrow(run, StructType([*clean.schema.fields, StructField("score", DoubleType())]))
