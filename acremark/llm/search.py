"""Ranked lexical search: bus artifacts whose payloads match the descriptions of analysis lists best.

The terms of all lists form one Aho-Corasick automaton that is sent to the tasks. Each term stands between
blanks in it, and so does each term of a payload, so that only whole terms are found. One scan of the
payloads gives the terms' counts; there is no index of the artifacts. What the automaton finds is led to
the lists by a table from terms to lists.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from acremark.llm.common import ASCII_NON_WORD, LOWER_BYTES, byte_texts, row_slices, stored, words

#: Terms of one automaton; lists beyond it are searched in further blocks, each with a scan of its own.
BLOCK_TERMS = 1 << 19
#: Fixed values of the score, as the contract states it.
WEIGHT_SCALE, TF_SCALE = 1000, 1_000_000_000
#: Letters lower-cased, other ASCII but digits to blanks; bytes of other scripts stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES)
#: Cells of (artifact, list) that a task scores at once.
_CELLS = 1 << 21


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return F.array_distinct(words(text, ASCII_NON_WORD))


def blocks(analyses: DataFrame, key: str = "key", text: str = "description",
           most: int = BLOCK_TERMS) -> Iterator[tuple[list[bytes], list, np.ndarray, np.ndarray]]:
    """(terms, keys, first, lists) for as many whole lists as have ``most`` terms together, one list at least.

    ``lists[first[t]:first[t + 1]]`` are the places in ``keys`` of the lists with term t. Rows of one key are one
    list; lists without a term and rows without a key are left out. The lists come one by one to the driver.
    """
    named = analyses.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(terms(F.col(text))).alias("term"))
    held: list[tuple[object, list[str]]] = []
    size = 0

    def block():
        vocabulary = sorted({t for _, ts in held for t in ts})
        place = {t: i for i, t in enumerate(vocabulary)}
        pairs = sorted((place[t], i) for i, (_, ts) in enumerate(held) for t in ts)
        first = np.searchsorted([t for t, _ in pairs], np.arange(len(vocabulary) + 1))
        return [t.encode() for t in vocabulary], [k for k, _ in held], first, np.array([i for _, i in pairs], np.int64)

    for row in named.groupBy("key").agg(F.collect_set("term").alias("terms")).orderBy("key").toLocalIterator():
        if held and size + len(row.terms) > most:
            yield block()
            held, size = [], 0
        held.append((row.key, row.terms))
        size += len(row.terms)
    if held:
        yield block()


def automaton(vocabulary: list[bytes]) -> ahocorasick.Automaton:
    """Finds the place of each term between blanks; the bytes of a term are read as one character each."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(vocabulary):
        found.add_word(f" {term.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def term_counts(text: bytes, finder: ahocorasick.Automaton) -> tuple[int, Counter]:
    """How many terms a text has, with repeats, and how often each term of the automaton stands in it."""
    plain = text.translate(_PLAIN)
    return len(plain.split()), Counter(map(itemgetter(1), finder.iter(f" {plain.decode('latin-1')} ")))


def scan(artifacts: DataFrame, vocabulary: list[bytes], artifact_id: str = "id", text: str = "payload_json") -> DataFrame:
    """(id, n, terms, counts) of every artifact with a term: its number of terms, and those of the vocabulary with their counts."""
    shared = artifacts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(shared.value)
        for batch in batches:
            for piece in row_slices(batch, 1, 16 << 20):
                got = [term_counts(t, finder) for t in byte_texts(piece.column(1))]
                columns = [piece.column(0), pa.array([n for n, _ in got], pa.int64()),
                           pa.array([list(c) for _, c in got], pa.list_(pa.int32())),
                           pa.array([list(c.values()) for _, c in got], pa.list_(pa.int64()))]
                out = pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "counts"])
                yield out.filter(pc.greater(out["n"], 0))

    given = artifacts.select(F.col(artifact_id).alias("id"), text)
    return given.mapInArrow(run, StructType([given.schema["id"], StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())),
                                             StructField("counts", ArrayType(LongType()))]))


def length_norms(n: np.ndarray, artifacts: int, total: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L, in exact integers."""
    if len(n) and 90 * int(n.max()) * artifacts >= 1 << 62:
        return np.array([10 + 90 * int(v) * artifacts // total for v in n], np.int64)
    return 10 + 90 * n * artifacts // max(total, 1)


def best_scores(counted: DataFrame, first: np.ndarray, lists: np.ndarray, weights: np.ndarray, artifacts: int, total: int,
                limit: int) -> DataFrame:
    """(place, score, id): of each task the ``limit`` highest scores of each list, equal ones by id.

    ``place`` is a list's place in its block. Rows of ``counted`` are as :func:`scan` gives them.
    """
    shared = counted.sparkSession.sparkContext.broadcast((first, lists, weights))
    n_lists = int(lists.max()) + 1
    order = [("place", "ascending"), ("score", "descending"), ("id", "ascending")]

    def best(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
        place = table["place"].to_numpy()
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
        rank = np.arange(len(place)) - np.repeat(start, np.diff(np.r_[start, len(place)]))
        return table.filter(pa.array(rank < limit))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, lists, weights = shared.value
        floor = np.zeros(n_lists, np.int64)  # a list's score at the limit so far
        held: list[pa.Table] = []
        waiting = 0
        step = max(1, _CELLS // n_lists)
        for batch in batches:
            for piece in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                n = piece["n"].to_numpy()
                sizes = pc.list_value_length(piece["terms"]).to_numpy()
                row, term = np.repeat(np.arange(len(n)), sizes), piece["terms"].flatten().to_numpy()
                tf = piece["counts"].flatten().to_numpy()
                value = weights[term] * ((TF_SCALE * tf) // (1000 * tf + 8 * np.repeat(length_norms(n, artifacts, total), sizes)))
                cells = np.zeros((len(n), n_lists), np.int64)
                for i in range(0, len(term), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    many = start[term[part] + 1] - start[term[part]]
                    at = np.arange(many.sum()) + np.repeat(start[term[part]] - np.cumsum(many) + many, many)
                    np.add.at(cells, (np.repeat(row[part], many), lists[at]), np.repeat(value[part], many))
                r, c = np.nonzero((cells >= floor) & (cells > 0))
                if not len(r):
                    continue
                held.append(pa.table({"place": pa.array(c, pa.int32()), "score": pa.array(cells[r, c]), "id": piece["id"].take(pa.array(r))}))
                waiting += len(r)
                if waiting > max(1 << 17, 4 * limit * n_lists) or len(held) == 1:
                    held = [best(pa.concat_tables(held))]
                    waiting = held[0].num_rows
                    place, score = held[0]["place"].to_numpy(), held[0]["score"].to_numpy()
                    last = np.searchsorted(place, np.arange(n_lists), side="right") - 1
                    floor = np.where(np.bincount(place, minlength=n_lists) >= limit, score[last], 0)
        if held:
            yield from best(pa.concat_tables(held)).to_batches()

    schema = StructType([StructField("place", IntegerType()), StructField("score", LongType()), counted.schema["id"]])
    return counted.select("n", "terms", "counts", "id").mapInArrow(run, schema)


def search(artifacts: DataFrame, analyses: DataFrame, limit: int = 10, artifact_id: str = "id", text: str = "payload_json",
           key: str = "key", description: str = "description", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(key, rank, id, score): the ``limit`` artifacts with the highest score above 0 for each analysis list, ranked from 1.

    With N artifacts that have a term and L terms in all of them, a term's weight is floor(1000 ln((2N+2)/(2df+1))), an artifact of
    n terms has m = 10 + (90 n N) div L, and its score adds weight * ((10^9 tf) div (1000 tf + 8 m)) over the list's distinct
    terms. Equal scores rank by ascending id, a null id first; rows of one id are ranked each. Null and blank payloads
    have no terms and are never found; rows of one list key are one list; lists without a term, or without a key, find
    nothing; empty tables give no rows. Other columns are not read, so their names do not matter.
    """
    out = None
    for vocabulary, keys, first, lists in blocks(analyses, key, description, block_terms):
        counted = stored(scan(artifacts, vocabulary, artifact_id, text), "counted")
        size = counted.agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        with_term = np.zeros(len(vocabulary), np.int64)
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            with_term[row.term] = row["count"]
        weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * size.artifacts + 2) / (2 * int(df) + 1))) for df in with_term], np.int64)
        found = best_scores(counted, first, lists, weights, size.artifacts, size.total, limit)
        order = [F.col("score").desc(), F.col("id").asc_nulls_first()]
        for keep in (["place", "_part"], ["place"]):  # ranked within parts of the tasks first, so that no task gets all of a list
            found = found.withColumn("_part", F.spark_partition_id() % 64) if "_part" in keep else found
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keep).orderBy(*order))).where(F.col("rank") <= limit)
        kind = StructType([StructField("place", IntegerType()), StructField("key", analyses.schema[key].dataType)])
        names = artifacts.sparkSession.createDataFrame(list(enumerate(keys)), kind)
        part = found.join(F.broadcast(names), "place").select("key", "rank", "id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = StructType([StructField("key", analyses.schema[key].dataType), StructField("rank", IntegerType()),
                           StructField("id", artifacts.schema[artifact_id].dataType), StructField("score", LongType())])
        out = artifacts.sparkSession.createDataFrame([], kind)
    return out
