"""Shared pieces of the text operators: word arrays, id remainders, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acremark.session import scratch_path

#: Word separators as the contracts state them.
BLANKS = r"[\x20\x09-\x0D]+"
ASCII_NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column, separators: str = BLANKS) -> Column:
    """The words of a text in order, after :func:`ascii_lower`; an empty array for null or blank texts."""
    return F.array_remove(F.split(ascii_lower(text), separators), "")


def remainder(row_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))) % F.lit(modulus)


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back: lineage is cut there.

    The table is on storage that all executors share, so losing one does not replay what made it.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables of frames that :func:`stored` gave; nothing that reads them may be run afterwards."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def known_labels(labelled: DataFrame, row_id: str, label: str) -> DataFrame:
    """(row_id, label) with one label, 0 or 1, of each id; of two the larger counts. Rows without an id or label go."""
    known = labelled.select(row_id, F.col(label).cast("int").alias(label)).where(F.col(row_id).isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy(row_id).agg(F.max(label).alias(label))


def bounded_sample(known: DataFrame, row_id: str, label: str, most: int, seed: int, each: bool = False) -> DataFrame:
    """At most ``most`` of the labelled ids by a seeded hash of the id, or that many of each label with ``each``.

    Works on ids and labels only, as :func:`known_labels` gives them; the texts are joined to the few chosen ids afterwards.
    The ids are counted first, so that tasks hand on little more than is taken.
    """
    place = F.xxhash64(F.col(row_id).cast("string"), F.lit(seed))
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}

    def first(part: DataFrame, n: int) -> DataFrame:
        bound = -(1 << 63) + min(int((1 << 64) * (1.2 * most + 200) / max(n, 1)), (1 << 64) - 1)
        return part.where(place <= bound).orderBy(place, row_id).limit(most)

    if not each:
        return first(known, sum(counts.values()))
    return first(known.where(F.col(label) == 0), counts.get(0, 0)).unionByName(first(known.where(F.col(label) == 1), counts.get(1, 0)))


def most_frequent(counted: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Rows with ``n`` above a bound, ``most`` rows at most, and whether these are all.

    The bound is sought in a histogram of 32 steps a power of two, so nothing is sorted and nothing more than
    ``most`` rows has to be taken in.
    """
    step = F.floor(F.log2("n") * 32).cast("int")
    steps = {r.step: r["count"] for r in counted.groupBy(step.alias("step")).count().collect()}
    if sum(steps.values()) <= most:
        return counted, True
    kept, least = 0, max(steps) + 1
    for s in sorted(steps, reverse=True):
        if kept + steps[s] > most:
            break
        kept, least = kept + steps[s], s
    return counted.where(step >= least), False


#: Translation of A-Z to a-z over bytes; the blanks of bytes.split() are those of BLANKS.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, empty for null."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def byte_words(text: bytes) -> list[bytes]:
    """The words between blanks of a UTF-8 text, A-Z lower-cased."""
    return text.translate(LOWER_BYTES).split()


def row_slices(batch: pa.RecordBatch, column: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``budget`` bytes of the text column each, one row at least."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)
