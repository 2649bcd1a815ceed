"""Landed batches as streams: merges, resumable work lists, live roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acremark.operators.ordering import first_per_key
from acremark.operators.upsert import upsert
from acremark.session import cut_lineage
from acremark.streaming import versions
from acremark.streaming.versions import BUCKET, read_table  # noqa: F401


def _landed(rows: DataFrame, keys: list[str], buckets: int) -> tuple[DataFrame, list[int]]:
    """The rows with their bucket, stored once, and the buckets that they touch."""
    landed = cut_lineage(rows.withColumn(BUCKET, versions.bucket_of(keys, buckets)))
    return landed, sorted(r[BUCKET] for r in landed.select(BUCKET).distinct().collect())


def _merged(landed: DataFrame, touched: list[int], path: str, table: str, known: dict, keys: list[str], newest_by: list[str],
            buckets: int, keep: list[str] = (), newest_wins: bool = False) -> dict[str, str | None]:
    stored = versions.read_table(landed.sparkSession, path, table, touched, known)
    stored = landed.limit(0) if stored is None else stored.withColumn(BUCKET, versions.bucket_of(keys, buckets))
    return versions.write_buckets(upsert(stored, landed, keys, newest_by, keep, newest_wins), path, table, touched)


def merge_into(batch: DataFrame, path: str, keys: list[str], newest_by: list[str], buckets: int = 64,
               keep: list[str] = (), newest_wins: bool = False, source: tuple[str, int] | None = None) -> None:
    """Merge a batch into the stored table ``rows`` of the store at ``path``, cut into hash buckets of its key.

    Only the buckets that the batch touches are read and written, to new folders; the store's manifest is switched to them
    at the end. A job that stops before leaves the version before readable, and repeating it gives the same
    table. With ``source``, the stream's name and its batch, a batch that is in the store already is passed over.
    ``newest_wins`` is that of :func:`upsert`.
    """
    spark, known = batch.sparkSession, versions.manifest(batch.sparkSession, path)
    if source and known["batches"].get(source[0], -1) >= source[1]:
        return
    landed, touched = _landed(batch, keys, buckets)
    folders = _merged(landed, touched, path, "rows", known, keys, newest_by, buckets, keep, newest_wins)
    versions.commit(spark, path, known, {"rows": folders}, source)


def stream_upsert(stream: DataFrame, path: str, keys: list[str], newest_by: list[str], checkpoint: str,
                  transform: Callable[[DataFrame], DataFrame] = lambda batch: batch, **options) -> StreamingQuery:
    """Merge every micro-batch of a stream into the stored table, then stop when all is read."""
    return (
        stream.writeStream.foreachBatch(lambda batch, n: merge_into(transform(batch), path, keys, newest_by, source=(checkpoint, n), **options))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_parcels(stream: DataFrame, path: str, checkpoint: str, version: str, to_points: Callable[[DataFrame], DataFrame],
                   buckets: int = 64) -> StreamingQuery:
    """Merge landed parcels into table ``parcels`` of the store and replace in ``points`` all vertices of each one that arrives.

    ``to_points`` turns parcel rows into vertex rows. A batch is written as a generation of both tables, so what is stored is not
    written anew with each batch. Both tables change with one switch of the manifest, so no reader sees
    a parcel with another version's vertices.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_parcels(batch, path, version, to_points, buckets, (checkpoint, number))

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def merge_parcels(batch: DataFrame, path: str, version: str, to_points: Callable[[DataFrame], DataFrame], buckets: int = 64,
                  source: tuple[str, int] | None = None) -> None:
    """One batch of :func:`stream_parcels`. Of rows of one parcel the last by ``version`` counts."""
    spark, known, keys = batch.sparkSession, versions.manifest(batch.sparkSession, path), ["parcel_id"]
    if source and known["batches"].get(source[0], -1) >= source[1]:
        return
    latest = cut_lineage(first_per_key(batch, keys, [F.desc(version)]))
    parcels = versions.write_generation(latest.drop("polygons"), path, "parcels", known, keys, buckets)
    points = versions.write_generation(to_points(latest), path, "points", known, keys, buckets, latest)
    versions.commit(spark, path, known, parcels | points, source, {table: keys for table in ("parcels", "points")})


def pending_parcels(parcels: DataFrame, checks: DataFrame) -> DataFrame:
    """Parcels to scan: never checked, or checked with an error."""
    return parcels.join(checks.where("status = 'ok'").select("parcel_id"), "parcel_id", "left_anti")


def missing_features(parcels: DataFrame, features: DataFrame, links: DataFrame | None = None, run_id: str | None = None,
                     limit: int = 0) -> DataFrame:
    """Ids without features, of one run if given, in id order; a limit of zero means all."""
    ids = parcels.select("parcel_id")
    if run_id is not None:
        ids = ids.join(links.where(F.col("run_id") == run_id).select("parcel_id"), "parcel_id", "left_semi")
    missing = ids.join(features.select("parcel_id"), "parcel_id", "left_anti").distinct()
    return missing.orderBy("parcel_id").limit(limit) if limit > 0 else missing


def pinned_ids(parcels: DataFrame, links: DataFrame | None = None, run_id: str | None = None,
               parcel_id: str | None = None) -> DataFrame:
    """The ids a feature job works on: one parcel, one run's parcels, or all."""
    if parcel_id:
        return parcels.sparkSession.createDataFrame([(parcel_id,)], "parcel_id string")
    if run_id:
        return links.where(F.col("run_id") == run_id).select("parcel_id").distinct()
    return parcels.select("parcel_id").distinct()


def page_rollup(pages: DataFrame) -> DataFrame:
    """Ingest report per county over the page log; works on a table and on a stream of log lines."""
    return pages.groupBy("county_code").agg(
        F.count("*").alias("pages"),
        *[F.sum(c).alias(c) for c in ("fetched", "inserted_or_updated", "skipped_unchanged", "errors")],
        F.when(F.sum("errors") > 0, "error").otherwise("ok").alias("status"),
    )


def page_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count("*").alias("counties"),
        F.count_if(F.col("status") == "ok").alias("ok_counties"),
        F.count_if(F.col("status") != "ok").alias("error_counties"),
        *[F.sum(c).alias(f"{c}_total") for c in ("fetched", "inserted_or_updated", "skipped_unchanged", "errors")],
    )


def read_page_log(spark: SparkSession, path: str) -> DataFrame:
    """Stream of page events appended as JSON lines."""
    schema = ("time timestamp, county_code string, stage string, page bigint, fetched bigint, inserted_or_updated bigint, "
              "skipped_unchanged bigint, errors bigint")
    return spark.readStream.schema(schema).json(path).where("stage IS NULL OR stage = 'fetch_page'")


def page_windows(pages: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Page figures per county and window of event time; works on a table and on a stream.

    A stream keeps a window's state until its newest event is ``lateness`` past the window's end. Rows of windows that are closed
    by then are late: they are not added, :func:`late_rows` counts them.
    """
    timed = pages.where("time IS NOT NULL").withWatermark("time", lateness)
    found = timed.groupBy(F.window("time", window).alias("window"), "county_code").agg(
        F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("fetched", "inserted_or_updated", "skipped_unchanged", "errors")])
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "county_code", "pages",
                        "fetched", "inserted_or_updated", "skipped_unchanged", "errors")


def stream_page_windows(pages: DataFrame, path: str, checkpoint: str, window: str = "1 hour", lateness: str = "1 day",
                        buckets: int = 16) -> StreamingQuery:
    """Keeps :func:`page_windows` of a stream as a stored table: each changed window replaces what was stored of it."""
    keys = ["window_start", "county_code"]
    return (
        page_windows(pages, window, lateness).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, n: merge_into(batch, path, keys, ["pages"], buckets, source=(checkpoint, n)))
        .trigger(availableNow=True).start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query has left out so far because their window was closed, of the progress that Spark still has."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
