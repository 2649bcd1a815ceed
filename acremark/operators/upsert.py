"""Keyed merges of landed batches into stored tables, and run-scoped rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acremark.operators.ordering import first_per_key


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], newest_by: list[str],
           keep: list[str] = (), newest_wins: bool = False) -> DataFrame:
    """The target with the batch merged in: the last row of a key replaces the stored row whole.

    ``newest_by`` names columns whose largest values mark the last row of a key; together they must
    be total. Columns in ``keep`` hold on to the value a key was first stored with.
    With ``newest_wins`` the stored row takes part by the same columns, so that an older row that lands later
    does not replace a newer one. Only the keys of the batch meet the target.
    """
    rows = batch
    if newest_wins:
        rows = batch.unionByName(target.join(batch.select(*keys).distinct(), keys, "left_semi"), allowMissingColumns=True)
    latest = first_per_key(rows, keys, [F.desc(c) for c in newest_by])
    for column in keep:
        first_seen = first_per_key(batch, keys, [F.asc(c) for c in newest_by]).select(*keys, F.col(column).alias("_first"))
        stored = target.select(*keys, F.col(column).alias("_stored"))
        latest = (
            latest.join(first_seen, keys).join(stored, keys, "left")
            .withColumn(column, F.coalesce("_stored", "_first")).drop("_stored", "_first")
        )
    untouched = target.join(latest.select(*keys), keys, "left_anti")
    return untouched.unionByName(latest, allowMissingColumns=True)


def upsert_parcels(parcels: DataFrame, points: DataFrame, new_parcels: DataFrame, new_points: DataFrame,
                   version: str) -> tuple[DataFrame, DataFrame]:
    """Merge parcels and replace all their vertices, so that none of an older outline is left.

    ``version`` orders the deliveries of a parcel within the batch; both new frames carry it.
    """
    latest = first_per_key(new_parcels, ["parcel_id"], [F.desc(version)])
    chosen = latest.select("parcel_id", version)
    fresh_points = new_points.join(chosen, ["parcel_id", version], "left_semi").drop(version)
    ids = chosen.select("parcel_id")
    merged_parcels = parcels.join(ids, "parcel_id", "left_anti").unionByName(latest.drop(version))
    merged_points = points.join(ids, "parcel_id", "left_anti").unionByName(fresh_points)
    return merged_parcels, merged_points


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: the first of each new key. Keys already stored keep their row."""
    return first_per_key(batch, keys, order).join(target.select(*keys), keys, "left_anti")


def replace_runs(rows: DataFrame, path: str, run_column: str = "run_id") -> None:
    """Write rows so that each run present in them replaces that run's stored rows, and only those."""
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(run_column).parquet(path)
    )


def clear_tables(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Empty run-scoped tables, keeping their schema; returns (table, before, after)."""
    report = []
    for name, path in paths.items():
        stored = spark.read.parquet(path)
        before = stored.count()
        spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(path)
        report.append((name, before, spark.read.parquet(path).count()))
    return spark.createDataFrame(report, "table string, before long, after long")


def with_missing_columns(frame: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Add columns that older files lack: name -> (type, default)."""
    absent = {n: spec for n, spec in wanted.items() if n not in frame.columns}
    return frame.select("*", *[F.lit(default).cast(kind).alias(n) for n, (kind, default) in absent.items()])
