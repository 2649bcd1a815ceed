"""Registry of the checked queries: a Spark callable and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acremark.session import scratch_path
from checks import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_stored: dict[tuple[str, str, str], str] = {}


class Tables:
    """Given tables by name, and derived ones stored once per session as parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in derived.TABLES:
            return derived.frame(self.spark, self.sf_dir, name)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            path = scratch_path(self.spark, name)
            derived.frame(self.spark, self.sf_dir, name).write.parquet(path)
            _stored[key] = path
        return self.spark.read.parquet(_stored[key])


def query(name: str, reads: list[str] = (), sql: str | None = None):
    """Register ``fn(t)``; ``sql`` reads the derived tables named in ``reads``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = derived.oracle(list(reads), sql)
        return fn

    return register
