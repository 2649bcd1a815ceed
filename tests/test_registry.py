"""The contract of the registered queries, and a few of them run against DuckDB on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

CHECKED = [
    "flagship_best_parcels", "features_in_parcels", "kernel_density_mesh", "quadtree_visited_cells", "price_stats_per_run",
    "keyed_upsert", "hierarchy_groups", "viewport_nearest_parcels", "pixels_in_parcels", "connected_components", "wkt_decode",
]


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_sql_text_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.oracle_sql()) > 100


@needs_data
def test_every_sql_text_is_understood(oracle):
    for name, text in entry_module.oracle_sql().items():
        oracle.execute("EXPLAIN " + text)


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, oracle, name):
    frame = entry_module.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = oracle.execute(entry_module.oracle_sql()[name])
    given = [d[0] for d in cursor.description]
    assert sorted(given) == columns
    want = sorted(repr(tuple(row[given.index(c)] for c in columns)) for row in cursor.fetchall())
    got = sorted(repr(tuple(row)) for row in frame.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want
