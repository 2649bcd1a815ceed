import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from acremark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


VERTEX = "parcel_id string, polygon_index int, ring_index int, point_index int, lon double, lat double"


@pytest.fixture
def vertices(spark):
    """Vertex rows from {parcel: [polygon: [ring: [(lon, lat)]]]}."""

    def build(shapes):
        rows = [
            (parcel, i, j, k, float(lon), float(lat))
            for parcel, polygons in shapes.items()
            for i, polygon in enumerate(polygons)
            for j, ring in enumerate(polygon)
            for k, (lon, lat) in enumerate(ring)
        ]
        return spark.createDataFrame(rows, VERTEX)

    return build
